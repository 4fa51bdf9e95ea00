"""Registered queries of the reference's operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import adjusted, average_rank, rand_index
from ..operators import communities, compare, graph, measures, paths, regress, segments, spatial, spins, stabilise
from ..operators.subclusters import subcluster_nodes, subclusters
from ..sources import matrix
from ..sources import tables as T
from ..sources.tables import COUNTS_SQL, PATHS_SQL, SERIES_SQL, SPOTS_SQL
from .region import CANDIDATES, signal_states
from .shared import (
    ALL_LINES, CELL, CORNERS, EDGES, EX, GAP_LINES, GENES, HEX_LINES, LINE_SEGS, MARGINS, QUERIES, REACH, S1, S2, SCORED, SQL, SQUARE_LINES, URGENT,
    edges, hex_lines, line_segments, polygon_sql, query, r6, scored_spots, states, urgent,
)

# ------------------------------------------------------------------ measures


@query("q_cpm", "select spot_id, gene, round(cnt / sum(cnt) over (partition by spot_id) * 1e6, 6) as cpm from counts", (COUNTS_SQL,))
def q_cpm(spark, sf):
    return measures.per_million(T.counts(spark, sf)).select("spot_id", "gene", r6("cpm"))


@query("q_marker_sums", "select spot_id, ex_sum, cell_sum from scored", S1)
def q_marker_sums(spark, sf):
    return scored_spots(spark, sf).select("spot_id", "ex_sum", "cell_sum")


RESID = """
fit as (select regr_slope(ex_sum, cell_sum) as b, regr_intercept(ex_sum, cell_sum) as a from scored where cell_sum >= 100),
res as (select spot_id, cluster, case when cell_sum >= 100 then ex_sum - a - b * cell_sum end as r from scored, fit)"""


@query("q_residual_score", "select spot_id, round(r + abs(min(r) over ()), 6) as ex_score from res", (*S1, RESID))
def q_residual_score(spark, sf):
    return measures.residual_score(scored_spots(spark, sf), F.col("cell_sum") >= 100, "ex_sum", "cell_sum", "ex_score").select("spot_id", r6("ex_score"))


@query(
    "q_cluster_mean_median",
    "select cluster, gene, round(avg(coalesce(cnt, 0)), 6) as mean, round(quantile_cont(coalesce(cnt, 0), 0.5), 6) as median from spots cross join (select distinct gene from counts where gene in ('AF','NF','NO','RF')) g left join counts using (spot_id, gene) group by 1, 2",
    (SPOTS_SQL, COUNTS_SQL),
)
def q_cluster_mean_median(spark, sf):
    return measures.cluster_means(T.spots(spark, sf), T.counts(spark, sf), EX + CELL).select("cluster", "gene", r6("mean"), r6("median"))


@query("q_variable_genes", "select gene from counts group by gene having sum(cnt) * 1.0 / (select count(*) from spots) > 127", (SPOTS_SQL, COUNTS_SQL))
def q_variable_genes(spark, sf):
    return measures.variable_genes(T.spots(spark, sf), T.counts(spark, sf), 127)


@query("q_rescale", "select spot_id, round((x - min(x) over ()) * max(ex_sum) over () / (max(x) over () - min(x) over ()), 6) as x, round((y - min(y) over ()) * max(ex_sum) over () / (max(y) over () - min(y) over ()), 6) as y from scored", S1)
def q_rescale(spark, sf):
    return measures.rescaled(scored_spots(spark, sf), "ex_sum").select("spot_id", r6("x"), r6("y"))


@query("q_log_normalised", "select spot_id, gene, round(ln(1 + cnt / sum(cnt) over (partition by spot_id) * 1e4), 6) as value from counts", (COUNTS_SQL,))
def q_log_normalised(spark, sf):
    return T.log_normalised(T.counts(spark, sf)).select("spot_id", "gene", r6("value"))


# ------------------------------------------------------------------- spatial


@query("q_unit_distance", "select round(min(d) * 1.02, 6) as unit from edges where d > 0", (SPOTS_SQL, EDGES))
def q_unit_distance(spark, sf):
    return spark.range(1).select(F.round(F.lit(spatial.unit_distance(T.spots(spark, sf))), 6).alias("unit"))


@query("q_neighbors", "select src, dst, round(d, 6) as d from edges", (SPOTS_SQL, EDGES))
def q_neighbors(spark, sf):
    return edges(spark, sf).select("src", "dst", r6("d"))


@query("q_degree", "select src as spot_id, count(*) as degree from edges group by 1", (SPOTS_SQL, EDGES))
def q_degree(spark, sf):
    return edges(spark, sf).groupBy(F.col("src").alias("spot_id")).agg(F.count(F.lit(1)).alias("degree"))


@query("q_direction", "select src, dst, cast(round_even(degrees(atan2(dy, dx)), -1) as integer) as deg from edges", (SPOTS_SQL, EDGES))
def q_direction(spark, sf):
    return edges(spark, sf).select("src", "dst", spatial.direction(F.col("dx"), F.col("dy")).alias("deg"))


@query("q_slope_class", "select src as a, dst as b, case when dx <> 0 and dy / dx > 0 and dy / dx < 1 then 30 when dx <> 0 and dy / dx < 0 and dy / dx > -1 then 150 else 90 end as direction from edges where src < dst", (SPOTS_SQL, EDGES))
def q_slope_class(spark, sf):
    return spatial.slope_class(edges(spark, sf))


@query("q_lines_hex", ALL_LINES, (SPOTS_SQL, HEX_LINES))
def q_lines_hex(spark, sf):
    return hex_lines(spark, sf).select("direction", "line_id", "pos", "spot_id")


@query("q_lines_square", ALL_LINES, (SPOTS_SQL, SQUARE_LINES))
def q_lines_square(spark, sf):
    return spatial.lines(T.spots(spark, sf), 1.0, "square").select("direction", "line_id", "pos", "spot_id")


@query("q_gap_split", ALL_LINES, (*S1, GAP_LINES))
def q_gap_split(spark, sf):
    return spatial.lines(scored_spots(spark, sf).where("cell_sum >= 100"), 1.0, "hex", max_gap=3.5).select("direction", "line_id", "pos", "spot_id")


@query("q_line_margins", "select spot_id from margins", (SPOTS_SQL, HEX_LINES, MARGINS))
def q_line_margins(spark, sf):
    return spatial.line_margins(hex_lines(spark, sf))


@query("q_polygon_mask", polygon_sql(), (SPOTS_SQL,))
def q_polygon_mask(spark, sf):
    return spatial.in_polygon(T.spots(spark, sf), CORNERS).select("spot_id")


@query(
    "q_expand_region",
    """select spot_id, ring from rings where ring <= coalesce((select min(ring) from (select ring, sum(count(*)) over (order by ring) as c from rings group by ring) where c >= 3 * (select count(*) from region)), 1000000)""",
    (SPOTS_SQL, """
region as (select * from spots where (x - 8)*(x - 8) + (y - 8)*(y - 8) < 4),
middle as (select avg(x) as mx, avg(y) as my from region),
rings as (select spot_id, cast(greatest(1, ceil(round(sqrt((x-mx)*(x-mx) + (y-my)*(y-my)) - 1.4, 9))) as bigint) as ring
  from spots, middle where spot_id not in (select spot_id from region))"""),
)
def q_expand_region(spark, sf):
    s = T.spots(spark, sf)
    region = s.where("(x - 8)*(x - 8) + (y - 8)*(y - 8) < 4")
    return spatial.expanded_region(region, s, region, 1.0)


@query("q_with_self", "select src, dst, round(d, 6) as d from edges union all select spot_id, spot_id, 0.0 from spots", (SPOTS_SQL, EDGES))
def q_with_self(spark, sf):
    return spatial.with_self(T.spots(spark, sf), REACH).select("src", "dst", r6("d"))


@query(
    "q_neighbour_lines",
    "select direction, line_id, cast(row_number() over (partition by direction, line_id order by y, spot_id) as integer) as pos, spot_id from (select direction, spot_id, min(root) as line_id from walk group by 1, 2) join spots using (spot_id) qualify count(*) over (partition by direction, line_id) > 2",
    ("recursive " + SPOTS_SQL.lstrip(), EDGES, """
cls as (select src, dst, case when dx <> 0 and dy / dx > 0 and dy / dx < 1 then 30 when dx <> 0 and dy / dx < 0 and dy / dx > -1 then 150 else 90 end as direction from edges),
walk as (select distinct direction, src as spot_id, src as root from cls union select c.direction, c.dst, w.root from walk w join cls c on c.src = w.spot_id and c.direction = w.direction)"""),
)
def q_neighbour_lines(spark, sf):
    return spatial.neighbour_lines(T.spots(spark, sf), REACH, more_than=2)


# ------------------------------------------------------------ graph, regions

_FIELD = "sin(x / 3) * cos(y / 4) + 1e-7 * spot_id"


@query(
    "q_regions",
    """select region_id, spot_id from (select *, count(*) over (partition by region_id) as n from (select spot_id, min(root) as region_id from walk group by spot_id)) where n >= 10""",
    ("recursive " + SPOTS_SQL.lstrip(), EDGES, f"""
high as (select spot_id from spots where {_FIELD} > (select quantile_cont({_FIELD}, 0.9) from spots)),
inner_edges as (select src, dst from edges where src in (select spot_id from high) and dst in (select spot_id from high)),
walk as (select spot_id, spot_id as root from high union select e.dst, w.root from walk w join inner_edges e on e.src = w.spot_id)"""),
)
def q_regions(spark, sf):
    points = T.spots(spark, sf).withColumn("p", F.expr(_FIELD))
    return graph.regions(points, spatial.neighbours(points, REACH), "p").select("region_id", "spot_id")


@query("q_edge_weights", """select case when b.ex_sum >= a.ex_sum then src else dst end as src, case when b.ex_sum >= a.ex_sum then dst else src end as dst, round(any_value(d), 6) as d, any_value(abs(b.ex_sum - a.ex_sum)) as gap,
  round(any_value(0.5 * d + 2.0 * abs(b.ex_sum - a.ex_sum)), 6) as weight from edges join scored a on a.spot_id = src join scored b on b.spot_id = dst group by 1, 2""", S2)
def q_edge_weights(spark, sf):
    score = scored_spots(spark, sf).select("spot_id", F.col("ex_sum").alias("score"))
    return graph.weighted(edges(spark, sf), score, 0.5, 2.0).select("src", "dst", r6("d"), "gap", r6("weight"))


@query(
    "q_subclusters",
    """select distinct members from sets s where len(members) in (1, (select max(len(members)) from sets)) or not exists (select 1 from sets t where len(t.members) > len(s.members) and list_has_all(t.members, s.members))""",
    (*S2, """
sets as (select list_sort(list(distinct m)) as members from (select spot_id as n, spot_id as m from scored union all
  select src, dst from edges join scored a on a.spot_id = src join scored b on b.spot_id = dst where d < 1.2 and abs(a.ex_sum - b.ex_sum) < 40) group by n)"""),
)
def q_subclusters(spark, sf):
    scored = scored_spots(spark, sf).withColumn("pt", F.col("ex_sum"))
    return subclusters(scored, reach=1.2, gap=40.0).select("members")


# ------------------------------------------------------------------- series


@query("q_cp_groups", "select line_id, pos, cast(sum(case when y > 30 and pos > 1 then 1 else 0 end) over (partition by line_id order by pos) + 1 as bigint) as grp from series", (SERIES_SQL,))
def q_cp_groups(spark, sf):
    s = T.series(spark, sf).withColumn("cp", F.col("y") > 30)
    return segments.position_groups(s, "cp", "line_id").select("line_id", "pos", F.col("grp").cast("long").alias("grp"))


_SEGS = """
segs as (select line_id, k + 1 as seg_no, k * 10 + 1 as a, k * 10 + 10 as b from (select distinct line_id from series), range(0, 5) t(k))"""


@query("q_segment_slice", "select line_id, cast(seg_no as integer) as seg_no, count(*) as n, cast(sum(y) as bigint) as total from series join segs using (line_id) where pos between a and b group by 1, 2", (SERIES_SQL, _SEGS))
def q_segment_slice(spark, sf):
    s = T.series(spark, sf)
    k = F.explode(F.sequence(F.lit(0), F.lit(4)))
    segs = s.select("line_id").distinct().select("line_id", k.alias("k")).select("line_id", (F.col("k") + 1).alias("seg_no"), (F.col("k") * 10 + 1).alias("start"), (F.col("k") * 10 + 10).alias("end"))
    return segments.sliced(s, segs, ["line_id"]).groupBy("line_id", "seg_no").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


@query(
    "q_ari",
    """select line_id, round(case when (tt*tt - e) <> 0 then (tt*(a + d) - e) / (tt*tt - e) end, 6) as ari from (select *, (a+b)*(a+c) + (c+d)*(b+d) as e from (
  select p.line_id, count(*) * 1.0 as tt, sum(case when p.g = q.g and p.h = q.h then 1.0 else 0 end) as a, sum(case when p.g = q.g and p.h <> q.h then 1.0 else 0 end) as b,
  sum(case when p.g <> q.g and p.h = q.h then 1.0 else 0 end) as c, sum(case when p.g <> q.g and p.h <> q.h then 1.0 else 0 end) as d from lab p join lab q on p.line_id = q.line_id and p.pos < q.pos group by 1))""",
    (SERIES_SQL, """
lab as (select line_id, pos, pos // 20 as g, (pos + y % 7) // 20 as h from series)"""),
)
def q_ari(spark, sf):
    lab = T.series(spark, sf).select("line_id", F.expr("pos div 20").alias("g"), F.expr("(pos + y % 7) div 20").alias("h"))
    return rand_index(lab, "g", "h", ["line_id"]).select("line_id", r6("ari"))


@query("q_trend", "select line_id, count(*) as n, round(regr_slope(y, pos), 6) as beta, round(regr_r2(y, pos), 6) as r2 from series group by 1", (SERIES_SQL,))
def q_trend(spark, sf):
    return compare.trends(T.series(spark, sf), ["line_id"], "pos", "y").select("line_id", "n", r6("beta"), r6("r2"))


RANKS = """
ranks as (select line_id, rank() over (partition by line_id order by pos) + (count(*) over (partition by line_id, pos) - 1) / 2.0 as rx,
  rank() over (partition by line_id order by y) + (count(*) over (partition by line_id, y) - 1) / 2.0 as ry,
  rank() over (partition by line_id order by covar) + (count(*) over (partition by line_id, covar) - 1) / 2.0 as rz from series)"""


@query("q_spearman", "select line_id, count(*) as n, round(corr(rx, ry), 6) as rho from ranks group by 1", (SERIES_SQL, RANKS))
def q_spearman(spark, sf):
    return paths.rank_correlations(T.series(spark, sf), ["line_id"], "pos", "y", "covar").select("line_id", "n", r6("rho"))


@query("q_partial_spearman", "select line_id, round((a - b * c) / sqrt((1 - b*b) * (1 - c*c)), 6) as rho from (select line_id, corr(rx, ry) as a, corr(rx, rz) as b, corr(ry, rz) as c from ranks group by 1)", (SERIES_SQL, RANKS))
def q_partial_spearman(spark, sf):
    return paths.rank_correlations(T.series(spark, sf), ["line_id"], "pos", "y", "covar").select("line_id", r6("rho_partial", "rho"))


@query("q_average_rank", "select line_id, pos, ry from (select line_id, pos, rank() over (partition by line_id order by y) + (count(*) over (partition by line_id, y) - 1) / 2.0 as ry from series)", (SERIES_SQL,))
def q_average_rank(spark, sf):
    return T.series(spark, sf).select("line_id", "pos", average_rank("y", ["line_id"]).alias("ry"))


@query("q_path_deltas", "select line_id, pos, y - lag(y) over w as d_y, round(covar - lag(covar) over w, 6) as d_covar from series window w as (partition by line_id order by pos) qualify pos > 1", (SERIES_SQL,))
def q_path_deltas(spark, sf):
    s = T.series(spark, sf)
    points = s.select("line_id", "pos", F.struct("line_id", "pos").alias("node"))
    found = paths.steps(points, s.select(F.struct("line_id", "pos").alias("node"), "y", "covar"), ["y", "covar"], by="line_id")
    return found.select("line_id", "pos", "d_y", r6("d_covar"))


# --------------------------------------------------------------------- spins


@query("q_energy", "select count(*) / 2 as n_pairs, sum(a.s * b.s) / 2 as spin_sum, round(sum(a.s * b.s) * 1.0 / count(*), 6) as net_agreement from edges join states a on a.spot_id = src join states b on b.spot_id = dst", S2)
def q_energy(spark, sf):
    return spins.energy(edges(spark, sf), states(spark, sf)).select("n_pairs", "spin_sum", r6("net_agreement"))


@query("q_flip_prob", "select t, round(1 / (1 + exp(-2 * 0.3 * t)), 6) as p from (select distinct cast(t as bigint) as t from (select sum(s) as t from edges join states on spot_id = dst group by src))", S2)
def q_flip_prob(spark, sf):
    t = edges(spark, sf).join(states(spark, sf).withColumnRenamed("spot_id", "dst"), "dst").groupBy("src").agg(F.sum("s").alias("t")).select("t").distinct()
    return t.select("t", r6(spins.flip_probability(0.3, F.col("t")), "p"))


@query("q_endpoints", "select spot_id, cast(direction as integer) as direction from ends", (SPOTS_SQL, HEX_LINES, LINE_SEGS))
def q_endpoints(spark, sf):
    return spins.segment_ends(line_segments(spark, sf))


_STEEP = """
seg_slopes as (select direction, line_id, seg_no, regr_slope(ex_sum, pos) as slope from line_segs join scored using (spot_id) group by 1, 2, 3),
steep as (select distinct spot_id, direction - o as direction from line_segs join seg_slopes using (direction, line_id, seg_no), (values (0, 1), (180, -1)) t(o, f) where round(slope * f, 9) <= -0.01)"""


def segment_slopes(spark, sf, segs=None):
    """``spot_id, direction, slope``: the least-squares slope of a spot's stretch of eight."""
    points = (segs or line_segments(spark, sf)).join(scored_spots(spark, sf).select("spot_id", "ex_sum"), "spot_id")
    by = ["direction", "line_id", "seg_no"]
    fit = points.groupBy(*by).agg(F.round(F.regr_slope("ex_sum", "pos"), 9).alias("slope"))
    return points.join(fit, by).select("spot_id", "direction", "slope")


@query("q_steep", "select spot_id, direction from steep", (*S1, HEX_LINES, LINE_SEGS, _STEEP))
def q_steep(spark, sf):
    return spins.steep_spots(segment_slopes(spark, sf)).distinct()


_MET = """
dir_edges as (select src, dst, cast(round_even(degrees(atan2(dy, dx)), -1) as integer) as direction from edges),
inner_ends as (select * from ends where spot_id not in (select spot_id from margins)),
met as (select e.* from dir_edges e join inner_ends n on n.spot_id = e.src and n.direction = e.direction join steep s on s.spot_id = e.dst and s.direction = e.direction
  where not exists (select 1 from inner_ends o where o.spot_id = e.dst and o.direction = e.direction))"""


def bonus_and_regular(spark, sf):
    """Bonus of segment ends, and the edges that stay regular."""
    segs = T.written(line_segments(spark, sf))
    directed = T.written(edges(spark, sf).select("src", "dst", spatial.direction(F.col("dx"), F.col("dy")).alias("direction")))
    return spins.end_bonus(spins.segment_ends(segs), directed, spins.steep_spots(segment_slopes(spark, sf, segs)), spatial.line_margins(segs))


@query(
    "q_bonus",
    "select dst as spot_id, count(*) as n_add from met group by 1",
    (*S1, EDGES, HEX_LINES, MARGINS, LINE_SEGS, _STEEP, _MET),
)
def q_bonus(spark, sf):
    return bonus_and_regular(spark, sf)[0]


@query(
    "q_cond_prob",
    """select s.spot_id, round(1 / (1 + exp(-0.3 * (coalesce(t, 0) + 2.0 * coalesce(n_add, 0)))), 6) as p from states s left join (select src, sum(s) as t from regular join states on spot_id = dst group by 1) r on src = s.spot_id
  left join (select dst as spot_id, count(*) as n_add from met group by 1) b on b.spot_id = s.spot_id""",
    (*S2, HEX_LINES, MARGINS, LINE_SEGS, _STEEP, _MET, """
regular as (select src, dst from edges e where not exists (select 1 from met m where m.src = e.dst and m.dst = e.src))"""),
)
def q_cond_prob(spark, sf):
    """Given neighbours and bonus: ends that gave a bonus are no regular neighbours of the spot."""
    bonus, regular = bonus_and_regular(spark, sf)
    bonus = bonus.withColumn("n_add", 2.0 * F.col("n_add"))
    return spins.conditional(regular, states(spark, sf), bonus, 0.3).select("spot_id", r6("p"))


# --------------------------------------------------------------------- paths


@query("q_path_mode", "select path_id, cluster from (select path_id, cluster, row_number() over (partition by path_id order by count(*) desc, cluster) as k from paths join spots on spot_id = node group by 1, 2) where k = 1", (SPOTS_SQL, PATHS_SQL))
def q_path_mode(spark, sf):
    joined = T.order_paths(spark, sf).join(T.spots(spark, sf).withColumnRenamed("spot_id", "node"), "node")
    return measures.most_common(joined, ["path_id"], "cluster", "cluster")


@query("q_path_overlap", "select a.path_id as a, b.path_id as b, count(*) as shared from paths a join paths b on a.node = b.node and a.path_id < b.path_id group by 1, 2 having count(*) > 1", (PATHS_SQL,))
def q_path_overlap(spark, sf):
    return paths.overlaps(T.order_paths(spark, sf), 1)


@query(
    "q_path_containment",
    "select distinct a as path_id from (select a.path_id as a, b.path_id as b, count(*) as s from paths a join paths b on a.node = b.node and a.path_id <> b.path_id group by 1, 2) join sz x on x.path_id = a join sz y on y.path_id = b where s = x.n and (y.n > x.n or b < a)",
    (PATHS_SQL, "\nsz as (select path_id, count(*) as n from paths group by 1)"),
)
def q_path_containment(spark, sf):
    return paths.contained(T.order_paths(spark, sf))


MEANS = """
means as (select path_id, gene, sum(coalesce(cnt, 0)) * 1.0 / count(*) as mean from paths cross join (values ('AF'), ('NO'), ('RF')) g(gene) left join counts on spot_id = node and counts.gene = g.gene group by 1, 2)"""


def path_means(spark, sf):
    return paths.gene_means(T.order_paths(spark, sf), T.counts(spark, sf), ["AF", "NO", "RF"], ["path_id"], T.table(spark, sf, "lineitem").count())


@query("q_path_gene_mean", "select path_id, g as gene, round(m, 6) as mean from (select path_id, gene as g, mean as m from means)", (COUNTS_SQL, PATHS_SQL, MEANS.replace("select path_id, gene, sum", "select path_id, g.gene as gene, sum")))
def q_path_gene_mean(spark, sf):
    return path_means(spark, sf).select("path_id", "gene", r6("mean"))


_EMP = (COUNTS_SQL, PATHS_SQL, URGENT, MEANS.replace("select path_id, gene, sum", "select path_id, g.gene as gene, sum"), """
obs as (select gene, avg(mean) as obs from means join kinds using (path_id) where "real" group by 1),
ctl as (select month as set_id, gene, avg(mean) as ctl from means join kinds using (path_id) where not "real" group by 1, 2),
emp as (select gene, obs, avg(case when ctl >= obs then 1.0 else 0.0 end) as p, obs / avg(ctl) as fold from ctl join obs using (gene) group by 1, 2)""")


def _sets(spark, sf):
    """(observed means of the urgent orders' paths, means of the control sets: the other orders of a month)."""
    means = path_means(spark, sf).join(urgent(spark, sf), "path_id")
    obs = means.where("real").groupBy("gene").agg(F.avg("mean").alias("obs"))
    return obs, means.where("not real").groupBy(F.col("month").alias("set_id"), "gene").agg(F.avg("mean").alias("ctl"))


def _empirical(spark, sf):
    return paths.empirical(*_sets(spark, sf))


@query("q_gene_mean_sets", "select set_id, gene, round(ctl, 6) as ctl from ctl", _EMP)
def q_gene_mean_sets(spark, sf):
    return _sets(spark, sf)[1].select("set_id", "gene", r6("ctl"))


@query("q_empirical_p", "select gene, round(p, 6) as p from emp", _EMP)
def q_empirical_p(spark, sf):
    return _empirical(spark, sf).select("gene", r6("p"))


@query("q_fold_change", "select gene, round(obs, 6) as obs, round(fold, 6) as fold from emp", _EMP)
def q_fold_change(spark, sf):
    return _empirical(spark, sf).select("gene", r6("obs"), r6("fold"))


@query("q_volcano_class", "select gene, case when abs(log2(fold)) > log2(1.5) and (case when p = 0 then 0.001 else p end) <= 0.05 then 2 when abs(log2(fold)) > log2(1.5) or (case when p = 0 then 0.001 else p end) <= 0.05 then 3 else 1 end as cls from emp", _EMP)
def q_volcano_class(spark, sf):
    return compare.significance(_empirical(spark, sf), "fold", "p").select("gene", "cls")


@query(
    "q_volcano",
    """select gene, round(fold, 6) as fold, round(raw_p, 6) as raw_p, round(p_adj, 6) as p_adj, round(-log10(q), 6) as strength, round(log2(fold), 6) as log_fc,
  case when fold > 1 and p_adj < 0.1 then 'up' when fold < 1 and p_adj < 0.1 then 'down' end as way,
  case when abs(log2(fold)) > log2(1.5) and q <= 0.05 then 2 when abs(log2(fold)) > log2(1.5) or q <= 0.05 then 3 else 1 end as cls
  from (select *, case when p_adj = 0 then 0.001 else p_adj end as q from adj)""",
    (*_EMP, """
raw as (select gene, fold, case when fold <= 1 then 1 - p else p end as raw_p from (select gene, avg(case when ctl > obs then 1.0 else 0.0 end) as p, obs / avg(ctl) as fold from ctl join obs using (gene) group by gene, obs)),
adj as (select *, least(1.0, min(raw_p * n / rk) over (order by rk desc rows unbounded preceding)) as p_adj from (select *, count(*) over () as n, row_number() over (order by raw_p, gene) as rk from raw))"""),
)
def q_volcano(spark, sf):
    found = compare.volcano(*_sets(spark, sf))
    return found.select("gene", *[r6(c) for c in ("fold", "raw_p", "p_adj", "strength", "log_fc")], "way", "cls")


@query("q_complement", "select spot_id from spots where spot_id not in (select node from paths where path_id in (select path_id from paths group by 1 having count(*) > 7))", (SPOTS_SQL, PATHS_SQL))
def q_complement(spark, sf):
    p = T.order_paths(spark, sf)
    long = p.groupBy("path_id").agg(F.count(F.lit(1)).alias("n")).where("n > 7").select("path_id")
    on = p.join(long, "path_id", "left_semi").select(F.col("node").alias("spot_id")).distinct()
    return T.spots(spark, sf).join(on, "spot_id", "left_anti").select("spot_id")


@query("q_point_line_dist", "select spot_id, round(sqrt((x - 2 - 3*t)*(x - 2 - 3*t) + (y - 1 - 4*t)*(y - 1 - 4*t) + (ex_sum - 5 - 12*t)*(ex_sum - 5 - 12*t)), 6) as d from (select *, ((x - 2)*3 + (y - 1)*4 + (ex_sum - 5)*12) / 169.0 as t from scored)", S1)
def q_point_line_dist(spark, sf):
    lits = lambda *v: tuple(F.lit(float(x)) for x in v)
    p = F.col("x"), F.col("y"), F.col("ex_sum").cast("double")
    return scored_spots(spark, sf).select("spot_id", r6(paths.point_line_distance(p, lits(2, 1, 5), lits(5, 5, 17)), "d"))


_PAIRS = "select a.vec_id as a, b.vec_id as b"


@query("q_pair_cor", f"select a, b, round(r, 6) as r from ({_PAIRS}, (select corr(u, v) from (select unnest(cast(a.embedding as double[])) as u, unnest(cast(b.embedding as double[])) as v)) as r from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)")
def q_pair_cor(spark, sf):
    e = T.table(spark, sf, "embeddings")
    return paths.pair_correlations(e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")), e).select("a", "b", r6("r"))


# ----------------------------------------------------------- gene comparison

_WELCH = (SPOTS_SQL, COUNTS_SQL, """
vals as (select s.spot_id, g.gene, case when p_size <= 25 then 0 else 1 end as grp, coalesce(cnt, 0) as v from spots s cross join (select distinct gene from counts) g left join counts c on c.spot_id = s.spot_id and c.gene = g.gene),
mom as (select gene, avg(case when grp = 0 then v end) as m0, avg(case when grp = 1 then v end) as m1, var_samp(case when grp = 0 then v end) as v0, var_samp(case when grp = 1 then v end) as v1, count(case when grp = 0 then v end) as n0, count(case when grp = 1 then v end) as n1 from vals group by 1)""")


def size_groups(spark, sf):
    """``spot_id, grp``: spots of small (0) and large (1) parts."""
    return T.spots(spark, sf).select("spot_id", (F.col("p_size") > 25).cast("int").alias("grp"))


@query("q_welch", "select gene, round((m0 - m1) / sqrt(v0/n0 + v1/n1), 6) as t, round((v0/n0 + v1/n1)*(v0/n0 + v1/n1) / ((v0/n0)*(v0/n0)/(n0-1) + (v1/n1)*(v1/n1)/(n1-1)), 4) as df, round(log2(m1 / m0), 6) as log_fc from mom", _WELCH)
def q_welch(spark, sf):
    return compare.welch_by_gene(T.counts(spark, sf), size_groups(spark, sf), "cnt").select("gene", r6("t"), F.round("df", 4).alias("df"), r6("log_fc"))


def _pvalues(spark, sf):
    return T.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 10000.0).alias("p"))


_ADJ = "select k, round(least(1.0, min(p * n / rk) over (order by rk desc rows unbounded preceding){f}), 6) as p_adj from (select k, p, count(*) over () as n, row_number() over (order by p, k) as rk from (select c_custkey as k, c_acctbal / 10000.0 as p from customer where c_acctbal > 0))"


@query("q_bh", _ADJ.format(f=""))
def q_bh(spark, sf):
    return adjusted(_pvalues(spark, sf), "p", "k").select("k", r6("p_adj"))


@query("q_by", _ADJ.format(f=" * (select sum(1.0 / i) from range(1, (select count(*) + 1 from customer where c_acctbal > 0)) t(i))"))
def q_by(spark, sf):
    return adjusted(_pvalues(spark, sf), "p", "k", "BY").select("k", r6("p_adj"))


@query("q_cluster_rank", "select cluster, round(avg(greatest(r, 3.0)), 6) as mean_rank from (select cluster, gene, rank() over (partition by gene order by m) + (count(*) over (partition by gene, m) - 1) / 2.0 as r from (select cluster, g.gene as gene, avg(coalesce(cnt, 0)) as m from spots s cross join (select distinct gene from counts) g left join counts c on c.spot_id = s.spot_id and c.gene = g.gene group by 1, 2)) group by 1", (SPOTS_SQL, COUNTS_SQL))
def q_cluster_rank(spark, sf):
    return compare.cluster_ranks(measures.cluster_means(T.spots(spark, sf), T.counts(spark, sf), GENES), 3.0).select("cluster", r6("mean_rank"))


@query("q_five_numbers", "select cluster, quantile_cont(ex_sum, 0) as low, quantile_cont(ex_sum, 0.25) as q1, quantile_cont(ex_sum, 0.5) as mid, quantile_cont(ex_sum, 0.75) as q3, quantile_cont(ex_sum, 1) as high from scored group by 1", S1)
def q_five_numbers(spark, sf):
    return compare.five_numbers(scored_spots(spark, sf), ["cluster"], "ex_sum")


@query("q_colour_bins", "select spot_id, round(x, 6) as x, round(y, 6) as y, ex_sum as value, cast(least(floor((ex_sum - min(ex_sum) over ()) * 1.0 / (max(ex_sum) over () - min(ex_sum) over ()) * 100) + 1, 100) as integer) as bin from scored", S1)
def q_colour_bins(spark, sf):
    return compare.colour_bins(scored_spots(spark, sf), "ex_sum").select("spot_id", r6("x"), r6("y"), "value", "bin")


@query("q_welch_cpm", "select gene, round((m0 - m1) / sqrt(v0/n0 + v1/n1), 6) as t, round(log2(m1 / m0), 6) as log_fc from mom", (SPOTS_SQL, COUNTS_SQL, """
cpm as (select spot_id, gene, cnt / sum(cnt) over (partition by spot_id) * 1e6 as cpm from counts)""", _WELCH[2].replace("coalesce(cnt, 0)", "coalesce(cpm, 0)").replace("left join counts c", "left join cpm c")))
def q_welch_cpm(spark, sf):
    return compare.welch_by_gene(measures.per_million(T.counts(spark, sf)), size_groups(spark, sf), "cpm").select("gene", r6("t"), r6("log_fc"))


@query("q_compare_rest", "select gene, round(m0, 6) as mean_region, round(m1, 6) as mean_other, round((m0 - m1) / sqrt(v0/n0 + v1/n1), 6) as t, round(log2(m0 / m1), 6) as log_fc from mom", _WELCH)
def q_compare_rest(spark, sf):
    region = size_groups(spark, sf).where("grp = 0")
    found = compare.compared_with_rest(T.counts(spark, sf), T.spots(spark, sf), region, "cnt", cut=100.0, p_cut=2.0)
    return found.select("gene", r6("mean_region"), r6("mean_other"), r6("t"), r6("log_fc"))


@query(
    "q_paths_vs_spots",
    """select gene, round(m0, 6) as mean_paths, round(m1, 6) as mean_spots, round((m0 - m1) / sqrt(v0/n0 + v1/n1), 6) as t from
  (select gene, count(*) as n0, avg(mean) as m0, var_samp(mean) as v0 from means group by 1) join
  (select g.gene as gene, count(*) as n1, avg(coalesce(cnt, 0)) as m1, var_samp(coalesce(cnt, 0)) as v1 from spots cross join (values ('AF'), ('NO'), ('RF')) g(gene) left join counts c on c.spot_id = spots.spot_id and c.gene = g.gene group by 1) using (gene)""",
    (SPOTS_SQL, COUNTS_SQL, PATHS_SQL, MEANS.replace("select path_id, gene, sum", "select path_id, g.gene as gene, sum")),
)
def q_paths_vs_spots(spark, sf):
    found = compare.compared_with_spots(path_means(spark, sf), T.counts(spark, sf), T.spots(spark, sf), "cnt")
    return found.select("gene", r6("mean_paths"), r6("mean_spots"), r6("t"))


_LEVEL = """
level as (select spot_id, cell_sum as z from scored),
full_counts as (select s.spot_id, g.gene, coalesce(cnt, 0) as v, z from level s cross join (select distinct gene from counts) g left join counts c on c.spot_id = s.spot_id and c.gene = g.gene)"""


@query("q_marker_link", "select gene, round(corr(v, z), 6) as r from full_counts group by 1", (*S1, _LEVEL))
def q_marker_link(spark, sf):
    return compare.marker_linked(T.counts(spark, sf), T.spots(spark, sf), CELL, "cnt").select("gene", r6("r"))


@query("q_marker_cor", """select gene, n, round(rho, 6) as rho, round(rho * sqrt((n - 2) / (1 - rho * rho)), 5) as t from (select gene, count(*) as n, corr(rv, rz) as rho from
  (select gene, rank() over (partition by gene order by v) + (count(*) over (partition by gene, v) - 1) / 2.0 as rv, rank() over (partition by gene order by z) + (count(*) over (partition by gene, z) - 1) / 2.0 as rz from full_counts) group by 1)""", (*S1, _LEVEL))
def q_marker_cor(spark, sf):
    return compare.marker_correlations(T.counts(spark, sf), T.spots(spark, sf), CELL, "cnt").select("gene", "n", r6("rho"), F.round("t", 5).alias("t"))


@query(
    "q_enriched",
    """select gene, top.cluster as cluster, round(mean_rank, 6) as mean_rank, round((sum(case when m.cluster = top.cluster then s end) / sum(case when m.cluster = top.cluster then n end)) / (sum(case when m.cluster <> top.cluster then s end) / sum(case when m.cluster <> top.cluster then n end)), 6) as fold
  from m, top group by 1, 2, 3""",
    (SPOTS_SQL, COUNTS_SQL, """
m as (select cluster, g.gene as gene, sum(coalesce(cnt, 0)) * 1.0 as s, count(*) * 1.0 as n from spots s cross join (select distinct gene from counts) g left join counts c on c.spot_id = s.spot_id and c.gene = g.gene group by 1, 2),
top as (select cluster, mean_rank from (select cluster, avg(greatest(r, 3.0)) as mean_rank from (select cluster, rank() over (partition by gene order by s / n) + (count(*) over (partition by gene, s / n) - 1) / 2.0 as r from m) group by 1) order by mean_rank desc, cluster limit 1)"""),
)
def q_enriched(spark, sf):
    return compare.enriched(T.counts(spark, sf), T.spots(spark, sf), floor=3.0).select("gene", "cluster", r6("mean_rank"), r6("fold"))


_LONG = """
long as (select path_id, pos as x, ex_sum as ex_score, g.gene as gene, coalesce(cnt, 0) as value, case when "real" then 1 else 0 end as trt
  from paths join kinds using (path_id) join scored on scored.spot_id = node cross join (values ('AF'), ('AO'), ('RO')) g(gene) left join counts c on c.spot_id = node and c.gene = g.gene)"""
_LONG_CTES = (*S1, PATHS_SQL, URGENT, _LONG)


def long_values(spark, sf):
    """Long table of all order paths; urgent orders are the treated ones."""
    s, kinds = scored_spots(spark, sf).withColumn("ex_score", F.col("ex_sum")), urgent(spark, sf)
    own = T.order_paths(spark, sf).join(kinds.where("real is not null").select("path_id", F.col("real").cast("int").alias("own")), "path_id")
    return paths.long_values(own, s, T.counts(spark, sf), ["AF", "AO", "RO"], "own")


@query("q_long_values", "select path_id, x, ex_score, gene, value, trt from long", _LONG_CTES)
def q_long_values(spark, sf):
    return long_values(spark, sf)


@query("q_linear_trends", "select gene, count(*) as n, round(regr_slope(value, x), 6) as beta, round(regr_r2(value, x), 6) as r2, round(sign(regr_slope(value, x)) * sqrt(regr_r2(value, x) * (count(*) - 2) / (1 - regr_r2(value, x))), 5) as t from long group by 1", _LONG_CTES)
def q_linear_trends(spark, sf):
    return compare.linear_trends(long_values(spark, sf)).select("gene", "n", r6("beta"), r6("r2"), F.round("t", 5).alias("t"))


@query(
    "q_subcluster_nodes",
    """select node, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(ex_sum), 6) as pt, first(mode) as cluster from (select node, unnest(members) as spot_id from kept) join scored using (spot_id)
  join (select node, cluster as mode from (select node, cluster, row_number() over (partition by node order by count(*) desc, cluster) as k from (select node, unnest(members) as spot_id from kept) join spots using (spot_id) group by 1, 2) where k = 1) using (node) group by 1""",
    (*S2, """
sets as (select members, min(n) as node from (select list_sort(list(distinct m)) as members, n from (select spot_id as n, spot_id as m from scored union all
  select src, dst from edges join scored a on a.spot_id = src join scored b on b.spot_id = dst where d < 1.2 and abs(a.ex_sum - b.ex_sum) < 40) group by n) group by 1),
kept as (select * from sets s where len(members) in (1, (select max(len(members)) from sets)) or not exists (select 1 from sets t where len(t.members) > len(s.members) and list_has_all(t.members, s.members)))"""),
)
def q_subcluster_nodes(spark, sf):
    scored = T.written(scored_spots(spark, sf).withColumn("pt", F.col("ex_sum")))
    found = subcluster_nodes(subclusters(scored, reach=1.2, gap=40.0), scored)
    return found.select("node", r6("x"), r6("y"), r6("pt"), "cluster")


@query(
    "q_prepared_nodes",
    """select spot_id as node, round((x - x0) * s / (x1 - x0), 6) as x, round((y - y0) * s / (y1 - y0), 6) as y, round(score, 6) as pt, cluster
  from (select *, min(x) over () as x0, max(x) over () as x1, min(y) over () as y0, max(y) over () as y1, max(score) over () as s from (select spot_id, x, y, cluster, cell_sum, r + abs(min(r) over ()) as score from res join scored using (spot_id, cluster))) where cell_sum >= 100""",
    (*S1, RESID),
)
def q_prepared_nodes(spark, sf):
    found = measures.prepared(T.spots(spark, sf), T.counts(spark, sf), EX, CELL, least=100)["nodes"]
    return found.select("node", r6("x"), r6("y"), r6("pt"), "cluster")


# ------------------------------------------------------------------ segments

_ALPHAS = [0.1 * k for k in range(1, 11)]


@query(
    "q_stretch_costs",
    """select a.line_id, cast(a.pos as integer) as "start", cast(b.pos as integer) as "end", alpha, round(b.q - a.q + a.y*a.y - (b.s - a.s + a.y)*(b.s - a.s + a.y) / (b.pos - a.pos + 1), 5) as neg2llh,
  round(b.q - a.q + a.y*a.y - (b.s - a.s + a.y)*(b.s - a.s + a.y) / (b.pos - a.pos + 1) + 6 * alpha, 5) as cost from run a join run b on a.line_id = b.line_id and b.pos > a.pos, (values (0.5::double), (1.0::double)) t(alpha)""",
    (SERIES_SQL, """
run as (select line_id, pos, y * 1.0 as y, sum(y * 1.0) over w as s, sum(y * 1.0 * y) over w as q from series window w as (partition by line_id order by pos))"""),
)
def q_stretch_costs(spark, sf):
    found = segments.stretch_costs(T.series(spark, sf), [0.5, 1.0], ["line_id"], method="gaussian")
    return found.select("line_id", "start", "end", "alpha", F.round("neg2llh", 5).alias("neg2llh"), F.round("cost", 5).alias("cost"))


@query("q_pelt")
def q_pelt(spark, sf):
    return segments.segmented(T.series(spark, sf), _ALPHAS, ["line_id"], method="gaussian").withColumn("total_cost", F.round("total_cost", 6))


@query(
    "q_pelt_cost",
    """select alpha, line_id, round(f[len(f)], 5) as total_cost from dp where k = n""",
    ("recursive " + SERIES_SQL.lstrip(), """
arr as (select line_id, count(*) as n, list(s order by pos) as s, list(q order by pos) as q from (select line_id, pos, sum(y * 1.0) over w as s, sum(y * 1.0 * y) over w as q from series window w as (partition by line_id order by pos)) group by 1),
dp as (select line_id, n, s, q, alpha, cast(1 as bigint) as k, [0.0::double, 1e300::double] as f, [1::bigint] as r from arr, (values (0.1::double), (1.0::double), (50.0::double)) t(alpha) where n >= 4
  union all select line_id, n, s, q, alpha, k + 1, list_append(f, best), case when k + 1 >= 5 then list_filter(rr, lambda a: a = 1 or f[a] + (q[k + 1] - (case when a = 1 then 0 else q[a - 1] end) - (s[k + 1] - (case when a = 1 then 0 else s[a - 1] end)) * (s[k + 1] - (case when a = 1 then 0 else s[a - 1] end)) / (k + 2 - a)) < best) else rr end
  from (select *, (6 * alpha + list_min(list_transform(rr, lambda a: f[a] + (q[k + 1] - (case when a = 1 then 0 else q[a - 1] end) - (s[k + 1] - (case when a = 1 then 0 else s[a - 1] end)) * (s[k + 1] - (case when a = 1 then 0 else s[a - 1] end)) / (k + 2 - a)))))::double as best from (select *, case when k + 1 > 3 then list_append(r, k) else r end as rr from dp where k < n)))"""),
)
def q_pelt_cost(spark, sf):
    found = segments.segmented(T.series(spark, sf), [0.1, 1.0, 50.0], ["line_id"], method="gaussian")
    return found.groupBy("alpha", "line_id").agg(F.round(F.max("total_cost"), 5).alias("total_cost"))


@query("q_segment_summary", "select cast(1.0 as double) as alpha, direction, line_id, count(*) - 1 as n_changes, list(l order by seg_no) as lengths from (select direction, line_id, seg_no, cast(count(*) as integer) as l from line_segs group by 1, 2, 3) group by 1, 2, 3", (SPOTS_SQL, HEX_LINES, LINE_SEGS))
def q_segment_summary(spark, sf):
    segs = line_segments(spark, sf).groupBy("direction", "line_id", "seg_no").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).withColumn("alpha", F.lit(1.0))
    return segments.segment_summary(segs, ["direction", "line_id"])


@query("q_spot_slopes", """select spot_id, round(max(case when direction = 30 then slope end), 6) as slope_30, round(max(case when direction = 90 then slope end), 6) as slope_90, round(max(case when direction = 150 then slope end), 6) as slope_150,
  round(max(case when direction = 30 then m end), 6) as mean_30, round(max(case when direction = 90 then m end), 6) as mean_90, round(max(case when direction = 150 then m end), 6) as mean_150
  from line_segs join (select direction, line_id, seg_no, regr_slope(ex_sum, pos) as slope, avg(cell_sum) as m from line_segs join scored using (spot_id) group by 1, 2, 3) using (direction, line_id, seg_no) group by 1""", (*S1, HEX_LINES, LINE_SEGS))
def q_spot_slopes(spark, sf):
    by = ["direction", "line_id", "seg_no"]
    points = T.written(line_segments(spark, sf).join(scored_spots(spark, sf).select("spot_id", "ex_sum", "cell_sum"), "spot_id"))
    found = points.groupBy(*by).agg(F.regr_slope("ex_sum", "pos").alias("slope"), F.avg("cell_sum").alias("mean_resid"))
    wide = segments.spot_slopes(points, found, by)
    return wide.select("spot_id", *[r6(c) for c in wide.columns if c != "spot_id"])


@query(
    "q_ari_methods",
    """select method, line_id, round(case when (tt*tt - e) <> 0 then (tt*(a + d) - e) / (tt*tt - e) end, 6) as ari from (select *, (a+b)*(a+c) + (c+d)*(b+d) as e from (
  select p.method, p.line_id, count(*) * 1.0 as tt, sum(case when p.g = q.g and p.h = q.h then 1.0 else 0 end) as a, sum(case when p.g = q.g and p.h <> q.h then 1.0 else 0 end) as b,
  sum(case when p.g <> q.g and p.h = q.h then 1.0 else 0 end) as c, sum(case when p.g <> q.g and p.h <> q.h then 1.0 else 0 end) as d from lab p join lab q on p.line_id = q.line_id and p.method = q.method and p.pos < q.pos group by 1, 2))""",
    (SERIES_SQL, """
lab as (select case when w = 10 then 'tens' else 'fifteens' end as method, line_id, pos, (pos - 1) // 20 as g, (pos - 1) // w as h from series, (values (10), (15)) t(w))"""),
)
def q_ari_methods(spark, sf):
    s = T.series(spark, sf)
    truth = s.select("line_id", "pos", F.expr("(pos - 1) div 20").alias("segment"))
    cut = lambda w, name: s.groupBy("line_id", F.expr(f"(pos - 1) div {w}").alias("seg_no")).agg(F.min("pos").alias("start"), F.max("pos").alias("end")).withColumn("method", F.lit(name))
    return segments.agreement(truth, cut(10, "tens").unionByName(cut(15, "fifteens")), ["line_id"]).select("method", "line_id", r6("ari"))


# ------------------------------------------------ kernels (no SQL equivalent)


def line_counts(spark, sf):
    """Points of the lattice lines with exhaustion and surface sums."""
    sums = scored_spots(spark, sf).select("spot_id", F.col("ex_sum").alias("y"), F.col("cell_sum").alias("covar"))
    return hex_lines(spark, sf).drop("x", "y").join(sums, "spot_id")


@query("q_nb_segments")
def q_nb_segments(spark, sf):
    found = segments.segmented(line_counts(spark, sf), _ALPHAS, ["direction", "line_id"], ["covar"])
    return found.withColumn("total_cost", F.round("total_cost", 4))


@query("q_nb_estimates")
def q_nb_estimates(spark, sf):
    found = segments.estimates(line_counts(spark, sf), ["direction", "line_id"], ["covar"])
    rounded = lambda c: F.transform(c, lambda v: F.round(v, 4)).alias(c)
    return found.select("direction", "line_id", "method", "status", rounded("beta"), F.round("size", 4).alias("size"), F.round("llh", 4).alias("llh"), rounded("low"), rounded("high"))


@query("q_adjusted_counts")
def q_adjusted_counts(spark, sf):
    return measures.adjusted_counts(T.spots(spark, sf), T.counts(spark, sf), EX).select("spot_id", r6("resid"))


@query("q_count_score")
def q_count_score(spark, sf):
    return measures.count_residual_score(scored_spots(spark, sf), "ex_sum", "cell_sum", "ex_score_nb").select("spot_id", r6("ex_score_nb"))


@query("q_region_spots")
def q_region_spots(spark, sf):
    """All spots with both scores, as region detection starts from them."""
    found = measures.region_prepared(T.spots(spark, sf), T.counts(spark, sf), EX, CELL)
    return found["spots"].select("spot_id", "ex_sum", "cell_sum", r6("ex_score"), r6("ex_score_nb"), F.round(F.lit(found["unit"]), 6).alias("unit"))


@query("q_matrix_counts", "select cast(spot_id as varchar) as spot_id, gene, cnt from counts where cnt <> 0", (COUNTS_SQL,))
def q_matrix_counts(spark, sf):
    """The counts after a way through MatrixMarket triplets with their two lists."""
    folder = f"{T.shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    matrix.save_matrix(T.counts(spark, sf), folder)
    return matrix.read_matrix(spark, *[f"{folder}/{n}" for n in ("matrix.mtx", "barcodes.tsv", "features.tsv")])


@query("q_stabilised")
def q_stabilised(spark, sf):
    """Residuals, corrected counts and their logarithms of all counts present."""
    c = T.counts(spark, sf)
    return stabilise.corrected(c, stabilise.stabiliser(c)).select("spot_id", "gene", F.round("residual", 5).alias("residual"), "cnt", r6("value"))


@query("q_graph_clusters")
def q_graph_clusters(spark, sf):
    """Clusters of all spots on the neighbour graph of their residuals."""
    c = T.counts(spark, sf)
    vectors = stabilise.residual_vectors(c, stabilise.stabiliser(c), GENES).withColumnRenamed("spot_id", "id")
    graph_ = communities.shared_neighbours(communities.nearest(vectors, 20))
    return communities.graph_clusters(graph_, vectors.select("id"), resolution=0.3).withColumnRenamed("id", "spot_id")


@query("q_slopes")
def q_slopes(spark, sf):
    by = ["direction", "line_id", "seg_no"]
    sums = scored_spots(spark, sf).select("spot_id", F.col("ex_sum").alias("y"), F.col("cell_sum").alias("covar"))
    points = T.written(line_segments(spark, sf).drop("x", "y").join(measures.count_residual_score(sums, "y", "covar", "resid"), "spot_id"))
    found = segments.slopes(points, by, ["covar"])
    return found.select(*by, "n", F.round("slope", 5).alias("slope"), F.round("mean_resid", 5).alias("mean_resid"))


@query("q_nb_glm")
def q_nb_glm(spark, sf):
    groups = size_groups(spark, sf).join(scored_spots(spark, sf).select("spot_id", "cell_sum"), "spot_id")
    return compare.regressed(T.counts(spark, sf), groups, ["cell_sum"]).select("gene", "status", F.round("log_fc", 5).alias("log_fc"), F.round("p", 6).alias("p"), F.round("p_adj", 6).alias("p_adj"))


@query("q_compare")
def q_compare(spark, sf):
    return compare.compared(T.counts(spark, sf), size_groups(spark, sf), "cnt").select("gene", r6("t"), r6("p"), r6("p_adj"))


@query("q_compare_linked")
def q_compare_linked(spark, sf):
    c = T.written(T.counts(spark, sf))
    values, groups = T.written(T.log_normalised(c)), T.written(size_groups(spark, sf))
    return compare.compared_by_link(values, c, groups, CELL, "value").select("gene", "method", F.round("log_fc", 5).alias("log_fc"), F.round("p", 6).alias("p"))


@query("q_mlm")
def q_mlm(spark, sf):
    return compare.mixed_trends(long_values(spark, sf), ["AF", "AO", "RO"]).select("gene", "term", F.round("beta", 5).alias("beta"), F.round("p", 6).alias("p"), F.round("p_adj", 6).alias("p_adj"))


@query("q_mlm_staged")
def q_mlm_staged(spark, sf):
    return compare.staged_trends(long_values(spark, sf), ["AF", "AO", "RO"]).select("gene", "term", F.round("beta", 5).alias("beta"), F.round("p", 6).alias("p"), F.round("p_adj", 6).alias("p_adj"))


@query("q_states")
def q_states(spark, sf):
    """States of all spots by a two-part mixture of their exhaustion counts."""
    return signal_states(T.spots(spark, sf), T.counts(spark, sf), EX)


def places(spark, sf):
    return T.spots(spark, sf).select("spot_id", "x", "y")


@query("q_ising_mc")
def q_ising_mc(spark, sf):
    chains = spark.range(8).select(F.col("id").alias("chain"), (0.1 + 0.05 * F.col("id")).alias("j"))
    return spins.metropolis(places(spark, sf), edges(spark, sf), chains)


@query("q_j1")
def q_j1(spark, sf):
    s = spins.energy(edges(spark, sf), states(spark, sf)).first()["spin_sum"]
    found = spins.fitted_coupling(places(spark, sf), edges(spark, sf), s, CANDIDATES)
    return found.withColumn("best", F.col("abs_g") == F.min("abs_g").over(Window.partitionBy(F.lit(0))))


@query("q_j1_resampled")
def q_j1_resampled(spark, sf):
    nodes, e = places(spark, sf), edges(spark, sf)
    sums = spins.metropolis(nodes, e, spark.range(40).select(F.col("id").alias("chain"), F.lit(0.3).alias("j"))).select(F.round("mean_sum").alias("spin_sum"))
    return spins.resampled_couplings(nodes, e, sums, 20, CANDIDATES)


@query("q_gibbs")
def q_gibbs(spark, sf):
    """Probabilities of a long chain; ends that gave a bonus have left the spot's regular neighbours."""
    chains = spark.createDataFrame([(0, 0.3, 2.0)], "chain long, j double, factor double")
    bonus, regular = bonus_and_regular(spark, sf)
    return spins.gibbs(places(spark, sf), T.written(regular), T.written(bonus), chains).select("spot_id", "prob")


@query("q_j2")
def q_j2(spark, sf):
    chains = spark.createDataFrame([(i, 0.2, 1 + 2.25 * i) for i in range(5)], "chain long, j double, factor double")
    bonus, regular = bonus_and_regular(spark, sf)
    probs = spins.gibbs(places(spark, sf), T.written(regular), T.written(bonus), chains, sweeps=1000, burn_in=500)
    return probs.join(chains, "chain").groupBy("factor").agg((F.avg((F.col("prob") > 0.7).cast("double")) * 100).alias("percent"))


from . import frame_queries, path_queries  # noqa: E402, F401  they add to the register
