"""Registered queries of the plot-ready frames, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, paths
from ..sources import tables as T
from ..sources.tables import COUNTS_SQL, PATHS_SQL, SPOTS_SQL
from .shared import HEX_LINES, LINE_SEGS, S1, URGENT, hex_lines, lattice, line_segments, query, r6, scored_spots, urgent


@query("q_marked_points", "select spot_id, round(x, 6) as x, round(y, 6) as y, cell_sum >= 100 as chosen from scored", S1)
def q_marked_points(spark, sf):
    s = scored_spots(spark, sf)
    return frames.marked_points(s, s.where("cell_sum >= 100")).select("spot_id", r6("x"), r6("y"), "chosen")


@query(
    "q_path_points",
    "select path_id, pos, node, round(x, 6) as x, round(y, 6) as y, round(case when n > 1 then (k - 1.0) / (n - 1) else 0 end, 6) as share from (select *, count(*) over (partition by path_id) as n, row_number() over (partition by path_id order by pos) as k from paths join spots on spot_id = node) where n > 2",
    (SPOTS_SQL, PATHS_SQL),
)
def q_path_points(spark, sf):
    return frames.path_points(T.order_paths(spark, sf), T.spots(spark, sf), 2).select("path_id", "pos", "node", r6("x"), r6("y"), r6("share"))


@query(
    "q_path_arrows",
    """select path_id, pos, round(x, 6) as x0, round(y, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1, k = 1 as "first", k = n - 1 as "last" from
  (select *, lead(x) over w as x1, lead(y) over w as y1, row_number() over w as k, count(*) over (partition by path_id) as n from paths join spots on spot_id = node window w as (partition by path_id order by pos)) where n > 2 and k < n""",
    (SPOTS_SQL, PATHS_SQL),
)
def q_path_arrows(spark, sf):
    found = frames.path_arrows(T.order_paths(spark, sf), T.spots(spark, sf), 2)
    return found.select("path_id", "pos", r6("x0"), r6("y0"), r6("x1"), r6("y1"), "first", "last")


@query("q_path_panels", "select path_id, pos, coalesce(cnt, 0) as value from paths left join counts on spot_id = node and gene = 'NO'", (COUNTS_SQL, PATHS_SQL))
def q_path_panels(spark, sf):
    return frames.path_panels(T.order_paths(spark, sf), T.counts(spark, sf), "NO", "cnt")


@query(
    "q_path_shares",
    """select path_id, pos, node, coalesce(cnt, 0) as cnt, coalesce(total, 0) as total, round(cnt / total, 6) as share from paths left join
  (select spot_id, cast(sum(cnt) as bigint) as total, cast(sum(case when gene = 'AF' then cnt else 0 end) as bigint) as cnt from counts group by 1) on spot_id = node""",
    (COUNTS_SQL, PATHS_SQL),
)
def q_path_shares(spark, sf):
    return frames.path_shares(T.order_paths(spark, sf), T.counts(spark, sf), "AF").select("path_id", "pos", "node", "cnt", "total", r6("share"))


@query("q_trails", "select path_id, pos, node, round(x, 6) as x, round(y, 6) as y, ex_sum - min(ex_sum) over () + 1 as colour from paths join scored on spot_id = node", (*S1, PATHS_SQL))
def q_trails(spark, sf):
    return frames.trails(T.order_paths(spark, sf), lattice(spark, sf)).select("path_id", "pos", "node", r6("x"), r6("y"), "colour")


@query(
    "q_line_marks",
    "select direction, cast(line_id as bigint) as line_id, cast(pos as integer) as pos, spot_id, round(x, 6) as x, round(y, 6) as y, seg_no, cast((seg_no - 1) % 5 + 1 as integer) as colour, (pos - 1) % 8 = 0 and seg_no > 1 as change from line_segs where direction = 30",
    (SPOTS_SQL, HEX_LINES, LINE_SEGS),
)
def q_line_marks(spark, sf):
    segs = line_segments(spark, sf).groupBy("direction", "line_id", "seg_no").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    found = frames.line_marks(hex_lines(spark, sf), segs, direction=30)
    return found.select("direction", "line_id", "pos", "spot_id", r6("x"), r6("y"), "seg_no", "colour", "change")


_SETS = (COUNTS_SQL, PATHS_SQL, URGENT, """
means as (select path_id, g.gene as gene, sum(coalesce(cnt, 0)) * 1.0 / count(*) as mean from paths cross join (values ('AF'), ('NO'), ('RF')) g(gene) left join counts on spot_id = node and counts.gene = g.gene group by 1, 2),
obs as (select gene, avg(mean) as obs from means join kinds using (path_id) where "real" group by 1),
ctl as (select month, gene, round(avg(mean), 9) as ctl from means join kinds using (path_id) where not "real" group by 1, 2)""")


@query(
    "q_empirical_histogram",
    """select gene, bin, count(*) as n, round(any_value(obs), 6) as obs, round(any_value(p), 6) as p from (select gene, obs, case when b > a then cast(least(floor((ctl - a) / (b - a) * 20) + 1, 20) as integer) else 1 end as bin,
  least(avg(case when ctl >= obs then 1.0 else 0 end) over (partition by gene), avg(case when ctl <= obs then 1.0 else 0 end) over (partition by gene)) as p
  from (select *, min(ctl) over (partition by gene) as a, max(ctl) over (partition by gene) as b from ctl join obs using (gene))) group by 1, 2""",
    _SETS,
)
def q_empirical_histogram(spark, sf):
    means = paths.gene_means(T.order_paths(spark, sf), T.counts(spark, sf), ["AF", "NO", "RF"], ["path_id"]).join(urgent(spark, sf), "path_id")
    obs = means.where("real").groupBy("gene").agg(F.avg("mean").alias("obs"))
    ctl = means.where("not real").groupBy("month", "gene").agg(F.round(F.avg("mean"), 9).alias("ctl"))
    return frames.empirical_histogram(obs, ctl, 20).select("gene", "bin", "n", r6("obs"), r6("p"))


@query(
    "q_enrichment_bars",
    "select cast(row_number() over (order by k desc) as integer) as place, lower(replace(id, '_', ' ')) as name, n, round(p_adj, 9) as p from (select *, row_number() over (order by p_adj, id) as k from sets) where k <= 12",
    ("""
sets as (select replace(p_brand || '_' || p_type, '#', '_') as id, count(*) as n, round(avg(p_retailprice) / 100000, 9) as p_adj from part group by 1)""",),
)
def q_enrichment_bars(spark, sf):
    name = F.regexp_replace(F.concat_ws("_", "p_brand", "p_type"), "#", "_")
    sets = T.table(spark, sf, "part").groupBy(name.alias("id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice") / 100000, 9).alias("p_adj"))
    return frames.enrichment_bars(sets, 12)


@query(
    "q_marker_volcano",
    """select gene, round(log_fc, 6) as log_fc, round(s, 6) as strength, case when s >= 90 and (log_fc > 2 or log_fc < log2(0.02)) then 2 when s >= 90 or log_fc > log2(10) or log_fc < log2(0.02) then 3 else 1 end as cls,
  case when s >= 90 and (log_fc > 2 or log_fc < log2(0.02)) then gene else '' end as label from (select gene, log_fc, -log10(greatest(p_adj, 1e-100)) as s from markers)""",
    ("""
markers as (select c_name as gene, (c_acctbal - 4000) / 700 as log_fc, pow(10.0, -abs(c_acctbal) / 60) as p_adj from customer)""",),
)
def q_marker_volcano(spark, sf):
    c = T.table(spark, sf, "customer")
    markers = c.select(F.col("c_name").alias("gene"), ((F.col("c_acctbal") - 4000) / 700).alias("log_fc"), F.pow(F.lit(10.0), -F.abs("c_acctbal") / 60).alias("p_adj"))
    return frames.marker_volcano(markers).select("gene", r6("log_fc"), r6("strength"), "cls", "label")
