"""Operators over ordered paths ``path_id, pos, node`` and their expression values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import quantiles
from ..functions.stats import average_rank, partial
from ..sources.tables import in_parts, written


def point_line_distance(p: tuple[Column, ...], a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance of p to the line through a and b in any number of dimensions; to a where a = b."""
    dot = lambda u, v: sum((x * y for x, y in zip(u, v, strict=True)), F.lit(0.0))
    ab, ap = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, p, strict=True)]
    along = F.when(dot(ab, ab) > 0, dot(ap, ab) / dot(ab, ab)).otherwise(0.0)
    return F.sqrt(sum(((y - along * x) * (y - along * x) for x, y in zip(ab, ap, strict=True)), F.lit(0.0)))


def steps(paths: DataFrame, values: DataFrame, cols: list[str], by: str = "path_id") -> DataFrame:
    """``by, pos, node`` of each step's end, the change of each of ``cols`` (joined on ``node``) and, with x and y, the distance ``d``."""
    w = Window.partitionBy(by).orderBy("pos")
    joined = paths.join(values, "node")
    change = lambda c: F.col(c) - F.lag(c).over(w)
    found = {f"d_{c}": change(c) for c in cols}
    if {"x", "y"} <= set(values.columns):
        found["d"] = F.sqrt(change("x") * change("x") + change("y") * change("y"))
    return joined.withColumns(found | {"_k": F.row_number().over(w)}).where("_k > 1").select(by, "pos", "node", *found)


def overlaps(paths: DataFrame, least: int = 2) -> DataFrame:
    """``a, b, shared`` of path pairs a < b that share more than ``least`` nodes.

    Two such paths share ``least`` + 1 nodes, so one of these is among the ``size - least`` rarest nodes of either (prefix filter of set joins);
    candidates meet on those only, and their node arrays are compared there.  A pair counts at the first node of its intersection, in the order
    of rarity that all paths share, so that pairs are neither listed twice nor shuffled.
    """
    one = paths.select("path_id", "node").distinct()
    rare = one.groupBy("node").agg(F.count(F.lit(1)).alias("_f"))
    sets = one.join(rare, "node").groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("_f", "node"))).alias("_s")).select("path_id", F.transform("_s", lambda s: s["node"]).alias("set"))
    head = sets.where(F.size("set") > least).select("path_id", "set", F.explode(F.slice("set", F.lit(1), F.size("set") - least)).alias("node"))
    side = lambda n: head.select(F.col("path_id").alias(n), F.col("set").alias(f"set_{n}"), "node")
    both = F.array_intersect("set_a", "set_b")
    met = side("a").join(side("b"), "node").where("a < b").where((F.size(both) > least) & (both[0] == F.col("node")))
    return met.select("a", "b", F.size(both).cast("long").alias("shared"))


def contained(paths: DataFrame) -> DataFrame:
    """``path_id`` of paths whose nodes all lie in another path; of equal sets the smallest id is not listed.

    A containing path has the contained one's rarest node, so each path is compared with the paths through that node alone.
    """
    one = paths.select("path_id", "node").distinct()
    rare = one.groupBy("node").agg(F.count(F.lit(1)).alias("_f"))
    sets = one.join(rare, "node").groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("_f", "node"))).alias("_s")).select("path_id", F.transform("_s", lambda s: s["node"]).alias("set"))
    small = sets.select(F.col("path_id").alias("a"), F.col("set").alias("set_a"), F.col("set")[0].alias("node"))
    large = sets.select(F.col("path_id").alias("b"), F.col("set").alias("set_b"), F.explode("set").alias("node"))
    held = small.join(large, "node").where((F.col("a") != F.col("b")) & (F.size("set_b") >= F.size("set_a")) & (F.size(F.array_except("set_a", "set_b")) == 0))
    return held.where((F.size("set_b") > F.size("set_a")) | (F.col("b") < F.col("a"))).select(F.col("a").alias("path_id")).distinct()


def gene_means(paths: DataFrame, counts: DataFrame, genes: list[str], by: list[str], rows: int = 0) -> DataFrame:
    """``by, gene, mean`` over the nodes of a path, zeros included and repeats counted; a node's counts are one row, so a path is grouped once.

    ``rows``, where known, is about the number of rows of ``paths``: tasks then stay as large as they are.
    """
    own = counts.where(F.col("gene").isin(genes)).groupBy(F.col("spot_id").alias("node")).agg(*[F.sum(F.when(F.col("gene") == g, F.col("cnt"))).alias(f"_{k}") for k, g in enumerate(genes)])
    met = in_parts(paths.select(*by, "node"), rows, "node").join(own, "node", "left").drop("node")
    sums = in_parts(met, rows, *by).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(f"_{k}") for k in range(len(genes))])
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("gene"), (F.col(f"_{k}") / F.col("_n")).alias("mean")) for k, g in enumerate(genes)]))
    return sums.select(*by, each.alias("_e")).select(*by, "_e.gene", "_e.mean")


def empirical(observed: DataFrame, controls: DataFrame, strict: bool = False) -> DataFrame:
    """``gene, obs, p, fold``: share of control means at or above the observed mean, and their ratio.

    ``observed`` has ``gene, obs``; ``controls`` has one ``gene, ctl`` a control set.
    """
    hit = (F.col("ctl") > F.col("obs")) if strict else (F.col("ctl") >= F.col("obs"))
    both = controls.join(observed.select("gene", "obs"), "gene")
    return both.groupBy("gene", "obs").agg(F.avg(hit.cast("double")).alias("p"), F.avg("ctl").alias("m")).select("gene", "obs", "p", (F.col("obs") / F.col("m")).alias("fold"))


def control_sets(pool: DataFrame, wanted: DataFrame, sets: int, seed: int = 1) -> DataFrame:
    """``set_id, path_id``: for every set and stratum as many pool paths as ``wanted`` (length, cluster, n) asks, without replacement.

    A set takes a stratum's paths with the smallest hashes.  Only paths below a threshold that leaves some more than asked are put in order; a
    stratum and set that it leaves short, which next to never happens, is drawn again from all.
    """
    stratum = ["length", "cluster"]
    pool = pool.select("path_id", *stratum)
    asked = wanted.join(pool.groupBy(*stratum).agg(F.count(F.lit(1)).alias("m")), stratum).select(*stratum, F.least("n", "m").alias("n"), "m")
    share = (F.col("n") + 6 * F.sqrt("n") + 12) / F.col("m")
    each = F.explode(F.sequence(F.lit(1), F.lit(sets))).alias("set_id")
    asked = written(asked.select(*stratum, "n", (share * 2.0**64 - 2.0**63).alias("upto"), each))
    hashed = lambda df: df.withColumn("_h", F.xxhash64(F.lit(seed), "set_id", "path_id"))
    below = written(hashed(pool.join(asked, stratum)).where(F.col("_h").cast("double") < F.col("upto")).drop("upto"))
    got = below.groupBy("set_id", *stratum).agg(F.count(F.lit(1)).alias("c"))
    short = written(asked.join(got, ["set_id", *stratum], "left").where(F.coalesce("c", F.lit(0)) < F.col("n")).select("set_id", *stratum, "n"))
    if not short.isEmpty():
        again = hashed(pool.join(short, stratum)).select(*below.columns)
        below = below.join(short.select("set_id", *stratum), ["set_id", *stratum], "left_anti").select(*again.columns).unionByName(again)
    order = Window.partitionBy("set_id", *stratum).orderBy("_h", "path_id")
    return below.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.col("n")).select("set_id", "path_id")


def rank_correlations(long: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """``by, n, rho, rho_partial``: Spearman correlation of x and y, and the same given z."""
    ranked = long.select(*by, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"), average_rank(z, by).alias("rz"))
    r = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"), F.corr("rx", "rz").alias("_xz"), F.corr("ry", "rz").alias("_yz"))
    return r.select(*by, "n", "rho", partial(F.col("rho"), F.col("_xz"), F.col("_yz")).alias("rho_partial"))


def pair_correlations(pairs: DataFrame, vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``a, b, r``: Pearson correlation of the vectors of the pairs asked for, by array functions."""
    v = lambda side: vectors.select(F.col(key).alias(side), F.col(vec).cast("array<double>").alias(f"v_{side}"))
    both = pairs.join(v("a"), "a").join(v("b"), "b")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, t: s + t)
    n = F.size("v_a").cast("double")
    ma, mb = total(F.col("v_a")) / n, total(F.col("v_b")) / n
    both = both.withColumn("_ma", ma).withColumn("_mb", mb)
    cov = total(F.zip_with("v_a", "v_b", lambda s, t: (s - F.col("_ma")) * (t - F.col("_mb"))))
    va, vb = total(F.transform("v_a", lambda s: (s - F.col("_ma")) * (s - F.col("_ma")))), total(F.transform("v_b", lambda s: (s - F.col("_mb")) * (s - F.col("_mb"))))
    return both.select("a", "b", (cov / F.sqrt(va * vb)).alias("r"))


#: Genes up to which a node's values are an array with zeros instead of a map.
FEW = 64


def step_correlations(paths: DataFrame, values: DataFrame, genes: list[str], value: str = "value") -> DataFrame:
    """``path_id, pos, a, b, r``: Pearson correlation over ``genes`` of each path node with the one before it, zeros included; null where one does not vary.

    From sums over the genes that both nodes have; only neighbours on a path meet.  Values of many genes stay sparse, those of few are an array.
    """
    n, v = float(len(genes)), F.col(value).cast("double")
    if len(genes) <= FEW:
        entries = F.array(*[F.coalesce(F.sum(F.when(F.col("gene") == g, v)), F.lit(0.0)) for g in genes])
        dot = sum((F.col("m")[k] * F.col("ma")[k] for k in range(len(genes))), F.lit(0.0))
    else:
        entries = F.map_from_entries(F.collect_list(F.struct("gene", v)))
        dot = F.aggregate(F.coalesce(F.map_keys("m"), F.array().cast("array<string>")), F.lit(0.0), lambda t, g: t + F.element_at("m", g) * F.coalesce(F.element_at("ma", g), F.lit(0.0)))
    own = values.where(F.col("gene").isin(genes)).groupBy(F.col("spot_id").alias("node")).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), entries.alias("m"))
    w = Window.partitionBy("path_id").orderBy("pos")
    at = paths.join(own, "node", "left").select("path_id", "pos", "node", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("q", F.lit(0.0)).alias("q"), "m")
    both = at.withColumns({"a": F.lag("node").over(w), "sa": F.lag("s").over(w), "qa": F.lag("q").over(w), "ma": F.lag("m").over(w)}).where("a is not null")
    spread = lambda q, t: F.col(q) - F.col(t) * F.col(t) / n
    r = F.when((spread("q", "s") > 1e-12) & (spread("qa", "sa") > 1e-12), (dot - F.col("s") * F.col("sa") / n) / F.sqrt(spread("q", "s") * spread("qa", "sa")))
    return both.select("path_id", "pos", "a", F.col("node").alias("b"), r.alias("r"))


def mean_correlations(paths: DataFrame, values: DataFrame, genes: list[str], value: str = "value") -> DataFrame:
    """``path_id, r``: mean correlation of consecutive nodes of each path."""
    return step_correlations(paths, values, genes, value).groupBy("path_id").agg(F.avg("r").alias("r"))


def coherent_paths(paths: DataFrame, alternatives: DataFrame, values: DataFrame, genes: list[str], top_percent: float = 25.0, value: str = "value") -> DataFrame:
    """``path_id, r, best, n_alt`` of the paths (``path_id, nodes``) that are kept for their mean correlation.

    A path must exceed all its ``alternatives`` (``path_id, nodes``) and the upper ``top_percent`` of all alternatives; with one alternative it must also exceed the
    80th percentile, with none the 90th.  Of what is left, paths that another one holds go.
    """
    flat = lambda df: df.select("path_id", F.posexplode("nodes").alias("pos", "node"))
    named = lambda df: df.select("path_id", "nodes", F.xxhash64("nodes").alias("seq"))
    own, alt = named(paths), named(alternatives)
    every = own.unionByName(alt).select(F.col("seq").alias("path_id"), "nodes").dropDuplicates(["path_id"])  # equal paths have equal correlations
    r = written(mean_correlations(flat(every), values, genes, value).withColumnRenamed("path_id", "seq"))
    rated = written(alt.select("path_id", "seq").join(r, "seq"))
    own = own.select("path_id", "seq").join(r, "seq").drop("seq")
    cuts = F.array(*[F.lit(c).cast("double") for c in quantiles(rated, "r", [1 - top_percent / 100, 0.8, 0.9])])
    best = rated.groupBy("path_id").agg(F.max("r").alias("best"), F.count(F.lit(1)).alias("n_alt"))
    both = own.join(best, "path_id", "left").withColumn("n_alt", F.coalesce("n_alt", F.lit(0))).withColumn("_cut", cuts)
    tops = (F.col("r") > F.col("best")) & (F.col("r") > F.col("_cut")[0]) & ((F.col("n_alt") > 1) | (F.col("r") > F.col("_cut")[1]))
    kept = written(both.where(F.when(F.col("n_alt") == 0, F.col("r") > F.col("_cut")[2]).otherwise(tops)).select("path_id", "r", "best", "n_alt"))
    inside = contained(flat(paths.join(kept, "path_id", "left_semi")))
    return kept.join(inside, "path_id", "left_anti")


def long_values(paths: DataFrame, spots: DataFrame, values: DataFrame, genes: list[str], treated: int | str, score: str = "ex_score", value: str = "cnt") -> DataFrame:
    """``path_id, x, ex_score, gene, value, trt``: one row a path node and gene, zeros included; ``x`` is the place on the path.

    ``treated`` is a number, or a column of ``paths``.  A node's values are one row until its path has them.
    """
    node = F.col("spot_id").alias("node")
    own = values.where(F.col("gene").isin(genes)).groupBy(node).agg(*[F.sum(F.when(F.col("gene") == g, F.col(value))).alias(f"_{k}") for k, g in enumerate(genes)])
    at = paths.withColumn("_t", F.col(treated) if isinstance(treated, str) else F.lit(treated)).join(spots.select(node, F.col(score).alias("ex_score")).join(own, "node", "full"), "node", "left")
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("gene"), F.coalesce(f"_{k}", F.lit(0)).alias("value")) for k, g in enumerate(genes)]))
    return at.select("path_id", F.col("pos").alias("x"), "ex_score", each.alias("_e"), "_t").select("path_id", "x", "ex_score", "_e.gene", "_e.value", F.col("_t").alias("trt"))


def path_totals(paths: DataFrame, counts: DataFrame) -> DataFrame:
    """``path_id, umi``: mean total count of a path's nodes."""
    total = counts.groupBy(F.col("spot_id").alias("node")).agg(F.sum("cnt").alias("t"))
    return paths.join(total, "node", "left").groupBy("path_id").agg(F.avg(F.coalesce("t", F.lit(0))).alias("umi"))
