"""Gene-level comparison of two groups of spots, trends and enrichment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.special import t_p_value
from ..functions.ordered import running_totals
from ..functions.stats import adjusted, average_rank, welch
from ..sources.tables import written
from .regress import f_p, mixed_fit, nb_fit, normal_p, staged_fit


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_p_value(a, b) if np.isfinite(a) and np.isfinite(b) else None for a, b in zip(t.astype(float), df.astype(float), strict=True)], dtype="float64")


def _moments(n: Column, s: Column, q: Column) -> tuple[Column, Column]:
    """(mean, sample variance) from a number of values, their sum and their sum of squares."""
    return s / n, F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))


def welch_by_gene(values: DataFrame, groups: DataFrame, value: str, zero: float = 0.0) -> DataFrame:
    """``gene, m0, m1, t, df, log_fc`` of sparse ``values`` (``spot_id, gene``, value) over the spots of ``groups`` (``spot_id, grp`` 0/1).

    A spot without a value counts as 0: means and variances follow from the sums and the groups' sizes, so no table of
    all spots and genes is made.
    """
    size = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).agg(*[F.sum(F.when(F.col("grp") == g, F.col("n"))).alias(f"n{g}") for g in (0, 1)])  # one row
    v = F.col(value).cast("double")
    part = lambda g, c, name: F.coalesce(F.sum(F.when(F.col("grp") == g, c)), F.lit(0.0)).alias(name)
    sums = values.join(groups.select("spot_id", "grp"), "spot_id").groupBy("gene").agg(*[part(g, c, f"{n}{g}") for g in (0, 1) for n, c in (("s", v), ("q", v * v))])
    both = sums.join(F.broadcast(size))
    (m0, v0), (m1, v1) = (_moments(*[F.col(f"{c}{g}") for c in "nsq"]) for g in (0, 1))
    both = both.select("gene", "n0", "n1", m0.alias("m0"), v0.alias("v0"), m1.alias("m1"), v1.alias("v1"))
    t, df = welch(*[F.col(c) for c in ("m0", "v0", "n0", "m1", "v1", "n1")])
    return both.select("gene", "m0", "m1", F.when(F.col("v0") + F.col("v1") > 0, t).alias("t"), F.when(F.col("v0") + F.col("v1") > 0, df).alias("df"), F.log2((F.col("m1") + zero) / (F.col("m0") + zero)).alias("log_fc"))


def compared(values: DataFrame, groups: DataFrame, value: str) -> DataFrame:
    """Welch comparison with p-values and their Benjamini-Hochberg adjustment."""
    found = welch_by_gene(values, groups, value)
    return adjusted(found.withColumn("p", t_p("t", "df")), "p", "gene")


def compared_with_rest(values: DataFrame, area: DataFrame, region: DataFrame, value: str, cut: float = -1.0, p_cut: float = 0.05) -> DataFrame:
    """``gene, mean_region, mean_other, t, log_fc, p, p_adj``: genes of a region well below the rest of ``area``."""
    inside = region.select("spot_id").distinct().withColumn("grp", F.lit(0))
    groups = area.select("spot_id").join(inside, "spot_id", "left").select("spot_id", F.coalesce("grp", F.lit(1)).alias("grp"))
    found = compared(values, groups, value).withColumn("log_fc", -F.col("log_fc"))
    return found.where((F.col("log_fc") < cut) & (F.col("p_adj") < p_cut)).select("gene", F.col("m0").alias("mean_region"), F.col("m1").alias("mean_other"), "t", "log_fc", "p", "p_adj")


def compared_with_spots(means: DataFrame, values: DataFrame, spots: DataFrame, value: str) -> DataFrame:
    """``gene, mean_paths, mean_spots, t, df, p``: path means (``path_id, gene, mean``) against the values of all ``spots``, zeros included."""
    one = means.groupBy("gene").agg(F.count("mean").alias("n0"), F.avg("mean").alias("m0"), F.var_samp("mean").alias("v0"))
    n = spots.agg(F.count(F.lit(1)).alias("n1"))  # one row
    v = F.col(value).cast("double")
    two = values.join(spots.select("spot_id"), "spot_id", "left_semi").groupBy("gene").agg(F.sum(v).alias("s1"), F.sum(v * v).alias("q1"))
    both = one.join(two, "gene", "left").join(F.broadcast(n)).fillna(0.0, ["s1", "q1"])
    m1, v1 = _moments(F.col("n1"), F.col("s1"), F.col("q1"))
    both = both.withColumns({"m1": m1, "v1": v1})
    t, df = welch(*[F.col(c) for c in ("m0", "v0", "n0", "m1", "v1", "n1")])
    return both.select("gene", F.col("m0").alias("mean_paths"), F.col("m1").alias("mean_spots"), t.alias("t"), df.alias("df")).withColumn("p", t_p("t", "df"))


def regressed(counts: DataFrame, groups: DataFrame, covariates: list[str]) -> DataFrame:
    """``gene, log_fc, p, status, p_adj``: count regression of ``cnt`` on the covariates of ``groups`` (``spot_id, grp``, covariates) and the group.

    A spot without a count of a gene counts 0 there; zeros are summed over the patterns of the covariates (see :func:`nb_fit`).
    """
    terms = [*covariates, "grp"]
    present = counts.select("spot_id", "gene", "cnt").join(groups.select("spot_id", *terms), "spot_id")
    fit = nb_fit(present, "cnt", terms, "gene", cells=groups)
    last = lambda c: F.element_at(c, -1)
    found = written(fit.select("gene", "status", (last("beta") / F.log(F.lit(2.0))).alias("log_fc"), normal_p(last("beta") / last("se")).alias("p")))
    return found.select("gene", "status").join(adjusted(found, "p", "gene").drop("status"), "gene", "left")


def marker_linked(values: DataFrame, spots: DataFrame, surface: list[str], value: str) -> DataFrame:
    """``gene, r``: Pearson correlation over ``spots`` of each gene with the sum of the ``surface`` genes, zeros included; from sums alone."""
    n = spots.agg(F.count(F.lit(1)).alias("n"))  # one row
    own = values.join(spots.select("spot_id"), "spot_id", "left_semi").select("spot_id", "gene", F.col(value).cast("double").alias("v"))
    level = own.where(F.col("gene").isin(surface)).groupBy("spot_id").agg(F.sum("v").alias("z"))
    ends = level.agg(F.sum("z").alias("sz"), F.sum(F.col("z") * F.col("z")).alias("zz"))  # one row
    sums = own.join(level, "spot_id", "left").groupBy("gene").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.sum(F.col("v") * F.coalesce("z", F.lit(0.0))).alias("c"))
    both = sums.join(F.broadcast(n)).join(F.broadcast(ends))
    spread = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) * (F.col("zz") - F.col("sz") * F.col("sz") / F.col("n"))
    return both.select("gene", F.when(spread > 1e-12, (F.col("c") - F.col("s") * F.col("sz") / F.col("n")) / F.sqrt(spread)).alias("r"))


def compared_by_link(values: DataFrame, counts: DataFrame, groups: DataFrame, surface: list[str], value: str, least: float = 0.2) -> DataFrame:
    """``gene, method, log_fc, p``: genes that go with the surface markers by count regression on their sum and the group, others by Welch's test."""
    linked = written(marker_linked(values, groups, surface, value).withColumn("linked", F.coalesce(F.abs("r") > least, F.lit(False))))  # one row a gene
    plain = compared(values.join(linked.where("not linked").select("gene"), "gene", "left_semi"), groups, value)
    level = counts.where(F.col("gene").isin(surface)).groupBy("spot_id").agg(F.sum("cnt").alias("level"))
    with_level = groups.select("spot_id", "grp").join(level, "spot_id", "left").fillna(0, ["level"])
    fitted = regressed(counts.join(linked.where("linked").select("gene"), "gene", "left_semi"), with_level, ["level"])
    return plain.select("gene", F.lit("welch").alias("method"), "log_fc", "p").unionByName(fitted.select("gene", F.lit("regression").alias("method"), "log_fc", "p"))


def marker_correlations(values: DataFrame, spots: DataFrame, surface: list[str], value: str = "value") -> DataFrame:
    """``gene, n, rho, t, p``: Spearman correlation over ``spots`` of each gene with the sum of the ``surface`` genes, zeros included.

    Values are not negative, so a gene's zeros share the lowest ranks: only its values above 0 are ranked, and the sums over the zeros follow.
    """
    n = spots.agg(F.count(F.lit(1)).alias("n"))  # one row
    own = values.join(spots.select("spot_id"), "spot_id", "left_semi").where(F.col(value) > 0).select("spot_id", "gene", F.col(value).alias("v"))
    level = spots.select("spot_id").join(own.where(F.col("gene").isin(surface)).groupBy("spot_id").agg(F.sum("v").alias("z")), "spot_id", "left").fillna(0.0, ["z"])
    sizes = level.groupBy("z").agg(F.count(F.lit(1)).alias("c"))  # one row a level
    sizes = running_totals(sizes, ["z"], {"upto": "c"})
    level = level.join(sizes.select("z", (F.col("upto") - F.col("c") + (F.col("c") + 1) / 2.0).alias("ry")), "z")
    ends = level.agg(F.sum("ry").alias("sy"), F.sum(F.col("ry") * F.col("ry")).alias("yy"))  # one row
    cells = own.join(level.select("spot_id", "ry"), "spot_id").groupBy("gene", "v").agg(F.count(F.lit(1)).alias("c"), F.sum("ry").alias("y"))  # a gene's distinct values
    under = F.sum("c").over(Window.partitionBy("gene").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    ranked = cells.withColumn("rv", under + (F.col("c") + 1) / 2.0)
    sums = ranked.groupBy("gene").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("rv")).alias("s"), F.sum(F.col("c") * F.col("rv") * F.col("rv")).alias("q"), F.sum(F.col("rv") * F.col("y")).alias("c"), F.sum("y").alias("y"))
    both = sums.join(F.broadcast(n)).join(F.broadcast(ends))
    zeros, mean = F.col("n") - F.col("k"), (F.col("n") + 1) / 2.0
    low = (zeros + 1) / 2.0  # the zeros' rank; values above 0 rank after them
    xx = F.col("q") + 2 * zeros * F.col("s") + F.col("k") * zeros * zeros + zeros * low * low
    xy = F.col("c") + zeros * F.col("y") + low * (F.col("sy") - F.col("y"))
    spread = (xx - F.col("n") * mean * mean) * (F.col("yy") - F.col("n") * mean * mean)
    rho = F.when(spread > 1e-9, (xy - F.col("n") * mean * mean) / F.sqrt(spread))
    found = both.select("gene", "n", rho.alias("rho"))
    found = found.withColumn("t", F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))))
    return found.withColumn("p", F.when(F.abs("rho") >= 1, 0.0).otherwise(t_p("t", F.col("n") - 2)))


def trends(long: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by, n, beta, r2, t`` of the least-squares line of y on x; t is null on an exact or undefined fit."""
    s = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"))
    t = F.when((F.col("r2") < 1) & (F.col("n") > 2), F.signum("beta") * F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2"))))
    return s.withColumn("t", t)


def linear_trends(long: DataFrame) -> DataFrame:
    """``gene, n, beta, r2, t, p, p_adj``: lines of ``value`` on ``x`` by gene, adjusted by Benjamini and Yekutieli; dots of names become dashes."""
    found = trends(long, ["gene"], "x", "value").withColumn("gene", F.regexp_replace("gene", r"\.", "-"))
    return adjusted(found.withColumn("p", t_p("t", F.col("n") - 2)), "p", "gene", "BY")


def _often(long: DataFrame, genes: list[str], most_zero: float) -> DataFrame:
    """Rows of ``genes`` with a share of zeros of ``most_zero`` or less; they are made once, whatever is read of them."""
    own = written(long.select("path_id", "x", "ex_score", "gene", "value").where(F.col("gene").isin(genes)))
    kept = own.groupBy("gene").agg(F.avg((F.col("value") == 0).cast("double")).alias("z")).where(F.col("z") <= most_zero).select("gene")
    return own.join(kept, "gene", "left_semi")


def _terms(fit: DataFrame, terms: list[str]) -> DataFrame:
    """``gene, term, beta, f, p`` of the terms after the intercept."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col("beta")[k + 1].alias("beta"), F.col("se")[k + 1].alias("se")) for k, t in enumerate(terms)]))
    out = fit.select("gene", "n", each.alias("t")).select("gene", "n", "t.term", "t.beta", F.pow(F.col("t.beta") / F.col("t.se"), 2).alias("f"))
    return out.withColumn("p", f_p("f", F.lit(1), F.col("n") - 1)).drop("n")


def mixed_trends(long: DataFrame, genes: list[str], most_zero: float = 0.7) -> DataFrame:
    """``gene, term, beta, f, p, p_adj``: random-intercept models gene ~ ex_score + x + (1 | path_id), both terms.

    ``long`` has ``path_id, x, ex_score, gene, value``; genes with more than ``most_zero`` zeros are left out.
    """
    fit = mixed_fit(_often(long, genes, most_zero), ["gene"], "path_id", "value", ["ex_score", "x"])
    return adjusted(written(_terms(fit, ["ex_score", "x"])), "p", "gene", "BY", by=["term"])


def staged_trends(long: DataFrame, genes: list[str], most_zero: float = 0.7) -> DataFrame:
    """``gene, term, beta, f, p, p_adj`` of x in two stages: what gene ~ ex_score + (1 | path_id) leaves, on x with random intercepts."""
    own = _often(long, genes, most_zero)
    return adjusted(written(_terms(staged_fit(own, ["gene"], "path_id", "value", "ex_score", "x"), ["x"])), "p", "gene", "BY")


def trend_genes(tested: DataFrame, term: str = "x", cut: float = 0.05) -> DataFrame:
    """``gene, way`` (up or down) of tests of a term with an adjusted p below ``cut``."""
    return tested.where((F.col("term") == term) & (F.col("p_adj") < cut) & (F.col("beta") != 0)).select("gene", F.when(F.col("beta") > 0, "up").otherwise("down").alias("way"))


def significance(df: DataFrame, fold: str = "fold", p: str = "p_adj", cut: float = 0.05) -> DataFrame:
    """Adds ``cls``: 2 where the ratio is beyond 1.5 either way and p at most ``cut``, 3 where one of both holds, else 1; p of 0 counts as 0.001."""
    far = F.abs(F.log2(fold)) > F.log2(F.lit(1.5))
    sure = F.when(F.col(p) == 0, 1e-3).otherwise(F.col(p)) <= cut
    return df.withColumn("cls", F.when(far & sure, 2).when(far | sure, 3).otherwise(1))


def volcano(observed: DataFrame, controls: DataFrame, p_cut: float = 0.1, up: float = 1.0, down: float = 1.0) -> DataFrame:
    """``gene, fold, raw_p, p_adj, strength, log_fc, way, cls`` of observed means against control sets.

    ``raw_p`` is the share of control means above the observed one, and what is left to 1 where the ratio is not above 1.  ``way`` is up or down
    beyond ``up`` and ``down`` with an adjusted p below ``p_cut``, else null; ``strength`` is -log10 of the adjusted p, 0 counting as 0.001.
    """
    from .paths import empirical

    found = empirical(observed, controls, strict=True).select("gene", "fold", F.when(F.col("fold") <= 1, 1 - F.col("p")).otherwise(F.col("p")).alias("raw_p"))
    found = significance(adjusted(found, "raw_p", "gene"))
    way = F.when((F.col("fold") > up) & (F.col("p_adj") < p_cut), "up").when((F.col("fold") < down) & (F.col("p_adj") < p_cut), "down")
    strength = -F.log10(F.when(F.col("p_adj") == 0, 1e-3).otherwise(F.col("p_adj")))
    return found.select("gene", "fold", "raw_p", "p_adj", strength.alias("strength"), F.log2("fold").alias("log_fc"), way.alias("way"), "cls")


def enriched(values: DataFrame, spots: DataFrame, value: str = "cnt", floor: float = 7.0, cluster: str = "cluster") -> DataFrame:
    """``gene, cluster, mean_rank, fold``: the cluster with the highest mean rank over the genes of ``values``, and each gene's mean inside over outside of it.

    Ranks below ``floor`` are raised to it; of equal clusters the first in order is taken.
    """
    sizes = spots.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    sums = values.join(spots.select("spot_id", cluster), "spot_id").groupBy(cluster, "gene").agg(F.sum(value).alias("s"))
    every = sizes.join(F.broadcast(values.select("gene").distinct()))  # clusters times genes asked for
    full = every.join(sums, [cluster, "gene"], "left").select(cluster, "gene", "n", F.coalesce("s", F.lit(0)).alias("s"))
    ranks = cluster_ranks(full.select(F.col(cluster).alias("cluster"), "gene", (F.col("s") / F.col("n")).alias("mean")), floor)
    top = ranks.agg(F.max_by("cluster", F.col("mean_rank")).alias("_t"), F.max("mean_rank").alias("mean_rank"))
    top = ranks.join(F.broadcast(top.select(F.col("mean_rank").alias("_m")))).where(F.col("mean_rank") == F.col("_m")).agg(F.min("cluster").alias("_t"), F.max("mean_rank").alias("mean_rank"))  # one row
    inside = lambda c, on: F.sum(F.when((F.col(cluster) == F.col("_t")) == on, F.col(c)))
    both = full.join(F.broadcast(top)).groupBy("gene", "_t", "mean_rank").agg((F.try_divide(inside("s", True) * inside("n", False), inside("n", True) * inside("s", False))).alias("fold"))
    return both.select("gene", F.col("_t").alias("cluster"), "mean_rank", "fold")


def cluster_ranks(means: DataFrame, floor: float = 7.0) -> DataFrame:
    """``cluster, mean_rank`` of ``cluster, gene, mean``: a gene's clusters ranked by mean, ranks below ``floor`` raised to it."""
    ranked = means.select("cluster", "gene", F.greatest(average_rank("mean", ["gene"]), F.lit(floor)).alias("r"))
    return ranked.groupBy("cluster").agg(F.avg("r").alias("mean_rank"))


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Box plot figures by group."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return df.groupBy(*by).agg(q.alias("q")).select(*by, *[F.col("q")[k].alias(n) for k, n in enumerate(("low", "q1", "mid", "q3", "high"))])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n``: bins 1..bins between low and high, 0 below and bins + 1 above."""
    return df.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def colour_bins(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Plot-ready points: ``spot_id, x, y, value, bin`` with the value min-max scaled to 1..bins."""
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    share = (F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a"))
    scaled = F.when(F.col("_b") > F.col("_a"), F.least(F.floor(share * bins) + 1, F.lit(bins))).otherwise(1)
    return df.join(F.broadcast(ends)).select("spot_id", "x", "y", F.col(value).alias("value"), scaled.cast("int").alias("bin"))
