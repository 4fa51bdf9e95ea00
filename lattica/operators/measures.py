"""Spot-level measures: normalisation, marker sums, scores and cluster summaries of long counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regress import nb_fit, pearson_residuals


def per_million(counts: DataFrame) -> DataFrame:
    """``spot_id, gene, cpm``."""
    total = counts.groupBy("spot_id").agg(F.sum("cnt").alias("total"))
    return counts.join(total, "spot_id").select("spot_id", "gene", (F.col("cnt") / F.col("total") * 1e6).alias("cpm"))


def marker_sums(spots: DataFrame, counts: DataFrame, sums: dict[str, list[str]]) -> DataFrame:
    """``spots`` plus one count sum a list of genes, in one pass over the counts; 0 where none."""
    wanted = sorted({g for genes in sums.values() for g in genes})
    found = counts.where(F.col("gene").isin(wanted)).groupBy("spot_id").agg(*[F.sum(F.when(F.col("gene").isin(genes), F.col("cnt"))).alias(n) for n, genes in sums.items()])
    return spots.join(found, "spot_id", "left").withColumns({n: F.coalesce(F.col(n), F.lit(0).cast("long")) for n in sums})


def residual_score(spots: DataFrame, kept: Column, y: str, x: str, out: str) -> DataFrame:
    """Adds ``out``: least-squares residual of ``y`` on ``x`` over ``kept`` spots, shifted to start at 0; null elsewhere."""
    fit = spots.where(kept).agg(F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"))
    resid = F.col(y) - F.col("_a") - F.col("_b") * F.col(x)
    scored = spots.join(F.broadcast(fit)).withColumn("_r", F.when(kept, resid))
    low = scored.agg(F.min("_r").alias("_low"))
    return scored.join(F.broadcast(low)).withColumn(out, F.col("_r") + F.abs("_low")).drop("_a", "_b", "_r", "_low")


def dense(spots: DataFrame, counts: DataFrame, genes: DataFrame, value: str = "cnt") -> DataFrame:
    """``spot_id, gene, value`` for every spot and listed gene, absent values 0; the gene list is small."""
    keys = spots.select("spot_id").join(F.broadcast(genes.select("gene").distinct()))
    return keys.join(counts.select("spot_id", "gene", value), ["spot_id", "gene"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def cluster_means(spots: DataFrame, counts: DataFrame, genes: list[str], cluster: str = "cluster") -> DataFrame:
    """``cluster, gene, mean, median`` over all spots of a cluster, zeros included; only genes that occur."""
    present = counts.where(F.col("gene").isin(genes)).select("gene").distinct()
    values = dense(spots, counts, present).join(spots.select("spot_id", cluster), "spot_id")
    return values.groupBy(cluster, "gene").agg(F.avg("cnt").alias("mean"), F.percentile("cnt", F.lit(0.5)).alias("median"))


def variable_genes(spots: DataFrame, counts: DataFrame, least_mean: float = 0.1) -> DataFrame:
    """Genes whose mean count over ``spots`` is above ``least_mean``."""
    n = spots.agg(F.count(F.lit(1)).alias("n"))
    sums = counts.join(spots.select("spot_id"), "spot_id", "left_semi").groupBy("gene").agg(F.sum("cnt").alias("s"))
    return sums.join(F.broadcast(n)).where(F.col("s") / F.col("n") > least_mean).select("gene")


def count_residual_score(spots: DataFrame, y: str, x: str, out: str) -> DataFrame:
    """Adds ``out``: Pearson residual of the count regression of ``y`` on ``x`` over all spots."""
    return pearson_residuals(spots, nb_fit(spots, y, [x]), y, [x], out)


def adjusted_counts(spots: DataFrame, counts: DataFrame, genes: list[str]) -> DataFrame:
    """``spot_id, resid``: summed counts of ``genes`` freed of a spot's total count by count regression."""
    total = counts.groupBy("spot_id").agg(F.sum("cnt").alias("total"))
    own = marker_sums(spots.select("spot_id"), counts, {"y": genes}).join(total, "spot_id", "left").fillna(0, ["total"])
    return count_residual_score(own, "y", "total", "resid").select("spot_id", "resid")


def prepared(spots: DataFrame, counts: DataFrame, exhaustion: list[str], surface: list[str], least: int = 1, genes: list[str] | None = None, grouping: tuple[float, float] | None = None) -> dict[str, DataFrame]:
    """The frames that path finding starts from: ``spots`` with sums and score, ``cpm``, ``genes``, ``cells``, ``nodes``, ``members``.

    ``cells`` are the spots with ``least`` surface counts or more, rescaled to their highest score.  ``genes`` varies enough among them (mean above 0.1; of the list given or of all).  With
    ``grouping`` (reach, gap in score), neighbours of like score become one node, else every cell is a node; ``nodes`` has ``node, x, y, pt, cluster``.
    """
    from .subclusters import subcluster_nodes, subclusters

    own = marker_sums(spots, counts, {"ex_sum": exhaustion, "cell_sum": surface})
    own = residual_score(own, F.col("cell_sum") >= least, "ex_sum", "cell_sum", "ex_score")
    cells = own.where(F.col("cell_sum") >= least)
    varied = variable_genes(cells, counts if genes is None else counts.where(F.col("gene").isin(genes)))
    ends = own.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.max("ex_score").alias("_s"))  # one row: all spots' box
    scale = lambda c: (F.col(c) - F.col(f"_{c}0")) * F.col("_s") / (F.col(f"_{c}1") - F.col(f"_{c}0"))
    cells = cells.join(F.broadcast(ends)).withColumns({"x": scale("x"), "y": scale("y")}).drop("_x0", "_x1", "_y0", "_y1", "_s").withColumn("pt", F.col("ex_score"))
    if grouping is None:
        members = cells.select(F.col("spot_id").alias("node"), "spot_id")
        nodes = cells.select(F.col("spot_id").alias("node"), "x", "y", "pt", "cluster")
    else:
        sets = subclusters(cells, *grouping)
        members, nodes = sets.select("node", F.explode("members").alias("spot_id")), subcluster_nodes(sets, cells)
    return {"spots": own, "cpm": per_million(counts), "genes": varied, "cells": cells, "nodes": nodes, "members": members}


def region_prepared(spots: DataFrame, counts: DataFrame, exhaustion: list[str], surface: list[str], least: int = 1) -> dict[str, DataFrame | float]:
    """The frames of :func:`prepared` with the score of the count regression, ``ex_score_nb``, at every spot, and ``unit``, the distance within which spots are neighbours."""
    from .spatial import unit_distance

    found = prepared(spots, counts, exhaustion, surface, least)
    scored = count_residual_score(found["spots"], "ex_sum", "cell_sum", "ex_score_nb")
    return found | {"spots": scored, "unit": unit_distance(spots)}


def rescaled(spots: DataFrame, score: str, factor: float = 1.0) -> DataFrame:
    """Coordinates moved to the origin and stretched so that each axis ends at the largest score times ``factor``."""
    ends = spots.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.max(score).alias("_s"))
    scale = lambda c: (F.col(c) - F.col(f"_{c}0")) * F.col("_s") * factor / (F.col(f"_{c}1") - F.col(f"_{c}0"))
    return spots.join(F.broadcast(ends)).withColumns({"x": scale("x"), "y": scale("y")}).drop("_x0", "_x1", "_y0", "_y1", "_s")


def most_common(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``by, out``: the most frequent value, the first in order on ties."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))
