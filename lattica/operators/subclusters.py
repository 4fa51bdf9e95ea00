"""Neighbour sets of similar score, less the sets that a larger one holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .measures import most_common
from .spatial import pairs_within


def subclusters(spots: DataFrame, reach: float, gap: float, score: str = "pt") -> DataFrame:
    """``node, members``: distinct sets of a spot and its neighbours nearer than ``reach`` with scores nearer than ``gap``.

    A set that lies in a larger one goes, except sets of one spot and those of the largest size.
    Candidates for containment share a member, so they meet by an equi-join on it.
    """
    s = lambda side: spots.select(F.col("spot_id").alias(side), F.col(score).alias(f"_{side}"))
    near = pairs_within(spots, spots, reach).where(F.col("d") < reach).join(s("src"), "src").join(s("dst"), "dst").where(F.abs(F.col("_src") - F.col("_dst")) < gap)
    own = spots.select(F.col("spot_id").alias("n"), F.col("spot_id").alias("m")).unionByName(near.select(F.col("src").alias("n"), F.col("dst").alias("m")))
    sets = own.groupBy("n").agg(F.sort_array(F.collect_set("m")).alias("members")).groupBy("members").agg(F.min("n").alias("node"))
    largest = sets.agg(F.max(F.size("members")).alias("_most"))
    flat = sets.select("node", F.explode("members").alias("m"), F.size("members").alias("k"))
    met = flat.select(F.col("node").alias("a"), "m", F.col("k").alias("ka")).join(flat.select(F.col("node").alias("b"), "m", F.col("k").alias("kb")), "m").where("kb > ka")
    held = met.groupBy("a", "b", "ka").agg(F.count(F.lit(1)).alias("c")).where("c = ka").select(F.col("a").alias("node")).distinct()
    flagged = sets.join(held.withColumn("_held", F.lit(True)), "node", "left").join(F.broadcast(largest))
    return flagged.where(F.col("_held").isNull() | (F.size("members") == 1) | (F.size("members") == F.col("_most"))).select("node", "members")


def subcluster_nodes(sets: DataFrame, spots: DataFrame, score: str = "pt") -> DataFrame:
    """``node, x, y, pt, cluster``: mean place and score of the members, and their commonest cluster."""
    members = sets.select("node", F.explode("members").alias("spot_id")).join(spots, "spot_id")
    means = members.groupBy("node").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(score).alias("pt"))
    return means.join(most_common(members, ["node"], "cluster", "cluster"), "node")
