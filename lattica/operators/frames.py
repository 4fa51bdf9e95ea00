"""Plot-ready frames: what a figure of spots, lines, paths or tests draws, one row a mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import row_numbers


def marked_points(spots: DataFrame, chosen: DataFrame) -> DataFrame:
    """``spot_id, x, y, chosen`` of all spots, true for those in ``chosen`` (tumour clusters, T cell spots, a region)."""
    flag = chosen.select("spot_id").distinct().withColumn("_c", F.lit(True))
    return spots.join(flag, "spot_id", "left").select("spot_id", "x", "y", F.coalesce("_c", F.lit(False)).alias("chosen"))


def path_points(paths: DataFrame, places: DataFrame, longer_than: int = 0) -> DataFrame:
    """``path_id, pos, node, x, y, share``: nodes of paths of more than ``longer_than`` nodes; ``share`` runs from 0 to 1 along a path."""
    own = Window.partitionBy("path_id")
    at = paths.join(places.select(F.col("spot_id").alias("node"), "x", "y"), "node").withColumn("_n", F.count(F.lit(1)).over(own)).where(F.col("_n") > longer_than)
    k = F.row_number().over(own.orderBy("pos"))
    return at.select("path_id", "pos", "node", "x", "y", F.when(F.col("_n") > 1, (k - 1) / (F.col("_n") - 1)).otherwise(0.0).alias("share"))


def path_arrows(paths: DataFrame, places: DataFrame, longer_than: int = 0) -> DataFrame:
    """``path_id, pos, x0, y0, x1, y1, first, last``: a path's steps as arrows; ``first`` and ``last`` mark its ends."""
    points = path_points(paths, places, longer_than)
    w = Window.partitionBy("path_id").orderBy("pos")
    step = points.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "_after": F.lead("pos", 2).over(w), "_before": F.lag("pos").over(w)}).where("x1 is not null")
    return step.select("path_id", "pos", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1", F.col("_before").isNull().alias("first"), F.col("_after").isNull().alias("last"))


def path_panels(paths: DataFrame, values: DataFrame, gene: str, value: str) -> DataFrame:
    """``path_id, pos, value`` of one gene along each path, zeros included: a panel a path."""
    own = values.where(F.col("gene") == gene).select(F.col("spot_id").alias("node"), F.col(value).alias("value"))
    return paths.join(own, "node", "left").select("path_id", "pos", F.coalesce("value", F.lit(0)).alias("value"))


def path_shares(paths: DataFrame, counts: DataFrame, gene: str) -> DataFrame:
    """``path_id, pos, node, cnt, total, share``: a gene's counts along a path and their share of a spot's counts."""
    totals = counts.groupBy(F.col("spot_id").alias("node")).agg(F.sum("cnt").alias("total"), F.sum(F.when(F.col("gene") == gene, F.col("cnt")).otherwise(0)).alias("cnt"))
    both = paths.join(totals, "node", "left")
    return both.select("path_id", "pos", "node", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("total", F.lit(0)).alias("total"), F.try_divide("cnt", "total").alias("share"))


def trails(paths: DataFrame, nodes: DataFrame, score: str = "pt") -> DataFrame:
    """``path_id, pos, node, x, y, colour``: nodes coloured by their rounded score, from 1 at the lowest."""
    at = paths.join(nodes.select(F.col("spot_id").alias("node"), "x", "y", F.bround(score).cast("long").alias("_s")), "node")
    low = at.agg(F.min("_s").alias("_low"))  # one row
    return at.join(F.broadcast(low)).select("path_id", "pos", "node", "x", "y", (F.col("_s") - F.col("_low") + 1).alias("colour"))


def line_marks(lines: DataFrame, segments: DataFrame, colours: int = 5, direction: int | None = None) -> DataFrame:
    """``direction, line_id, pos, spot_id, x, y, seg_no, colour, change``: lines with the segment of each spot.

    Colours 1 to ``colours`` rotate along a line; ``change`` marks the first spot of every segment but the first.
    """
    kept = lines if direction is None else lines.where(F.col("direction") == direction)
    spread = segments.select("direction", "line_id", "seg_no", "start", F.explode(F.sequence("start", "end")).alias("pos"))
    both = kept.join(spread, ["direction", "line_id", "pos"], "left")
    change = F.coalesce((F.col("pos") == F.col("start")) & (F.col("seg_no") > 1), F.lit(False))
    return both.select("direction", "line_id", "pos", "spot_id", "x", "y", "seg_no", ((F.col("seg_no") - 1) % colours + 1).cast("int").alias("colour"), change.alias("change"))


def empirical_histogram(observed: DataFrame, controls: DataFrame, bins: int = 100) -> DataFrame:
    """``gene, bin, n, obs, p``: control means of each gene in ``bins`` of equal width, the observed mean and the smaller one-sided p."""
    ends = controls.groupBy("gene").agg(F.min("ctl").alias("_a"), F.max("ctl").alias("_b"), F.count(F.lit(1)).alias("_m"))
    both = controls.join(ends, "gene").join(observed.select("gene", "obs"), "gene")
    at = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col("ctl") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins) + 1, F.lit(bins))).otherwise(1)
    sides = both.groupBy("gene", "obs").agg(F.avg((F.col("ctl") >= F.col("obs")).cast("double")).alias("_up"), F.avg((F.col("ctl") <= F.col("obs")).cast("double")).alias("_down"))
    return both.groupBy("gene", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).join(sides.select("gene", "obs", F.least("_up", "_down").alias("p")), "gene")


def enrichment_bars(found: DataFrame, most: int | None = None) -> DataFrame:
    """``place, name, n, p``: gene sets of an enrichment table ``id, n, p_adj``, readable names, largest p first; the ``most`` most significant."""
    name = F.lower(F.regexp_replace("id", "_", " "))
    ranked = row_numbers(found.select("id", name.alias("name"), "n", "p_adj"), ["p_adj", "id"], "_k")
    ranked = ranked if most is None else ranked.where(F.col("_k") <= most)
    shown = ranked.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return ranked.join(F.broadcast(shown)).select((F.col("_n") + 1 - F.col("_k")).cast("int").alias("place"), "name", "n", F.col("p_adj").alias("p"))


def marker_volcano(markers: DataFrame) -> DataFrame:
    """``gene, log_fc, strength, cls, label`` of a single-cell marker table ``gene, log_fc, p_adj``.

    ``strength`` is -log10 of the adjusted p, at most 100.  Classes: 2 a strength of 90 or more with a fold change above 4 or below 1/50; 3 a strength of 90
    or a fold change above 10 or below 1/50; else 1.  Class 2 is labelled.
    """
    strength = -F.log10(F.greatest("p_adj", F.lit(1e-100)))
    strong = F.col("strength") >= 90
    low = F.col("log_fc") < F.log2(F.lit(1 / 50))
    cls = F.when(strong & ((F.col("log_fc") > F.log2(F.lit(4.0))) | low), 2).when(strong | (F.col("log_fc") > F.log2(F.lit(10.0))) | low, 3).otherwise(1)
    out = markers.select("gene", "log_fc", strength.alias("strength")).withColumn("cls", cls)
    return out.withColumn("label", F.when(F.col("cls") == 2, F.col("gene")).otherwise(""))
