"""Distance joins on a grid of cells, lattice lines, margins and areas."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import row_numbers, running_totals
from ..functions.stats import islands, running
from ..sources.tables import written


def pairs_within(a: DataFrame, b: DataFrame, most: float, least: float = 0.0, key: str = "spot_id") -> DataFrame:
    """``src, dst, d, dx, dy`` of points of ``a`` and ``b`` with ``least <= d <= most``, never a point with itself.

    Points fall into cells as wide as ``most``; ``b`` is repeated for the nine cells around its own, so
    an equi-join on the cell finds every pair once.  Spark takes the ninefold rows for as small as the points themselves, so
    a merge join is asked for: else it would broadcast them from tables of some megabytes on.
    """
    cell = lambda c: F.floor(F.col(c) / most).cast("long")
    left = a.select(F.col(key).alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.select(F.col(key).alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("c1"), cell("y").alias("c2"), F.explode(near).alias("o"))
    right = right.select("dst", "bx", "by", (F.col("c1") + F.col("o.i")).alias("cx"), (F.col("c2") + F.col("o.j")).alias("cy"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    d = F.sqrt(dx * dx + dy * dy)
    met = left.join(right.hint("merge"), ["cx", "cy"]).where(F.col("src") != F.col("dst"))
    return met.select("src", "dst", d.alias("d"), dx.alias("dx"), dy.alias("dy")).where((F.col("d") >= least) & (F.col("d") <= most))


def unit_distance(spots: DataFrame, factor: float = 1.02) -> float:
    """Smallest non-zero distance of two spots times ``factor``; 0 with fewer than two places.

    The search radius starts at the mean spacing and doubles until a pair is found.
    """
    s = spots.agg(F.count(F.lit(1)).alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    if s["n"] < 2 or max(s["w"], s["h"]) == 0:
        return 0.0
    reach = 1.2 * math.sqrt(max(s["w"], 1e-9) * max(s["h"], 1e-9) / s["n"]) or max(s["w"], s["h"]) / s["n"]
    while True:
        found = pairs_within(spots, spots, reach).where("d > 0").agg(F.min("d")).first()[0]
        if found is not None:
            return found * factor
        reach *= 2


def neighbours(spots: DataFrame, threshold: float, key: str = "spot_id") -> DataFrame:
    """Directed edges ``0 < d <= threshold``."""
    return pairs_within(spots, spots, threshold, key=key).where("d > 0")


def connected_spots(spots: DataFrame, threshold: float) -> DataFrame:
    """Spots that have a neighbour."""
    return spots.join(neighbours(spots, threshold).select(F.col("src").alias("spot_id")).distinct(), "spot_id", "left_semi")


def direction(dx: Column, dy: Column) -> Column:
    """Angle in degrees to the nearest ten."""
    return F.bround(F.degrees(F.atan2(dy, dx)), -1).cast("int")


# --------------------------------------------------------------------- lines


def _projected(spots: DataFrame, grid: str) -> list[tuple[int, Column, Column]]:
    """(direction, coordinate shared by a line, coordinate along it)."""
    if grid == "square":
        return [(90, F.col("x"), F.col("y")), (0, F.col("y"), F.col("x"))]
    turn = lambda t: F.col("x") * math.cos(t) - F.col("y") * math.sin(t)
    return [(30, turn(math.pi / 3), F.col("y")), (90, F.col("x"), F.col("y")), (150, turn(2 * math.pi / 3), F.col("y"))]


def split_by_gap(points: DataFrame, by: list[str], order: list[str], cutoff: float, key: str = "spot_id") -> DataFrame:
    """Adds ``run`` (from 0): a new run after a step longer than ``cutoff``; runs of one point go."""
    w = Window.partitionBy(*by).orderBy(*order, key)
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    cut = points.withColumn("_cut", F.coalesce((step > cutoff).cast("int"), F.lit(0))).withColumn("run", F.sum("_cut").over(running(w))).drop("_cut")
    return cut.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "run"))).where("_n >= 2").drop("_n")


def lines(spots: DataFrame, step: float, grid: str = "hex", aa: float = 0.2, max_gap: float = 10.0, least: int = 2) -> DataFrame:
    """``direction, line_id, pos, spot_id, x, y``: the lattice as ordered lines of each direction.

    ``step`` is the smallest distance of two spots.  Spots whose shared coordinate differs by less than ``aa`` steps lie on one line; a line is split where
    a gap exceeds ``max_gap`` steps; lines shorter than ``least`` go.  Line ids count from 1 by
    the shared coordinate and then along the line.
    """
    ways = F.array(*[F.struct(F.lit(name).alias("direction"), F.round(shared, 6).alias("_v"), along.alias("_along")) for name, shared, along in _projected(spots, grid)])
    own = spots.select("spot_id", "x", "y", F.explode(ways).alias("w")).select("spot_id", "x", "y", "w.*")
    own = own.join(islands(own, "_v", step * aa, by=["direction"]), ["direction", "_v"])
    line = ["direction", "island", "run"]
    runs = split_by_gap(own, ["direction", "island"], ["_along"], step * max_gap)
    whole = runs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*line))).where(F.col("_n") >= least)
    whole = written(whole.withColumn("pos", F.row_number().over(Window.partitionBy(*line).orderBy("_along", "spot_id"))))
    ids = row_numbers(whole.select(*line).distinct(), ["island", "run"], "line_id", ["direction"]).drop("_part")
    return whole.join(ids, line).select("direction", "line_id", "pos", "spot_id", "x", "y")


def line_margins(line_points: DataFrame) -> DataFrame:
    """Spots that begin or end a line of any direction."""
    ends = line_points.groupBy("direction", "line_id").agg(F.min_by("spot_id", "pos").alias("a"), F.max_by("spot_id", "pos").alias("b"))
    return ends.select(F.explode(F.array("a", "b")).alias("spot_id")).distinct()


def slope_class(edges: DataFrame) -> DataFrame:
    """Each undirected pair once, with the class of its slope: 30 in (0, 1), 150 in (-1, 0), else 90."""
    once = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when(F.col("src") <= F.col("dst"), F.col("dx")).otherwise(-F.col("dx")).alias("dx"), F.when(F.col("src") <= F.col("dst"), F.col("dy")).otherwise(-F.col("dy")).alias("dy")).distinct()
    slope = F.try_divide("dy", "dx")
    return once.select("a", "b", F.when((slope > 0) & (slope < 1), 30).when((slope < 0) & (slope > -1), 150).otherwise(90).alias("direction"))


# --------------------------------------------------------------------- areas


def in_polygon(spots: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Spots inside a drawn polygon, by counting the edges a ray to the right crosses."""
    if len(corners) < 3:
        return spots.where(F.lit(False))
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 == y2:
            continue
        spans = (F.lit(y1) > F.col("y")) != (F.lit(y2) > F.col("y"))
        at = F.lit(x1) + (F.col("y") - y1) * ((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when(spans & (F.col("x") < at), 1).otherwise(0)
    return spots.where(crossings % 2 == 1)


def expanded_region(region: DataFrame, area: DataFrame, taken: DataFrame, unit: float, times: float = 3.0) -> DataFrame:
    """``spot_id, ring``: spots of ``area`` outside ``region`` and ``taken`` around the region's middle, ``times`` as many or more.

    Radii are 2.4, 3.4, ... units from the mean place of the region; ``ring`` counts them from 1.  The first radius with enough spots
    is taken; where there are never enough, all of the area.
    """
    middle = region.agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.count(F.lit(1)).alias("_size"))  # one row
    gone = taken.select("spot_id").union(region.select("spot_id")).distinct()
    free = area.select("spot_id", "x", "y").join(gone, "spot_id", "left_anti").join(F.broadcast(middle))
    d = F.sqrt(F.pow(F.col("x") - F.col("_mx"), 2) + F.pow(F.col("y") - F.col("_my"), 2))
    ring = F.greatest(F.lit(1), F.ceil(F.round((d - 1.4 * unit) / unit, 9))).cast("long")
    rings = free.select("spot_id", ring.alias("ring"), "_size")
    upto = rings.groupBy("ring", "_size").agg(F.count(F.lit(1)).alias("n"))  # one row a radius
    upto = running_totals(upto, ["ring"], {"c": "n"})
    stop = upto.where(F.col("c") >= F.col("_size") * times).agg(F.min("ring").alias("stop"))
    return rings.join(F.broadcast(stop)).where(F.col("stop").isNull() | (F.col("ring") <= F.col("stop"))).select("spot_id", "ring")


def separate_lines(pairs: DataFrame, spots: DataFrame, more_than: int = 0) -> DataFrame:
    """``direction, line_id, pos, spot_id``: the components of each slope class of ``pairs`` (``a, b, direction``), ordered by y.

    Components of ``more_than`` spots or fewer go; ``line_id`` is a line's smallest spot.
    """
    from .graph import components

    out = None
    for name in (30, 90, 150):
        own = pairs.where(F.col("direction") == name)
        nodes = own.select(F.explode(F.array("a", "b")).alias("spot_id")).distinct()
        found = components(nodes, own.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.lit(name).alias("direction"), F.col("component").alias("line_id"), "spot_id")
        out = found if out is None else out.unionByName(found)
    line = ["direction", "line_id"]
    sizes = out.groupBy(*line).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > more_than)
    placed = out.join(sizes.select(*line), line, "left_semi").join(spots.select("spot_id", "y"), "spot_id")
    return placed.select(*line, F.row_number().over(Window.partitionBy(*line).orderBy("y", "spot_id")).alias("pos"), "spot_id")


def neighbour_lines(spots: DataFrame, reach: float, more_than: int = 1) -> DataFrame:
    """Lines from neighbours nearer than ``reach``: pairs by slope class, components of a class, ordered by y."""
    return separate_lines(slope_class(neighbours(spots, reach)), spots, more_than)


def with_self(spots: DataFrame, threshold: float) -> DataFrame:
    """``src, dst, d``: every spot's neighbours within ``threshold`` and itself."""
    own = spots.select(F.col("spot_id").alias("src"), F.col("spot_id").alias("dst"), F.lit(0.0).alias("d"))
    return pairs_within(spots, spots, threshold).select("src", "dst", "d").unionByName(own)
