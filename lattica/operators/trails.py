"""Path finding from scores: candidates near a line, shortest paths up a gradient, selection and control paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import difference_quantile, quantiles, running_totals, smallest
from ..sources.tables import written
from .compare import marker_correlations
from .graph import gradient_paths, second_alternatives, shortest_paths, weighted
from .measures import most_common
from .paths import coherent_paths, control_sets
from .spatial import neighbours, pairs_within


def _runs(points: DataFrame) -> DataFrame:
    """``x, y, step, n``: ``points`` (``x, y``) as runs of evenly spaced points of one x, to nine decimals; other points are runs of one."""
    order = Window.partitionBy("v").orderBy("y")  # the points of one line of the lattice
    gaps = points.select(F.round("x", 9).alias("v"), "x", "y").withColumn("gap", F.round(F.col("y") - F.lag("y").over(order), 9))
    new = (~F.col("gap").eqNullSafe(F.lag("gap").over(order))).cast("int")
    placed = gaps.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("v", "run")
    step = (F.max("y").over(run) - F.min("y").over(run)) / F.greatest(F.count(F.lit(1)).over(run) - 1, F.lit(1))
    placed = placed.withColumn("step", step).withColumn("k", F.row_number().over(run.orderBy("y")) - 1)
    placed = placed.withColumn("off", F.abs(F.col("y") - F.min("y").over(run) - F.col("k") * F.col("step"))).withColumn("off", F.max("off").over(run))
    found = placed.groupBy("v", "run", F.when(F.col("off") > 1e-9, F.col("k")).alias("alone"))
    return found.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.first("step").alias("step"), F.count(F.lit(1)).alias("n")).select("x", "y", F.when(F.col("n") > 1, F.col("step")).otherwise(0.0).alias("step"), "n")


def _run_distances(runs: DataFrame, reach: float) -> DataFrame:
    """``d, n``: distances up to ``reach`` of all ordered pairs of points of ``runs``, a point with itself included, to nine decimals, and how often they occur.

    Pairs of runs with the same shift, step and lengths are counted together; only then their differences are made.
    """
    cell = F.floor(F.col("x") / reach).cast("long")
    side = lambda df, c: df.select(F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}"), F.col("step").alias(f"s{c}"), F.col("n").alias(f"n{c}"), "cell")
    one = side(runs.withColumn("cell", cell), 0)
    two = side(runs.withColumn("cell", F.explode(F.array(*[cell + k for k in (-1, 0, 1)]))), 1)
    top = lambda c: F.col(f"y{c}") + F.col(f"s{c}") * (F.col(f"n{c}") - 1)
    met = one.join(two.hint("merge"), "cell").where((F.abs(F.col("x1") - F.col("x0")) <= reach) & (F.col("y1") - top(0) <= reach) & (F.col("y0") - top(1) <= reach))
    even = (F.col("n0") == 1) | (F.col("n1") == 1) | (F.round(F.col("s0") - F.col("s1"), 12) == 0)
    begin = F.explode(F.when(even, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n0") - 1)))  # with unlike steps one run goes point by point
    met = met.select("*", begin.alias("i")).select(
        (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0") - F.col("i") * F.col("s0")).alias("dy"), F.when(F.col("n1") > 1, F.col("s1")).otherwise(F.col("s0")).alias("s"), F.when(even, F.col("n0")).otherwise(1).alias("n0"), "n1"
    )
    shift = met.groupBy(F.round(F.abs("dx"), 9).alias("_x"), F.round("dy", 9).alias("_y"), F.round("s", 12).alias("_s"), "n0", "n1").agg(F.min(F.abs("dx")).alias("dx"), F.min("dy").alias("dy"), F.min("s").alias("s"), F.count(F.lit(1)).alias("m"))
    low = F.when(F.col("s") > 0, F.ceil((-reach - F.col("dy")) / F.col("s")) - 1)
    high = F.when(F.col("s") > 0, F.floor((reach - F.col("dy")) / F.col("s")) + 1)
    k0, k1 = F.greatest(low, 1 - F.col("n0")), F.least(high, F.col("n1") - 1)
    each = shift.where(k0 <= k1).withColumn("k", F.explode(F.sequence(k0, k1)))
    times = F.least(F.col("n0") - 1, F.col("n1") - 1 - F.col("k")) - F.greatest(F.lit(0), -F.col("k")) + 1
    dy = F.col("dy") + F.col("k") * F.col("s")
    d = F.sqrt(F.col("dx") * F.col("dx") + dy * dy)
    return each.select(F.round(d, 9).alias("d"), (F.col("m") * times).alias("n")).where(F.col("d") <= reach).groupBy("d").agg(F.sum("n").alias("n"))


def pairwise_quantile(points: DataFrame, share: float, reach: float) -> float:
    """Quantile ``share`` of the distances of all ordered pairs of ``points`` (``spot_id, x, y``), a point with itself included.

    Only pairs within a reach count: it doubles until they hold the quantile.  On a lattice, points are taken as runs of evenly spaced
    ones, and pairs are counted by the shifts of two runs; where there are not many times more points than runs, pairs are made.
    """
    n, w, h = points.agg(F.count(F.lit(1)), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    rank = share * (n * n - 1) - n  # among the pairs of different points; n zeros come before
    if rank <= -1 or n < 2:
        return 0.0
    runs = written(_runs(points))
    few = runs.count() * 8 <= n
    if few:
        reach = max(reach, 1.3 * math.sqrt(share * w * h / math.pi))
    while True:
        if few:
            near = written(_run_distances(runs, reach).select("d", F.when(F.col("d") == 0, F.col("n") - n).otherwise(F.col("n")).alias("n")).where("n > 0"))
            held = near.agg(F.sum("n")).first()[0] or 0
        else:
            near = pairs_within(points, points, reach).select(F.round("d", 9).alias("d"))
            held = near.count()
        if held > rank + 1 or held == n * (n - 1):
            break
        reach *= 2
    if rank < 0:
        return (rank + 1) * near.agg(F.min("d")).first()[0]
    at = min(rank, held - 1)
    if not few:
        return quantiles(near, "d", [at / max(held - 1, 1)])[0]
    upto = written(running_totals(near, ["d"], {"c": "n"}))
    one, two = (upto.where(F.col("c") > k).agg(F.min("d")).first()[0] for k in (math.floor(at), math.ceil(at)))
    return one if one == two else (math.ceil(at) - at) * one + (at - math.floor(at)) * two


def start_and_end_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes in the lowest and in the highest third of the score ``pt``, the thirds' edges included."""
    low, high = quantiles(nodes, "pt", [1 / 3, 2 / 3])
    return nodes.where(F.col("pt") <= low), nodes.where(F.col("pt") >= high)


def line_distances(nodes: DataFrame, starts: DataFrame, ends: DataFrame, far: float, near: float) -> DataFrame:
    """``src, dst, node, x, y, pt, d``: distance in (x, y, pt) of each node within ``far`` of a start to the line from it to an end ``near`` to ``far`` away."""
    place = lambda c, n: nodes.select(F.col("spot_id").alias(c), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"), F.col("pt").alias(f"{n}p"))
    lines = pairs_within(starts, ends, far, near).select("src", "dst").join(place("src", "a"), "src").join(place("dst", "b"), "dst")
    lines = lines.select("src", "dst", "ax", "ay", "ap", *[(F.col(f"b{c}") - F.col(f"a{c}")).alias(f"w{c}") for c in "xyp"])
    lines = written(lines.withColumn("ll", F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy") + F.col("wp") * F.col("wp")))  # what is a line's own is worked out once
    local = pairs_within(starts, nodes, far).select("src", F.col("dst").alias("node")).union(starts.select("spot_id", "spot_id"))
    local = written(local.join(nodes.select(F.col("spot_id").alias("node"), "x", "y", "pt"), "node"))
    both = lines.join(local, "src")
    px, py, pp = F.col("x") - F.col("ax"), F.col("y") - F.col("ay"), F.col("pt") - F.col("ap")
    flat = px * F.col("wx") + py * F.col("wy")
    dot = flat + pp * F.col("wp")
    d = F.sqrt(F.greatest(px * px + py * py + pp * pp - dot * dot / F.col("ll"), F.lit(0.0)))
    return both.select("src", "dst", "node", "x", "y", "pt", flat.alias("along"), d.alias("d"))


def rising(pt: np.ndarray, drop: float, least: int) -> np.ndarray:
    """Positions left after taking out, again and again, every node from which the score falls by more than ``drop``."""
    kept = np.arange(len(pt))
    while len(kept) > 1 and (falls := np.diff(pt[kept]) < -drop).any():
        kept = kept[np.append(~falls, True)]
        if len(kept) < least:
            break
    return kept


def near_line_paths(distances: DataFrame, line_cut: float, drop: float, gap: float, least: int, fewest: int = 5) -> DataFrame:
    """``src, dst, nodes``: nodes within ``line_cut`` of a line of :func:`line_distances`, in their order along it, from low to high score.

    Lines with less than ``fewest`` such nodes go.  Nodes before a fall of more than ``drop`` are taken out; paths with a step of ``gap`` or more
    or with less than ``least`` nodes go.
    """
    close = written(distances.where(F.col("d") <= line_cut).drop("d"))
    found = close.groupBy("src", "dst").agg(F.sort_array(F.collect_list(F.struct("along", "node", "x", "y", "pt"))).alias("near")).where(F.size("near") >= fewest)  # the nodes along one line
    found = found.select("src", "dst", "near.node", "near.x", "near.y", "near.pt")  # an array of each

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, node, x, y, pt in zip(pdf["src"].tolist(), pdf["dst"].tolist(), *(pdf[c] for c in ("node", "x", "y", "pt")), strict=True):
                order = slice(None, None, -1) if pt[0] > pt[-1] else slice(None)
                node, x, y, pt = node[order], x[order], y[order], pt[order]
                kept = rising(pt, drop, least)
                if len(kept) >= max(least, 2) and np.hypot(np.diff(x[kept]), np.diff(y[kept])).max() < gap:
                    out.append((a, b, node[kept].tolist()))
            yield pd.DataFrame(out, columns=["src", "dst", "nodes"])

    return found.mapInPandas(thin, "src long, dst long, nodes array<long>")


#: Cells of one array of lines and the nodes around their start.
_BLOCK = 200_000


def _risen(row: np.ndarray, node: np.ndarray, pt: np.ndarray, drop: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`rising` for many paths in step: (row, node) of what is left of ``row`` (ascending) and ``node``; rows with less than ``least`` nodes go."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(row):
        v = pt[node]
        falls = (row[1:] == row[:-1]) & (np.diff(v) < -drop)
        open_ = np.zeros(row[-1] + 1, bool)
        open_[row[:-1][falls]] = True
        more = open_[row]
        done.append((row[~more], node[~more]))
        kept = more & np.append(~falls, True)
        row, node = row[kept], node[kept]
        enough = np.bincount(row)[row] >= least if len(row) else np.zeros(0, bool)
        row, node = row[enough], node[enough]
    row, node = (np.concatenate([d[k] for d in done] or [np.zeros(0, int)]) for k in (0, 1))
    order = np.argsort(row, kind="stable")  # a path is done at once, so its nodes stay in order
    return row[order], node[order]


def line_paths(nodes: DataFrame, starts: DataFrame, ends: DataFrame, far: float, near: float, line_cut: float, drop: float, gap: float, least: int, fewest: int = 5) -> DataFrame:
    """``src, dst, nodes``: the paths that :func:`near_line_paths` makes of :func:`line_distances`, without a table of lines and nodes.

    A cell as wide as ``far`` brings its starts and the nodes and ends of the cells around to one task, which takes start by start: where ``line_cut`` is wide, a
    start's lines times its nodes are many more than the paths they leave.  What is dealt is nine times the nodes.
    """
    cell = [F.floor(F.col(c) / far).cast("long").alias(n) for c, n in (("x", "cx"), ("y", "cy"))]
    side = lambda df, role: df.where("x is not null and y is not null").select(F.col("spot_id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "pt")], *cell, F.lit(role).alias("role"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    others = side(nodes, 1).unionByName(side(ends, 2)).withColumn("o", around).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o")
    least = max(least, 2)

    def of_start(a: tuple, other: tuple, end: tuple) -> list[tuple]:
        i, ax, ay, ap = a
        (ids, x, y, pt), (goal, ex, ey, ep) = other, end
        apart = lambda u, v: np.sqrt((u - ax) * (u - ax) + (v - ay) * (v - ay))
        d = apart(ex, ey)
        asked = (goal != i) & (d >= near) & (d <= far)
        local = (apart(x, y) <= far) | (ids == i)
        goal, wx, wy, wp = goal[asked], *(w[asked, None] for w in (ex - ax, ey - ay, ep - ap))
        ids, x, y, pt = ids[local], x[local], y[local], pt[local]
        px, py, pp = x - ax, y - ay, pt - ap
        own, ll, out = px * px + py * py + pp * pp, wx * wx + wy * wy + wp * wp, []
        each = max(_BLOCK // max(len(ids), 1), 1)
        for k in range(0, len(goal), each):
            to = slice(k, k + each)
            flat = px * wx[to] + py * wy[to]
            dot = flat + pp * wp[to]
            close = np.sqrt(np.maximum(own - dot * dot / ll[to], 0.0)) <= line_cut
            n = close.sum(axis=1)
            some = np.flatnonzero(n >= max(fewest, 1))
            if not len(some):
                continue
            n, order = n[some], np.argsort(np.where(close[some], flat[some], np.inf), axis=1, kind="stable")  # of equal places the smaller node comes first
            first, last = pt[order[:, 0]], pt[order[np.arange(len(some)), n - 1]]
            row = np.repeat(np.arange(len(some)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            node = order[row, np.where((first > last)[row], n[row] - 1 - at, at)]  # from low to high
            row, node = _risen(row, node, pt, drop, least)
            same = row[1:] == row[:-1]
            wide = ~(np.hypot(np.diff(x[node]), np.diff(y[node])) < gap)
            count = np.bincount(row, minlength=len(some))
            fits = count >= least
            fits[row[1:][same & wide]] = False
            kept = fits[row]
            if kept.any():
                lines = np.flatnonzero(fits)
                parts = np.split(ids[node[kept]], np.cumsum(count[lines])[:-1])
                out += [(i, b, p.tolist()) for b, p in zip(goal[to][some[lines]].tolist(), parts, strict=True)]
        return out

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        columns = [rows[c].to_numpy() for c in ("id", "x", "y", "pt")]
        role = rows["role"].to_numpy()
        here, other, end = ([c[role == k] for c in columns] for k in (0, 1, 2))
        out: list[tuple] = []
        if len(here[0]) and len(end[0]):
            for a in zip(*(c.tolist() for c in here), strict=True):
                out += of_start(a, other, end)
        return pd.DataFrame(out, columns=["src", "dst", "nodes"])

    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = side(starts, 0).unionByName(others).repartition(parts, "cx", "cy").groupBy("cx", "cy")
    return dealt.applyInPandas(search, "src long, dst long, nodes array<long>")


def all_paths(nodes: DataFrame, unit: float, gap: float, line_cut: float | None = None, drop: float | None = None, least: int = 5, reach: float = 1.3, line_share: float = 0.001, drop_share: float = 0.05) -> dict[str, DataFrame]:
    """``line``, ``space`` and ``score``: ``src, dst, nodes`` of the candidates from the lowest to the highest third of the scores of ``nodes`` (``spot_id, x, y, pt``).

    ``line`` from nodes near a straight line of 3 to 10 units; the others are shortest paths of more than 4 units from low to high scores, weighted by distance or by gap in score,
    that rise by more than the score's 2/9 quantile.  ``line_cut`` is the quantile ``line_share`` of all distances of two
    nodes if it is not given, ``drop`` the quantile ``drop_share`` of all differences of two scores.
    """
    nodes = written(nodes.select("spot_id", "x", "y", "pt"))
    if nodes.isEmpty():
        none = nodes.select(F.col("spot_id").alias("src"), F.col("spot_id").alias("dst"), F.array("spot_id").alias("nodes"))
        return {"line": none, "space": none, "score": none}
    line_cut = pairwise_quantile(nodes, line_share, unit) if line_cut is None else line_cut
    drop = difference_quantile(nodes, "pt", drop_share) if drop is None else drop
    starts, ends = start_and_end_nodes(nodes)
    line = line_paths(nodes, starts, ends, 10 * unit, 3 * unit, line_cut, drop, gap, least)
    edges = neighbours(nodes, reach * unit)
    rise = quantiles(nodes, "pt", [2 / 9])[0] or 0.0
    targets = nodes.withColumnRenamed("spot_id", "dst")
    score = nodes.select("spot_id", F.col("pt").alias("score"))
    trees = lambda ws, wp: gradient_paths(starts.select(F.col("spot_id").alias("src")), weighted(edges, score, ws, wp), targets, rise, 4 * unit, least).select("src", "dst", "nodes")
    return {"line": line, "space": trees(1, 0), "score": trees(0, 1)}


def merged_paths(found: dict[str, DataFrame]) -> DataFrame:
    """``path_id, nodes``: the distinct paths of all sets, named by a hash of their nodes."""
    out = None
    for paths in found.values():
        own = paths.select("nodes")
        out = own if out is None else out.unionByName(own)
    return out.distinct().select(F.xxhash64("nodes").alias("path_id"), "nodes")


def selected_genes(values: DataFrame, spots: DataFrame, surface: list[str], stage: list[str], exhaustion: list[str], least: float = 0.2, p_cut: float = 0.001, value: str = "value") -> list[str]:
    """Stage markers whose expression goes with the surface markers' in ``spots``, and all exhaustion markers."""
    found = marker_correlations(values, spots, surface, value).where((F.col("p") < p_cut) & (F.col("rho") > least) & F.col("gene").isin(stage))
    return sorted({r["gene"] for r in found.collect()} | set(exhaustion))  # at most the stage markers asked for


def path_selection(found: dict[str, DataFrame], nodes: DataFrame, values: DataFrame, genes: list[str], unit: float, top_percent: float = 25.0, reach: float = 1.3, most: int = 6, value: str = "value") -> DataFrame:
    """``path_id, nodes, r, best, n_alt``: the paths of :func:`all_paths` that hang together better than their alternatives nearby."""
    paths = written(merged_paths(found))
    edges = neighbours(nodes, reach * unit).select("src", "dst", F.col("d").alias("weight"))
    others = written(second_alternatives(paths, edges, nodes, 10 * unit, most))
    return paths.join(coherent_paths(paths, others, values, genes, top_percent, value), "path_id")


def random_pairs(nodes: DataFrame, near: float, far: float, wanted: int, seed: int = 1) -> DataFrame:
    """``src, dst`` (src < dst): ``wanted`` different pairs of nodes ``near`` to ``far`` apart, all alike likely; all such pairs if there are fewer.

    Nodes are numbered in cells as wide as ``far``.  A cell and one around it, itself included, stand for as many pairs as their numbers of nodes multiply to; each
    draws its share of the pairs needed, by hashes, as two numbers of nodes.  Draws too near or too far go and rounds follow until there are enough, so pairs not
    drawn are never made; only where there are hardly more pairs than wanted all are listed.
    """
    cell = lambda c: F.floor(F.col(c) / far).cast("long")
    placed = nodes.select(F.col("spot_id").alias("id"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    number = F.row_number().over(Window.partitionBy("cx", "cy").orderBy("id")) - 1  # the nodes of one cell
    placed = written(placed.withColumn("k", number))
    sizes = placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = sizes.withColumn("o", F.explode(shifts)).select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("n").alias("na"), (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    cells = written(around.join(sizes, ["cx", "cy"]).withColumn("w", F.col("na") * F.col("n")))
    total = cells.agg(F.sum("w")).first()[0] or 0
    if total <= 8 * wanted:  # the bound of what is listed
        pairs = written(pairs_within(nodes, nodes, far, near).where("src < dst").select("src", "dst").withColumn("_h", F.xxhash64(F.lit(seed), "src", "dst")))
        return smallest(pairs, "_h", wanted).select("src", "dst")
    found, drawn, turn = None, 0, 0
    while True:
        share = 4.0 * wanted / total
        times = F.floor(F.col("w") * share + (F.xxhash64(F.lit(seed), F.lit(turn), "ax", "ay", "cx", "cy").cast("double") / 2.0**64 + 0.5)).cast("int")
        draws = cells.withColumn("t", times).where("t > 0").withColumn("t", F.explode(F.sequence(F.lit(1), F.col("t"))))
        pick = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.lit(salt), "ax", "ay", "cx", "cy", "t"), F.col(n)).cast("int")  # noqa: E731, B023
        draws = draws.select("ax", "ay", "cx", "cy", pick(1, "na").alias("ka"), pick(2, "n").alias("k"))
        at = lambda c, k, x, y, p: placed.select(F.col("cx").alias(x), F.col("cy").alias(y), F.col("k").alias(k), F.col("id").alias(c), F.col("x").alias(f"x_{p}"), F.col("y").alias(f"y_{p}"))
        met = draws.join(at("a", "ka", "ax", "ay", "a"), ["ax", "ay", "ka"]).join(at("b", "k", "cx", "cy", "b"), ["cx", "cy", "k"])
        d = F.sqrt(F.pow(F.col("x_a") - F.col("x_b"), 2) + F.pow(F.col("y_a") - F.col("y_b"), 2))
        fit = met.where((F.col("a") != F.col("b")) & (d >= near) & (d <= far)).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        found = written(fit if found is None else found.union(fit).distinct())
        drawn, turn = drawn + 4.0 * wanted, turn + 1
        if found.count() >= wanted or drawn > 30.0 * total:  # so many draws miss no pair
            hashed = written(found.withColumn("_h", F.xxhash64(F.lit(seed), "src", "dst")))
            return smallest(hashed, "_h", wanted).select("src", "dst")


def random_paths(nodes: DataFrame, unit: float, wanted: int, near: float = 3.0, far: float = 7.0, reach: float = 1.3, seed: int = 1) -> DataFrame:
    """``path_id, src, dst, cost, nodes``: shortest paths between ``wanted`` pairs of nodes ``near`` to ``far`` units apart, drawn by a hash (see :func:`random_pairs`)."""
    drawn = random_pairs(nodes, near * unit, far * unit, wanted, seed)
    edges = neighbours(nodes, reach * unit).select("src", "dst", F.col("d").alias("weight"))
    return shortest_paths(drawn.select(F.xxhash64("src", "dst").alias("path_id"), "src", "dst"), edges, places=nodes)


def control_paths(paths: DataFrame, nodes: DataFrame, unit: float, wanted: int, sets: int, near: float = 3.0, far: float = 7.0, seed: int = 1) -> DataFrame:
    """``set_id, path_id, nodes``: per set as many random paths as ``paths`` (``path_id, nodes``) has of each length and commonest cluster.

    Random paths run through nodes (``spot_id, x, y, cluster``) of the paths' clusters that no path meets.
    """
    strata = lambda df: df.select("path_id", F.size("nodes").alias("length")).join(most_common(df.select("path_id", F.explode("nodes").alias("spot_id")).join(nodes, "spot_id"), ["path_id"], "cluster", "cluster"), "path_id")
    own = written(strata(paths))
    met = paths.select(F.explode("nodes").alias("spot_id")).distinct()
    free = nodes.join(own.select("cluster").distinct(), "cluster", "left_semi").join(met, "spot_id", "left_anti")
    pool = written(random_paths(written(free), unit, wanted, near, far, seed=seed))
    asked = own.groupBy("length", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return control_sets(strata(pool), asked, sets, seed).join(pool.select("path_id", "nodes"), "path_id").select("set_id", "path_id", "nodes")
