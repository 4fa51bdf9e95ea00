"""Lattice spin operators: energies, conditional probabilities, segment ends and their bonus, sampling chains."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import discard, written


def energy(edges: DataFrame, states: DataFrame) -> DataFrame:
    """``n_pairs, spin_sum, net_agreement`` over undirected pairs, from edges in both directions."""
    s = lambda side: states.select(F.col("spot_id").alias(side), F.col("s").alias(f"s_{side}"))
    both = edges.join(s("src"), "src").join(s("dst"), "dst")
    got = both.agg((F.count(F.lit(1)) / 2).alias("n_pairs"), (F.sum(F.col("s_src") * F.col("s_dst")) / 2).alias("spin_sum"))
    return got.withColumn("net_agreement", F.col("spin_sum") / F.col("n_pairs"))


def flip_probability(j: float, neighbour_sum: Column) -> Column:
    return 1 / (1 + F.exp(-2 * j * neighbour_sum))


def conditional(edges: DataFrame, states: DataFrame, bonus: DataFrame | None, j: float, scale: float = 1.0) -> DataFrame:
    """``spot_id, p``: probability of +1 given the neighbours and the bonus: sigmoid(scale * j * (sum + n_add))."""
    s = states.select(F.col("spot_id").alias("dst"), F.col("s").alias("_s"))
    sums = edges.join(s, "dst").groupBy(F.col("src").alias("spot_id")).agg(F.sum("_s").alias("_sum"))
    out = states.select("spot_id").join(sums, "spot_id", "left")
    add = F.lit(0.0)
    if bonus is not None:
        out, add = out.join(bonus.select("spot_id", "n_add"), "spot_id", "left"), F.coalesce("n_add", F.lit(0.0))
    return out.select("spot_id", (1 / (1 + F.exp(-scale * j * (F.coalesce("_sum", F.lit(0)) + add)))).alias("p"))


def segment_ends(segments: DataFrame) -> DataFrame:
    """``spot_id, direction`` of first and last spots of segments, in each direction and its opposite.

    ``segments`` has ``direction, line_id, seg_no, pos, spot_id``.
    """
    ends = segments.groupBy("direction", "line_id", "seg_no").agg(F.min_by("spot_id", "pos").alias("a"), F.max_by("spot_id", "pos").alias("b"))
    one = ends.select("direction", F.explode(F.array("a", "b")).alias("spot_id")).distinct()
    return one.select("spot_id", F.explode(F.array(F.col("direction"), F.col("direction") - 180)).alias("direction"))


def end_bonus(ends: DataFrame, edges: DataFrame, steep: DataFrame, margins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``spot_id, n_add``, edges that stay regular).

    An end that is no margin gives a bonus to the neighbour exactly in its direction, if that neighbour is steep
    in that direction (``spot_id, direction`` in ``steep``) and is not itself such an end of that direction.  Those ends leave the
    neighbour's regular edges.  ``edges`` has ``src, dst, direction``.
    """
    inner = ends.join(margins.select("spot_id"), "spot_id", "left_anti")
    met = edges.join(inner.withColumnRenamed("spot_id", "src"), ["src", "direction"])
    met = met.join(steep.select(F.col("spot_id").alias("dst"), "direction").distinct(), ["dst", "direction"], "left_semi")
    met = written(met.join(inner.withColumnRenamed("spot_id", "dst"), ["dst", "direction"], "left_anti").select("src", "dst"))
    bonus = met.groupBy(F.col("dst").alias("spot_id")).agg(F.count(F.lit(1)).alias("n_add"))
    regular = edges.join(met.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    return bonus, regular


def steep_spots(slopes: DataFrame, cut: float = -0.01) -> DataFrame:
    """``spot_id, direction`` where counts fall: a slope of ``cut`` or less (null: none), seen along the direction or against it.

    ``slopes`` has ``spot_id, direction, slope``; against a direction the slope has the other sign.
    """
    ways = F.array(F.struct("direction", "slope"), F.struct((F.col("direction") - 180).alias("direction"), (-F.col("slope")).alias("slope")))
    return slopes.select("spot_id", F.explode(ways).alias("d")).where(F.col("d.slope") <= cut).select("spot_id", "d.direction")


# -------------------------------------------------------------------- chains

#: Share of the spots that a Metropolis sweep offers a flip; with all of them, a chain without coupling would only turn over as a whole.
OFFERED = 0.75

#: Side of a tile in mean edge lengths.
TILE = 32.0

#: Chains whose states share a row; more chains make more rows a spot.
LANE = 512

#: Chains that are swept together.
WIDE = 32

#: Spots times chains swept together that a task takes at a time, where there are enough tiles.
AT_ONCE = 65_536

_STATE = "_lane int, spot_id long, x double, y double, near array<long>, n_add double, s binary, hits binary, n long, pairs binary, rests boolean"


def _graph(nodes: DataFrame, edges: DataFrame, bonus: DataFrame | None, name: list[str]) -> DataFrame:
    """``spot_id, x, y, near, n_add`` of every node: its place, its neighbours among the nodes and its field."""
    place = ["x", "y"] if {"x", "y"} <= set(nodes.columns) else []
    nodes = nodes.select(*name, "spot_id", *place)
    nodes = nodes if place else nodes.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    pairs = edges.select(*name, F.col("src").alias("spot_id"), "dst").where("spot_id <> dst").distinct()
    known = pairs.join(nodes.select(*name, F.col("spot_id").alias("dst")), [*name, "dst"], "left_semi")
    near = known.groupBy(*name, "spot_id").agg(F.collect_list("dst").alias("near"))  # the neighbours of one spot
    rows = nodes.join(near, [*name, "spot_id"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<bigint>")))
    if bonus is None:
        return rows.withColumn("n_add", F.lit(0.0))
    return rows.join(bonus.select(*name, "spot_id", F.col("n_add").cast("double").alias("n_add")), [*name, "spot_id"], "left").na.fill(0.0, ["n_add"])


def _tile_side(graph: DataFrame, name: list[str], tile: float) -> float:
    """Side of the tiles: ``tile`` mean edge lengths, four of the longest edge at least, so that every spot is inside some tile."""
    far = graph.select(*name, "x", "y", F.explode("near").alias("near"))
    far = far.join(graph.select(*name, F.col("spot_id").alias("near"), F.col("x").alias("u"), F.col("y").alias("v")), [*name, "near"])
    d = F.sqrt(F.pow(F.col("x") - F.col("u"), 2) + F.pow(F.col("y") - F.col("v"), 2))
    mean, longest = far.agg(F.avg(d), F.max(d)).first()
    return max(tile * (mean or 0.0), 4 * (longest or 0.0)) or 1.0


def _classes(near: np.ndarray, free: np.ndarray) -> list[np.ndarray]:
    """The free nodes in classes without an edge inside: a class is drawn at once, which leaves the sampled distribution as it is."""
    colour, rows = [-1] * (len(near) + 1), near.tolist()
    for i in np.flatnonzero(free).tolist():
        used = {colour[k] for k in rows[i]}
        colour[i] = next(c for c in range(len(used) + 1) if c not in used)
    of = np.array(colour[:-1])
    return [np.flatnonzero(of == c) for c in range(of.max(initial=-1) + 1)]


def _neighbour_sums(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``x`` that each column of ``near`` names."""
    kind = np.int8 if len(near) < 128 else np.int16 if len(near) < 32_768 else np.int32
    total = np.zeros((near.shape[1], x.shape[1]), kind)
    for k in near:
        total += np.take(x, k, axis=0)
    return total


def _in_tile(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours as positions, whether all of a node's neighbours are in its tile) of the rows of tiles, which go by ``spot_id``; position n is nobody."""
    ids, tile, n = rows["spot_id"].to_numpy(), rows["_tile"].to_numpy(), len(rows)
    lens = np.array([len(v) for v in rows["near"]], np.int64)
    owner = np.repeat(np.arange(n), lens)
    other = np.concatenate([*rows["near"], np.empty(0, np.int64)]).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, other), n - 1)
    here = (ids[at] == other) & (tile[at] == tile[owner])
    near = np.full((n, int(lens.max(initial=0))), n)
    near[owner, np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)] = np.where(here, at, n)
    free = np.ones(n, bool)
    free[owner[~here]] = False
    return near, free


def _draws(n: int, own: int, sweeps: int, tiles: list[tuple[np.ndarray, np.random.Generator]]) -> Iterator[np.ndarray]:
    """Uniform draws of ``n`` spots for each sweep; each tile has its own stream, so it does not matter which tiles share a task."""
    some = max(1, min(sweeps, 2**20 // max(n * own, 1)))
    for begin in range(0, sweeps, some):
        now = min(some, sweeps - begin)
        u = np.empty((now, n, own), np.float32)
        for places, rng in tiles:
            u[:, places] = rng.random((now, len(places), own), np.float32)
        yield from u


def _run_block(rows: pd.DataFrame, lanes: list[np.ndarray], kind: str, scale: float, seed: int, block: int, sweeps: int, first: int) -> pd.DataFrame:
    """``sweeps`` sweeps over the free spots of tiles; from sweep ``first`` on, states (or products of neighbours) are counted.

    Spots go by class, then tile, so that a step is a stretch of each array.
    """
    rows = rows.sort_values("spot_id", ignore_index=True)
    n, lane = len(rows), int(rows["_lane"].iloc[0])
    size = lanes[lane].shape[1]
    near, free = _in_tile(rows)
    classes, tile = _classes(near, free), pd.factorize(rows["_tile"])[0]
    order = np.concatenate([*(c[np.argsort(tile[c], kind="stable")] for c in classes), np.flatnonzero(~free)])
    ends = np.cumsum([0, *(len(c) for c in classes)]).tolist()
    moved = np.full(n + 1, n)
    moved[order] = np.arange(n)
    near = np.ascontiguousarray(moved[near[order]].T)
    swept = tile[order][: ends[-1]]
    names = [int(rows["spot_id"].iloc[k]) & 0x7FFFFFFF for k in np.unique(tile, return_index=True)[1]]
    start = np.frombuffer(b"".join(rows["s"]), np.int8).reshape(n, size)
    state, hits, pairs = np.empty((n, size), np.int8), np.zeros((n, size), np.int32), np.zeros(size)
    for at in range(0, size, WIDE):
        own = slice(at, min(at + WIDE, size))
        j, factor = (lanes[lane][k, own].astype(np.float32) for k in (1, 2))
        x = np.zeros((n + 1, own.stop - at), np.int8)
        x[:n] = start[order, own]
        field = rows["n_add"].to_numpy(np.float32)[order, None] * factor
        tiles = [(np.flatnonzero(swept == k), np.random.default_rng([seed, block, (lane * LANE + at) // WIDE, name])) for k, name in enumerate(names)]
        seen, both = np.zeros((ends[-1], own.stop - at), np.int32), np.zeros(own.stop - at)
        with np.errstate(over="ignore"):  # an overflow stands for a step that is certain
            for sweep, u in enumerate(_draws(ends[-1], own.stop - at, sweeps, tiles)):
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    total = _neighbour_sums(x, near[:, a:b])
                    if kind == "gibbs":
                        plus = u[a:b] < 1 / (1 + np.exp((total + field[a:b]) * np.float32(-scale) * j))
                        x[a:b] = 2 * plus.view(np.int8) - 1
                    else:
                        flip = u[a:b] < np.minimum(np.float32(OFFERED) * np.exp((total * x[a:b]) * (np.float32(-2 * scale) * j)), np.float32(OFFERED))
                        x[a:b] *= 1 - 2 * flip.view(np.int8)
                if sweep >= first and kind == "gibbs":
                    seen += x[: ends[-1]] > 0
                elif sweep >= first:
                    both += (x[:n] * _neighbour_sums(x, near)).sum(axis=0, dtype=np.int64) / 2
        state[order, own], hits[order[: ends[-1]], own], pairs[own] = x[:n], seen, both
    counted = max(sweeps - first, 0)
    rows["s"], rows["rests"] = [v.tobytes() for v in state], ~free
    if kind == "gibbs" and counted:
        rows["hits"] = [(np.frombuffer(h, np.int32) + v).tobytes() for h, v in zip(rows["hits"], hits, strict=True)]
        rows["n"] += np.where(free, counted, 0)
    if kind != "gibbs":
        rows["pairs"] = [pairs.tobytes(), *[None] * (n - 1)]
    return rows.drop(columns=["_tile", "_deal"], errors="ignore")


def _block_kernel(*order):
    return lambda rows: _run_block(rows, *order)


def _chained(nodes: DataFrame, edges: DataFrame, bonus: DataFrame | None, chains: DataFrame, kind: str, sweeps: int, first: int, block: int, scale: float, seed: int, sample: str | None, tile: float, watch=None) -> tuple[DataFrame, list[np.ndarray], list[str]]:
    """(the spots after the last block, chains a lane, name columns); ``watch(spots, tile column, lanes, counted sweeps)`` sees every block that counts.

    A block is one job: spots are dealt to square tiles, and a task sweeps, some tiles at a time, those spots whose neighbours are all in their tile, while the others keep
    their states.  No two such spots of different tiles are neighbours, so every step is a step of one chain.  Each block moves the
    tiles' grid, and what was at a border comes inside.  States start from a hash of chain and spot.
    """
    spark, name = nodes.sparkSession, [sample] if sample else []
    asked = sorted((r["chain"], r["j"], r["factor"]) for r in chains.collect())  # one row a chain asked for
    lanes = [np.array(asked[i : i + LANE]).T for i in range(0, len(asked), LANE)]
    graph = written(_graph(nodes, edges, bonus, name))
    side = _tile_side(graph, name, tile)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    wide = min(WIDE, max(lane.shape[1] for lane in lanes))
    deals = parts * max(1, round(graph.count() * len(lanes) * wide / AT_ONCE / parts))
    salts = [[np.uint64((int(c) * 1_000_003 + seed) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for c in lane[0]] for lane in lanes]

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["spot_id"].to_numpy(np.int64).view(np.uint64)
            for k, own in enumerate(salts):
                bits = np.stack([pd.util.hash_array(ids + c) >> np.uint64(63) for c in own], axis=1).astype(np.int8)
                yield pdf.assign(_lane=k, s=[v.tobytes() for v in 2 * bits - 1], hits=bytes(4 * len(own) if kind == "gibbs" else 0), n=0, pairs=None, rests=True)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in graph.select(*name).schema.fields), _STATE])
    state, done, k = graph.mapInPandas(start, schema), 0, 0
    while done < sweeps:
        place = lambda c, step: F.floor(F.col(c) / side + F.lit((k * step) % 1.0)).cast("long")  # noqa: E731, B023
        spot = F.xxhash64(place("x", 0.7548776662466927), place("y", 0.5698402909980532))  # steps of a sequence that fills the square evenly
        now = min(block, sweeps - done)
        order = (lanes, kind, scale, seed, k, now, max(first - done, 0))
        dealt = state.withColumn("_tile", spot).withColumn("_deal", F.pmod(F.xxhash64("_lane", "_tile"), F.lit(deals)).cast("int"))
        dealt = dealt.repartitionById(parts, F.pmod("_deal", F.lit(parts)))
        after = written(dealt.groupBy(*name, "_lane", "_deal").applyInPandas(_block_kernel(*order), schema))
        done, k = done + now, k + 1
        if watch and done > first:
            watch(after, spot, lanes, min(done - first, now))
        discard(state)
        state = after
    discard(graph)
    return state, lanes, name


def metropolis(nodes: DataFrame, edges: DataFrame, chains: DataFrame, sweeps: int = 60, tail: int = 10, seed: int = 1, sample: str | None = None, block: int = 20, tile: float = TILE) -> DataFrame:
    """``chain, j, mean_sum`` (and ``sample``): mean spin-product sum over the last ``tail`` sweeps of a Metropolis chain at coupling ``j``.

    A sweep offers three of four spots a flip, accepted with probability exp(j * change of the sum), so a chain moves as much on a large
    sample as on a small one.  ``nodes`` has ``spot_id`` and ``x, y``, by which tasks share a graph, ``block`` sweeps at a time (see :func:`_chained`); without places all of
    it is one tile.
    """
    name, sums = [sample] if sample else [], []

    def watch(state: DataFrame, spot: Column, lanes: list[np.ndarray], counted: int) -> None:
        """Sums of this block: pairs inside a tile were counted in every sweep, those across tiles rested."""
        rows, edge = state.withColumn("_tile", spot), state.where("rests").withColumn("_tile", spot)  # a pair across tiles is one of resting spots
        ends = edge.select(*name, "_lane", "_tile", "s", F.explode("near").alias("near"))
        other = edge.select(*name, "_lane", F.col("_tile").alias("_other"), F.col("s").alias("_s"), F.col("spot_id").alias("near"))
        across = ends.join(other, [*name, "_lane", "near"]).where("_tile <> _other").select(*name, "_lane", "s", "_s", F.lit(None).cast("binary").alias("pairs"))
        both = across.unionByName(rows.where("pairs is not null").select(*name, "_lane", "s", F.lit(None).cast("binary").alias("_s"), "pairs"))

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for key, own in pdf.groupby([*name, "_lane"], dropna=False):
                    size, crossed = lanes[int(key[-1])].shape[1], own[own["pairs"].isna()]
                    value = np.frombuffer(b"".join(own["pairs"].dropna()), np.float64).reshape(-1, size).sum(axis=0)
                    if len(crossed):
                        a, b = (np.frombuffer(b"".join(crossed[c]), np.int8).reshape(-1, size).astype(np.int16) for c in ("s", "_s"))
                        value = value + counted * (a * b).sum(axis=0) / 2
                    total[key] = total.get(key, 0) + value
            out = [(*key[:-1], int(c), float(j), float(v)) for key, value in total.items() for c, j, v in zip(*lanes[int(key[-1])][:2], value, strict=True)]
            yield pd.DataFrame(out, columns=[*name, "chain", "j", "v"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in state.select(*name).schema.fields), "chain long, j double, v double"])
        sums.append(written(both.mapInPandas(add, schema).groupBy(*name, "chain", "j").agg(F.sum("v").alias("v"))))

    chains = chains.select("chain", "j", F.lit(0.0).alias("factor"))
    discard(_chained(nodes, edges, None, chains, "metropolis", sweeps, sweeps - tail, block, 1.0, seed, sample, tile, watch)[0])
    return functools.reduce(lambda a, b: a.unionByName(b), sums).groupBy(*name, "chain", "j").agg((F.sum("v") / tail).alias("mean_sum"))


def gibbs(nodes: DataFrame, edges: DataFrame, bonus: DataFrame, chains: DataFrame, sweeps: int = 5000, burn_in: int = 2000, scale: float = 1.0, seed: int = 1, sample: str | None = None, block: int | None = None, tile: float = TILE) -> DataFrame:
    """``chain, spot_id, prob`` (and ``sample``): share of sweeps after ``burn_in`` in which a spot is +1.

    ``chains`` has ``chain, j, factor``; the field on a spot is ``factor * n_add``.  ``nodes`` has ``spot_id`` and ``x, y``, by which tasks share a graph
    (see :func:`_chained`); without places all of it is one tile.  A block has ``block`` sweeps (default: a tenth of all); blocks in which a spot rests do not count
    for it, unless it rests in all of them.
    """
    block = block or max(-(-sweeps // 10), 1)
    state, lanes, name = _chained(nodes, edges, bonus, chains.select("chain", "j", "factor"), "gibbs", sweeps, burn_in, block, scale, seed, sample, tile)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lane, own in pdf.groupby("_lane"):
                names = lanes[int(lane)][0].astype(np.int64)
                hits = np.frombuffer(b"".join(own["hits"]), np.int32).reshape(len(own), -1)
                last = np.frombuffer(b"".join(own["s"]), np.int8).reshape(len(own), -1) > 0
                n = own["n"].to_numpy()[:, None]
                prob = np.where(n > 0, hits / np.maximum(n, 1), last)
                out = own[name].iloc[np.repeat(np.arange(len(own)), len(names))].reset_index(drop=True)
                out["chain"], out["spot_id"], out["prob"] = np.tile(names, len(own)), np.repeat(own["spot_id"].to_numpy(), len(names)), prob.ravel()
                yield out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in state.select(*name).schema.fields), "chain long, spot_id long, prob double"])
    return state.mapInPandas(spread, schema)


def coupling_draws(candidates: list[float], draws: int = 10, spread: float = 0.01, seed: int = 1) -> list[tuple[int, float, float]]:
    """(chain, candidate, drawn coupling): ``draws`` normal draws around each candidate mean."""
    rng = np.random.default_rng(seed)
    return [(c * draws + k, float(m), float(m + spread * z)) for c, m in enumerate(candidates) for k, z in enumerate(rng.standard_normal(draws))]


def fitted_coupling(nodes: DataFrame, edges: DataFrame, spin_sum: float, candidates: list[float], draws: int = 10, sweeps: int = 60, tail: int = 10, seed: int = 1) -> DataFrame:
    """``mu_q, abs_g`` of every candidate: how far the chains' mean sums and the prior leave the observed sum."""
    chains = nodes.sparkSession.createDataFrame(coupling_draws(candidates, draws, seed=seed), "chain long, mu_q double, j double")
    means = metropolis(nodes, edges, chains, sweeps, tail, seed)
    return coupling_grid(spin_sum, chains.select("chain", "mu_q").join(means, "chain"), 0.3, 0.0049)


def resampled_couplings(nodes: DataFrame, edges: DataFrame, sums: DataFrame, wanted: int, candidates: list[float], draws: int = 10, sweeps: int = 60, tail: int = 10, seed: int = 1) -> DataFrame:
    """``draw, spin_sum, mu_q``: the best coupling for each of ``wanted`` sums drawn from those of a simulation (``spin_sum``), how often they occur counting.

    The chains do not depend on the observed sum, so one run of them serves all draws.
    """
    spark = nodes.sparkSession
    rows = sums.groupBy("spin_sum").agg(F.count(F.lit(1)).alias("n")).orderBy("spin_sum").collect()  # one row a distinct sum
    p = np.array([r["n"] for r in rows], float)
    picked = np.random.default_rng(seed).choice(len(rows), wanted, p=p / p.sum())
    drawn = spark.createDataFrame([(i, float(rows[k]["spin_sum"])) for i, k in enumerate(picked.tolist())], "draw long, spin_sum double")
    chains = spark.createDataFrame(coupling_draws(candidates, draws, seed=seed), "chain long, mu_q double, j double")
    means = chains.select("chain", "mu_q").join(metropolis(nodes, edges, chains, sweeps, tail, seed), "chain").groupBy("mu_q").agg(F.avg("mean_sum").alias("mean_sum"))
    gap = F.abs(F.col("spin_sum") - F.col("mean_sum") - (F.col("mu_q") - 0.3) / 0.0049)
    return drawn.join(F.broadcast(means)).groupBy("draw", "spin_sum").agg(F.min_by("mu_q", F.struct(gap, "mu_q")).alias("mu_q"))  # as many means as candidates


def coupling_grid(spin_sum: float, means: DataFrame, mu: float, sigma2: float) -> DataFrame:
    """``mu_q, abs_g`` from ``mu_q, mean_sum`` of all draws: |observed - mean - (mu_q - mu) / sigma2|."""
    g = F.lit(spin_sum) - F.avg("mean_sum") - (F.col("mu_q") - mu) / sigma2
    return means.groupBy("mu_q").agg(F.abs(g).alias("abs_g"))


def transition(curve: DataFrame) -> DataFrame:
    """The factor with the largest second difference of ``percent`` over ``factor``: our default for the second coupling."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(F.lit(0)).orderBy("factor")
    bend = F.lead("percent").over(w) - 2 * F.col("percent") + F.lag("percent").over(w)
    return curve.withColumn("bend", bend).where("bend is not null").agg(F.max_by("factor", F.struct("bend", -F.col("factor"))).alias("factor"))
