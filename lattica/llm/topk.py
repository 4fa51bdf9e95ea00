"""Exact top-k inner-product search with multi-resolution segment statistics.

For a vector cut into segments, ``a`` (root of the length times the mean) and ``b`` (root of the
length times the standard deviation) of each segment bound the inner product from above:
``x.q <= sum(a_x a_q + b_x b_q)``, which is the lower bound of the squared distance
``|x|^2 + |q|^2 - 2 x.q``.  The bound is taken coarse to fine; only pairs that could still reach
the query's current k-th score get an exact product.

A task holds one block of queries and one of candidates and keeps k rows a query; a last grouped step merges
the blocks.  With more queries than one block, candidates are dealt by the signs of their coarse means, so that
the extremes of a block's statistics bound its scores closely.  Each query first meets the block of its highest
bound, which gives it a k-th score to beat; then a query is sent only to blocks whose bound reaches that
score, and a block only to those blocks of queries that still ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

LEVELS = (4, 16)
MOST_BLOCKS = 65_536  # of candidates: their summaries, about 100 bytes each, go to every task
_HUGE = 1e300


def scaled(vec: Column, factor: int = 64) -> Column:
    """Integers ``floor(factor * x)`` of each component, null unless every component is a finite number."""
    good = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(good, F.transform(vec, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; short rows are filled with zeros, components past ``width`` meet zeros only."""
    arr = col.combine_chunks()
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    lens = np.asarray(arr.value_lengths())
    flat = np.asarray(arr.flatten(), dtype=np.int64)
    if len(lens) and (lens == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lens), width), np.int64)
    ends = np.cumsum(lens)
    for i, (e, n) in enumerate(zip(ends, lens, strict=True)):
        out[i, : min(n, width)] = flat[e - n : e - n + min(n, width)]
    return out


def _statistics(m: np.ndarray, segments: int) -> np.ndarray:
    """Per row the scaled means, then the scaled deviations, of ``segments`` runs of components."""
    edges = np.unique(np.linspace(0, m.shape[1], segments + 1).astype(int))[:-1]
    size = np.diff(np.append(edges, m.shape[1]))
    total = np.add.reduceat(m, edges, axis=1)
    spread = np.maximum(np.add.reduceat(m * m, edges, axis=1) - total * total / size, 0)
    return np.hstack([total / np.sqrt(size), np.sqrt(spread)])


def _merge(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], score[keep], ids[keep]


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, score, row id) of the k best rows of the block for each query, own id left out.

    ``row_ids`` ascend, so a later row of an equal score loses the tie; ``least`` is a score known from elsewhere
    that a row must reach.
    """
    small = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0)) < 2**20
    exact_q = queries.astype(np.float64) if small else queries
    n = len(query_ids)
    least = np.full(n, -np.inf) if least is None else least.astype(float)
    floor, full = least, np.zeros(n, bool)
    stats = [(_statistics(queries.astype(np.float64), s), s) for s in LEVELS]
    q, score, ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    at, step, widest = 0, 64, max(64, min(1024, 4_000_000 // max(n, 1)))
    while at < len(row_ids):
        part, part_ids = rows[at : at + step], row_ids[at : at + step]
        at, step = at + step, min(2 * step, widest)
        use_q, use_r, alive = np.arange(n), np.arange(len(part)), np.ones((n, len(part)), bool)
        for own, s in stats:  # whole rows and columns without a survivor leave the next level
            bound = own[use_q] @ _statistics(part[use_r].astype(np.float64), s).T
            alive = alive & (bound + 1e-6 * np.abs(bound) + 1e-3 >= floor[use_q, None])
            keep_q, keep_r = alive.any(axis=1), alive.any(axis=0)
            use_q, use_r, alive = use_q[keep_q], use_r[keep_r], alive[np.ix_(keep_q, keep_r)]
        if not alive.size:
            continue
        exact = exact_q[use_q] @ (part[use_r].astype(np.float64) if small else part[use_r]).T
        reach = np.where(full[use_q, None], exact > floor[use_q, None], exact >= floor[use_q, None])
        alive &= reach & (query_ids[use_q, None] != part_ids[use_r])
        i, j = np.nonzero(alive)
        q, score, ids = _merge(np.concatenate([q, use_q[i]]), np.concatenate([score, exact[i, j].astype(np.int64)]), np.concatenate([ids, part_ids[use_r[j]]]), k)
        counts = np.bincount(q, minlength=n)
        last = np.cumsum(counts) - 1
        kth = score[np.maximum(last, 0)].astype(float) if len(score) else np.zeros(n)
        full = (counts == k) & (kth >= least)
        floor = np.where(full, kth, least)
    return q, score, ids


def _search(k: int):
    """Kernel over one block of queries (``id, v`` and perhaps ``least``) and one of candidates (``id, v``)."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "id", "score")})
        width = int(max(np.asarray(left["v"].combine_chunks().value_lengths()).max(), 1))
        ids, q_ids = np.asarray(right["id"]), np.asarray(left["id"])
        order = np.argsort(ids, kind="stable")
        least = np.asarray(left["least"]) if "least" in left.column_names else None
        q, score, found = best_of_block(_matrix(left["v"], width), q_ids, _matrix(right["v"], width)[order], ids[order], k, least)
        return pa.table({"query_id": q_ids[q], "id": found, "score": score})

    return search


_FOUND = "query_id long, id long, score long"


def _salt(parts: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), parts)


def _with_statistics(df: DataFrame, width: int) -> DataFrame:
    """``id, v`` plus the coarse statistics ``st`` and ``cell``, the signs of the coarse means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            st = _statistics(_matrix(pa.chunked_array([batch.column("v")]), width).astype(float), LEVELS[0]) if len(batch) else np.zeros((0, 2))
            half = st.shape[1] // 2
            cell = ((st[:, :half] > 0) << np.arange(half)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(list(st), pa.list_(pa.float64())), pa.array(cell, pa.int64())], ["id", "v", "st", "cell"])

    return df.mapInArrow(run, "id long, v array<long>, st array<double>, cell long")


def block_bounds(st: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries (their statistics) in blocks (least and greatest statistics of their rows)."""
    up, down = np.maximum(st, 0), np.minimum(st, 0)
    bound = up @ high.T + down @ low.T
    return bound + 1e-6 * np.abs(bound) + 1e-3


def _dealt(queries: DataFrame, rows: DataFrame, n_r: int, width: int, k: int, query_block: int, row_block: int) -> tuple[DataFrame, DataFrame]:
    """(queries with ``qb, rb, least``, rows with ``qb, rb``): the pairs of blocks that can still matter."""
    spark, row_block = rows.sparkSession, max(row_block, -(-n_r // MOST_BLOCKS))
    placed = materialise(_with_statistics(rows, width))
    cells = {r["cell"]: -(-r["count"] // row_block) for r in placed.groupBy("cell").count().collect()}  # as many as there are patterns of signs
    names = sorted(cells)
    first = dict(zip(names, np.cumsum([0] + [cells[c] for c in names]).tolist(), strict=False))
    pick = lambda values: F.get(F.from_json(F.lit(str([values.get(c, 1) for c in range(names[-1] + 1)])), "array<bigint>"), F.col("cell").cast("int"))
    placed = placed.withColumn("rb", pick(first) + _salt(pick(cells), 2))
    size = 2 * min(LEVELS[0], width)
    ends = placed.groupBy("rb").agg(*[f(F.col("st")[i]).alias(f"{n}{i}") for i in range(size) for n, f in (("l", F.min), ("h", F.max))]).orderBy("rb").collect()  # one row a block
    numbers, low, high = np.array([r["rb"] for r in ends]), *(np.array([[r[f"{n}{i}"] for i in range(size)] for r in ends]) for n in "lh")
    shared = spark.sparkContext.broadcast((numbers, low, high))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, low, high = shared.value
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            st = np.array(batch.column("st").to_pylist()).reshape(len(batch), -1)
            at = block_bounds(st, low, high).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "st")), pa.array(numbers[at], pa.int64())], ["id", "v", "st", "rb"])

    asked = materialise(_with_statistics(queries, width).mapInArrow(home, "id long, v array<long>, st array<double>, rb long"))
    parts = asked.groupBy("rb").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("parts"))
    asked = materialise(asked.join(F.broadcast(parts), "rb").withColumn("qb", F.concat_ws("-", "rb", _salt(F.col("parts"), 1))).drop("parts"))  # at most a row a block
    blocks = lambda df: df.select(F.col("qb").alias("qb"), F.col("rb").alias("rb")).distinct()  # noqa: E731  columns of their own: both sides of a cogroup come from the queries
    near = placed.select("id", "v", "rb").join(blocks(asked), "rb")
    found = asked.select("id", "v", "qb", "rb").groupBy("qb", "rb").cogroup(near.groupBy("qb", "rb")).applyInArrow(_search(k), _FOUND)
    kth = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    ready = asked.drop("rb").join(kth, "id", "left")

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, low, high = shared.value
        for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
            st = np.array(batch.column("st").to_pylist()).reshape(len(batch), -1)
            least = np.array([-_HUGE if x is None else float(x) for x in batch.column("least").to_pylist()])
            reach = block_bounds(st, low, high) >= least[:, None]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "qb")), pa.array(least), pa.array([numbers[x].tolist() for x in reach], pa.list_(pa.int64()))], ["id", "v", "qb", "least", "rbs"])

    asks = materialise(ready.select("id", "v", "qb", "st", "least").mapInArrow(reaching, "id long, v array<long>, qb string, least double, rbs array<long>"))
    q_side = asks.withColumn("rb", F.explode("rbs")).drop("rbs")
    return q_side, placed.select("id", "v", "rb").join(blocks(q_side), "rb")


def exact_topk(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int, query_block: int = 8192, row_block: int = 8192, least_blocks: int = 24) -> DataFrame:
    """``query_id, rank, <id_col>, score``: each query's k best rows by integer inner product.

    ``vec_col`` holds arrays of whole numbers (see :func:`scaled`).  Rows with a null id or vector
    take no part; rows of a query's own id are not its candidates; equal scores go to the smaller
    id; repeated rows are candidates each, repeated queries are answered once (their smallest
    vector); a shorter vector counts as filled with zeros, an empty one as zeros alone.  Fewer than k candidates:
    all of them; an empty table gives no rows.  Other columns are ignored.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    queries = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    n_q, width = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_r = rows.count()
    row_block = max(min(row_block, -(-n_r // least_blocks)), 1)
    if n_q > query_block:
        q_side, r_side = _dealt(queries, rows, n_r, max(width, 1), k, query_block, row_block)
    else:  # every row is sent once, whatever it could reach
        blocks = max(1, -(-n_r // row_block))
        q_side = queries.select("id", "v", F.lit("0").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("rb"))
        r_side = rows.select("id", "v", F.lit("0").alias("qb"), _salt(F.lit(blocks), 2).alias("rb"))
    found = q_side.groupBy("qb", "rb").cogroup(r_side.groupBy("qb", "rb")).applyInArrow(_search(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


__all__ = ["best_of_block", "block_bounds", "exact_topk", "scaled"]
