"""Vector code compression: one byte a part of a vector, with codebooks fitted by integer k-means.

Every part of a vector asks its codebook for the nearest entry.  The search is a vector-approximation file: each coordinate of
an entry is kept as the number of its cell, a few bits.  A part looks up, for every coordinate and cell, the
least and the greatest squared difference to any value of that cell; the sums over the coordinates are lower and upper bounds of its
distances to all entries.  Entries whose lower bound exceeds the least upper bound are out; the others' distances are computed in whole
numbers.

A round is one pass over the vectors: tasks add up counts and component sums an entry, a grouped aggregate joins them, and only the
codebooks, as many numbers as entries have components, pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hand_back, materialise, row_key

_CELLS = 1 << 19  # numbers of a table of bounds that are held at a time


def cells_of(book: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of every entry's coordinate, least value of each cell, greatest value) of one codebook (entries by coordinates).

    A coordinate's range over the entries is cut into ``2**bits`` cells of equal width.
    """
    low, high = book.min(axis=0), book.max(axis=0)
    n = 1 << bits
    edges = low[:, None] + (high - low + 1)[:, None] * np.arange(n + 1) // n
    cell = np.stack([np.searchsorted(edges[k], book[:, k], side="right") - 1 for k in range(book.shape[1])], axis=1)
    return np.clip(cell, 0, n - 1), edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])


def nearest(parts: np.ndarray, book: np.ndarray, bits: int = 3, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of ``parts``, ties to the lower index.

    ``seen`` gets the number of pairs whose distance was computed.
    """
    n, width = parts.shape
    index, dist = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not width:
        return index, dist
    cell, low, high = cells_of(book, bits)
    pick = np.arange(width)[None, :] * low.shape[1] + cell  # each entry's places in a part's flat table
    block = max(_CELLS // pick.size, 64)
    for a in range(0, n, block):
        x = parts[a : a + block, :, None]
        under, over = low[None] - x, x - high[None]
        least = np.maximum(np.maximum(under, over), 0)
        most = np.maximum(np.abs(under), np.abs(over))
        least = (least * least).reshape(len(x), -1)[:, pick].sum(axis=2)
        most = (most * most).reshape(len(x), -1)[:, pick].sum(axis=2)
        row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
        gap = parts[a + row] - book[entry]
        exact = np.einsum("ij,ij->i", gap, gap)
        order = np.lexsort((entry, exact, row))
        first = np.concatenate([[True], np.diff(row[order]) > 0])  # every row keeps an entry
        index[a : a + block], dist[a : a + block] = entry[order][first], exact[order][first]
        if seen is not None:
            seen.append(len(row))
    return index, dist


def whole_numbers(vec: Column, factor: int, most: int) -> Column:
    """``floor(factor * x)`` of each component, within ``most`` of 0; null unless every component is a finite number."""
    good = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    bounded = lambda x: F.floor(F.greatest(F.least(x.cast("double") * factor, F.lit(float(most))), F.lit(float(-most)))).cast("long")
    return F.when(good, F.transform(vec, bounded))


def _rows(col: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, short ones filled with zeros."""
    lens = np.asarray(col.value_lengths())
    flat = np.asarray(col.flatten(), dtype=np.int64)
    if (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _summed(df: DataFrame, books: np.ndarray, bits: int) -> DataFrame:
    """``part, entry, n, sums`` a task: how many parts chose an entry, and the sums of their components."""
    parts, entries, width = books.shape
    shared = df.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            x = _rows(batch.column(0), parts * width).reshape(len(batch), parts, width)
            for p in range(parts):
                index, _ = nearest(x[:, p], shared.value[p], bits)
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, x[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(e, pa.int64()), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])
        hand_back()

    return df.select("v").mapInArrow(run, "part long, entry long, n long, sums array<long>")


def fit_codebooks(vectors: DataFrame, id_col: str, vec_col: str, parts: int = 8, entries: int = 16, rounds: int = 6, bits: int = 3) -> np.ndarray | None:
    """Codebooks (parts by entries by components) of whole-number vectors; None without vectors.

    Entries start as the parts of the vectors with the smallest ids (null last, then by the vector); with fewer vectors than ``entries`` there
    are as many entries.  Each round replaces an entry by the floored mean of the parts nearest to it; one that nobody chose stays.
    Vectors are filled with zeros to the longest length, rounded up to a multiple of ``parts``.
    """
    vectors = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    longest = vectors.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts)
    first = [r["v"] for r in vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]  # ``entries`` rows
    seeds = np.zeros((len(first), parts * width), np.int64)
    for k, v in enumerate(first):
        seeds[k, : len(v)] = v
    books = np.ascontiguousarray(seeds.reshape(len(first), parts, width).transpose(1, 0, 2))
    if not width:
        return books
    for _ in range(rounds):
        total = _summed(vectors, books, bits).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
        books = books.copy()
        for r in total.collect():  # one row an entry
            books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def encode_vectors(vectors: DataFrame, vec_col: str, books: np.ndarray, keep: list[str], bits: int = 3) -> DataFrame:
    """``keep`` plus ``code`` (two hexadecimal digits a part) and ``error``, the squared distances of a vector's parts to their entries."""
    parts, _, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(len(keep)), parts * width).reshape(len(batch), parts, width)
            found = [nearest(x[:, p], shared.value[p], bits) for p in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1)
            error = np.stack([f[1] for f in found], axis=1).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array([c.astype(np.uint8).tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], [*keep, "code", "error"])

    return vectors.select(*keep, vec_col).mapInArrow(run, f"{schema}, code string, error long")


def totals_of_groups(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``rows`` (a written table) plus ``name``, the sum of ``value`` over the rows of the same ``group`` (nulls together).

    Sums are taken before rows meet them.  Groups of more than a 64th of the rows, which are 64 at most, are broadcast; only the rows of other groups are shuffled.
    """
    keyed = rows.withColumn("_key", row_key(group))
    sums = materialise(keyed.groupBy("_key").agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("_n")))
    total = sums.agg(F.sum("_n")).first()[0] or 0
    large = sums.where(F.col("_n") > total / 64).select("_key", name)
    small = sums.where(F.col("_n") <= total / 64).select("_key", name)
    hot = keyed.join(F.broadcast(large), "_key")
    rest = keyed.join(F.broadcast(large), "_key", "left_anti").join(small, "_key")
    return hot.unionByName(rest).drop("_key")


def compressed(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, factor: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, bits: int = 3) -> tuple[DataFrame, np.ndarray | None]:
    """(``<id_col>, <label_col>, code, error, label_error``, codebooks) of float vectors; ``label_error`` is the sum of ``error`` over equal labels, nulls together.

    Components become ``floor(factor * x)``, beyond 2**26 they count as 2**26.  Rows whose vector is null or holds a null or non-finite component go; short vectors are
    filled with zeros, an empty one is all zeros; repeated rows are coded each; an empty table gives an empty one and no codebooks; other columns are ignored.
    ``entries`` must be 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits")
    good = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), whole_numbers(F.col(vec_col), factor, 1 << 26).alias("v")).where("v is not null")
    good = materialise(good)
    books = fit_codebooks(good, "id", "v", parts, entries, rounds, bits)
    names = lambda df: df.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error")
    if books is None:
        return names(good.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))), None
    coded = materialise(encode_vectors(good, "v", books, ["id", "label"], bits))
    return names(totals_of_groups(coded, "label", "error", "label_error")), books


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The whole-number vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))])


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


__all__ = ["cells_of", "compressed", "decoded", "digest", "encode_vectors", "fit_codebooks", "nearest", "totals_of_groups", "whole_numbers"]
