"""Compression classifier for document quality.

Two zstandard dictionaries are built from pieces of well- and badly-labelled text.  A text is cut
into blocks of ``BLOCK`` bytes; each block is compressed alone with either dictionary, so that the
dictionary and not the text's own repetition explains it.  The feature is
``(bytes with the bad dictionary - bytes with the good one) / bytes of the text``, drawn towards the
labels' mean as if ``PRIOR`` bytes more had been seen, since a few words say little; a logistic
curve fitted on other labelled rows, weighted back to the labels' own shares, turns it into a score.

Only the fit looks at a sample, bounded by parameters of :func:`fit_quality`: at most ``per_class`` labelled
rows a class (default 1,000), those with the smallest hash of their id, and of each of them a ``piece`` of 600
characters for the dictionaries, which hold ``dictionary`` bytes (default 512 KiB) at most; with more, every
text gives an equal share.  The curve is fitted on whole texts and every text is scored whole.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, LEVEL, PIECE, DICTIONARY, PRIOR = 512, 9, 600, 512 * 1024, 100


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    mean: float
    slope: float
    intercept: float


@functools.lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def size_difference(text: str | None, good: bytes, bad: bytes) -> int:
    """Bytes that the whole text takes more with the bad dictionary; 0 for an empty or null one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    g, b = _compressor(good), _compressor(bad)
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return sum(len(b.compress(x)) - len(g.compress(x)) for x in blocks)


def _difference_column(text: str | Column, good: bytes, bad: bytes) -> Column:
    @F.pandas_udf("long")
    def difference(texts: pd.Series) -> pd.Series:
        return pd.Series([size_difference(t, good, bad) for t in texts], dtype="int64")

    return difference(text)


def _bytes(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def logistic_fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted one-variable logistic regression with a faint ridge, by Newton steps."""
    scale = x.std() or 1.0
    a = np.column_stack([x / scale, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - 1e-3 * beta
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def without_shared_lines(pieces: dict[int, tuple[bool, str]]) -> dict[int, str]:
    """Pieces of sampled texts, (begins inside a line, piece), less the lines that two or more of them share.

    A notice that stands in texts of either class says nothing about it, and would otherwise
    count for the class whose dictionary happens to hold it.
    """
    lines = {i: (p.split("\n")[1:] if inside and "\n" in p else p.split("\n")) for i, (inside, p) in pieces.items()}
    seen = Counter(x for own in lines.values() for x in {*own})
    shared = sorted(x for x, n in seen.items() if n > 1 and len(x) >= 10)
    begins = lambda x: len(x) >= 10 and (at := bisect_left(shared, x)) < len(shared) and shared[at].startswith(x)
    return {i: "\n".join(x for x in own if not begins(x)) for i, own in lines.items()}


def dictionary_of(pieces: list[bytes], most: int) -> bytes:
    """The pieces joined by line ends; beyond ``most`` bytes all are cut to an equal share, so that none is left out."""
    joined = b"\n".join(pieces)
    if len(joined) <= most:
        return joined
    low, high = 0, max(map(len, pieces))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(len(p), mid) + 1 for p in pieces) <= most else (low, mid - 1)
    return b"\n".join(p[:low] for p in pieces)


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1000, piece: int = PIECE, dictionary: int = DICTIONARY) -> QualityModel | None:
    """Fit on ``labels`` (doc_id, quality 0/1) of ``docs`` (doc_id, text); None if a class has no text.

    Rows with a null id, label or text take no part; of several labels of a document the smaller counts, of
    several texts of an id the first in order.  Half of a class's sample fills its dictionary, the other half
    fits the curve.
    """
    labels = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = {q: [r["doc_id"] for r in labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()] for q in (0, 1)}
    if not all(picked.values()):
        return None
    ids = sorted({*picked[0], *picked[1]})
    rows = docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).groupBy("doc_id").agg(F.min("text").alias("text"))  # one row an id
    start = (F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - piece, F.lit(0)) + 1) + 1).cast("int")
    found = rows.select("doc_id", (start > 1).alias("inside"), F.substring("text", start, F.lit(piece)).alias("p")).collect()
    pieces = {i: p.encode() for i, p in without_shared_lines({r["doc_id"]: (r["inside"], r["p"]) for r in found}).items()}
    halves = {q: [i for i in picked[q] if i in pieces] for q in (0, 1)}
    if not all(halves.values()):
        return None
    cut = {q: (len(v) + 1) // 2 for q, v in halves.items()}
    own = {q: [pieces[i] for i in halves[q][: cut[q]]] for q in (0, 1)}
    size = min(dictionary, *(len(dictionary_of(own[q], dictionary)) for q in (0, 1)))
    if size < 8:
        return None
    good, bad = (dictionary_of(own[q], size) for q in (1, 0))
    held = {i: q for q in (0, 1) for i in (halves[q][cut[q] :] or halves[q])}
    seen = rows.where(F.col("doc_id").isin(sorted(held))).select("doc_id", _difference_column("text", good, bad).alias("x"), _bytes("text").alias("n")).orderBy("doc_id").collect()
    x, size_of, y = (np.array(v, dtype=float) for v in zip(*[(r["x"], r["n"], held[r["doc_id"]]) for r in seen], strict=True))
    n = {q: max((y == q).sum(), 1) for q in (0, 1)}
    w = np.where(y == 1, share[1] / n[1], share[0] / n[0])
    mean = float(w @ (x / np.maximum(size_of, 1)) / w.sum())
    slope, intercept = logistic_fit((x + PRIOR * mean) / (size_of + PRIOR), y, w * len(y) / w.sum())
    return QualityModel(good, bad, mean, slope, intercept)


def quality_score(text: str | Column, model: QualityModel | None) -> Column:
    """Score 0 to 1 of each whole text, higher for label 1; without a model 0.5.

    A null text scores as an empty one: both have the labels' mean difference.  Equal texts have equal scores; very
    long ones are compressed block by block; an empty table gives no rows.
    """
    if model is None:
        return F.lit(0.5)
    x = (_difference_column(text, model.good, model.bad) + PRIOR * model.mean) / (_bytes(text) + PRIOR)
    return 1 / (1 + F.exp(-(F.lit(model.slope) * x + F.lit(model.intercept))))
