"""Periodic runs of words: stretches that repeat one word sequence, found by probing a harmonic grid.

A stretch of four periods ``p`` or more covers four multiples of ``p``, so the words at three neighbouring pairs
``jp, (j+1)p`` are equal.  For each ``p`` these probes cost ``n/p`` comparisons, ``n log n`` together.  Grid points that pass
are tested at some places between them; the survivors are extended to both sides by comparing the words with those ``p`` later,
chunk by chunk.  Grid points inside a run already found with a period that divides ``p`` are skipped: from there
the same run would be found again.

Whole texts stay in the task that reads them, so nothing is shuffled; texts of a batch are probed together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import hand_back

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_CHUNK = 64  # words of the first chunk of an extension; doubles up to a million


def _reach(same_at, start: int, stop: int, step: int) -> int:
    """How many places from ``start`` on, going by ``step`` towards ``stop``, hold; ``same_at(a, b)`` tests places a to b - 1."""
    done, size, total = 0, _CHUNK, abs(stop - start)
    while done < total:
        size = min(size, total - done)
        a = start + done if step > 0 else start - done - size + 1
        same = same_at(a, a + size)
        bad = np.flatnonzero(~same)
        if len(bad):
            return done + int(bad[0] if step > 0 else size - 1 - bad[-1])
        done, size = done + size, min(2 * size, 1 << 20)
    return done


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts that lie one after another in ``words``, the longest texts first.

    ``sizes`` are the texts' lengths and include one closing number each that occurs nowhere else.  A run is a stretch of smallest period
    ``p`` and at least ``max(least, times * p)`` words that no neighbouring word extends.  ``times`` is 4 or more.
    """
    found: list[tuple[int, int, int]] = []
    by_period: dict[int, list[tuple[int, int]]] = {}
    ends = np.cumsum(sizes)
    period = 1
    while True:
        need = max(least, times * period)
        texts = int(np.searchsorted(-(sizes - 1), -need, side="right"))  # those long enough come first
        if texts == 0:
            return found
        n, p = int(ends[texts - 1]), period
        period += 1
        grid = words[:n:p]
        equal = grid[1:] == grid[:-1]
        at = equal[:-2] & equal[1:-1] & equal[2:]
        if not at.any():
            continue
        points = np.flatnonzero(at) * p
        for off in {1 % p, p // 3, p // 2, p - 1, p + p // 3, p + p // 2, 2 * p - 1}:  # a run goes on for two periods after its first grid point
            points = points[words[points + off] == words[points + off + p]]
        if not len(points):
            continue
        for q in [q for q in by_period if p % q == 0]:
            by_period[q] = [se for se in by_period[q] if se[1] - se[0] > p]  # shorter ones hold no pair of later grids
        known = sorted(se for q, runs in by_period.items() if p % q == 0 for se in runs)
        same_at = lambda a, b: words[a:b] == words[a + p : b + p]  # noqa: E731, B023
        k, i = 0, 0
        while i < len(points):
            x = int(points[i])
            while k < len(known) and known[k][1] - p <= x:
                k += 1
            if k < len(known) and known[k][0] <= x:
                i = int(np.searchsorted(points, known[k][1] - p))
                continue
            begin = x - _reach(same_at, x - 1, -1, -1)
            end = x + _reach(same_at, x, n - p, 1)
            if end + p - begin >= need:
                found.append((begin, end + p - begin, p))
                by_period.setdefault(p, []).append((begin, end + p))
            i = int(np.searchsorted(points, max(end, x + 1)))


def _collapsed(parts: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(parts)
    change = np.zeros(len(parts) + 1, np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([parts[i] for i in kept.tolist()])


def runs_of_texts(texts: list[bytes | None], least: int = 6, times: int = 4) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text (UTF-8; None: empty) its runs by start, then period, and what is left of it."""
    name: dict[bytes, int] = defaultdict(count().__next__)
    parts = [(t or b"").split() for t in texts]  # splits bytes at the six ASCII spaces only
    order = sorted(range(len(texts)), key=lambda i: -len(parts[i]))
    sizes = np.array([len(parts[i]) + 1 for i in order], np.int64)
    words = np.empty(int(sizes.sum()), np.int64)
    at, starts = 0, {}
    for k, i in enumerate(order):
        n = len(parts[i])
        words[at : at + n] = np.fromiter(map(name.__getitem__, parts[i]), np.int64, n)
        words[at + n] = -1 - k
        starts[at] = i
        at += n + 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    begins = np.array(list(starts), np.int64)
    for s, length, p in find_runs(words, sizes, least, times):
        first = int(begins[np.searchsorted(begins, s, side="right") - 1])
        runs[starts[first]].append((s - first, length, p))
    for own, held in zip(runs, parts, strict=True):
        own.sort(key=lambda r: (r[0], r[2]))
        yield own, _collapsed(held, own)


def collapse_runs(docs: DataFrame, keep: list[str], text_col: str = "text", least: int = 6, times: int = 4, batch_bytes: int = 4 << 20) -> DataFrame:
    """``keep`` plus ``runs`` (array of ``start, length, period`` by start, then period) and ``collapsed``, the text without repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch of smallest period ``p`` and at least ``max(least, times * p)`` words
    that no neighbouring word extends; of each run the first ``p`` words stay, the kept words are joined by one space.  A null,
    empty or wordless text has no runs and an empty ``collapsed``; repeated rows are rows each; an empty table gives none; columns not in ``keep``
    play no part.  A task works on texts of about ``batch_bytes`` together; a longer text goes alone and whole.
    """
    if times < 4:
        raise ValueError("runs of less than four periods can miss the grid")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary())
            lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            part = (np.cumsum(lengths) - lengths) // batch_bytes
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                found = list(runs_of_texts(texts.slice(a, b - a).to_pylist(), least, times))
                runs = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own, _ in found], _RUNS)
                left = pa.array([t for _, t in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), runs, left], [*keep, "runs", "collapsed"])
        hand_back()

    return docs.select(*[f"`{c}`" for c in keep], f"`{text_col}`").mapInArrow(run, f"{schema}, runs {RUNS}, collapsed string")


__all__ = ["collapse_runs", "find_runs", "runs_of_texts"]
