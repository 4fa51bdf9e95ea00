"""Exact removal of byte strings of ``length`` bytes that also start anywhere else in the corpus.

A string is a repeat if the longest-previous-factor array of the corpus has ``length`` or more at its start: an
earlier position begins with the same bytes.  With the longest next factor, all copies are found; without it, the
first copy stays and later ones go.

One suffix array of a large corpus fits no task, so suffixes are dealt by content first.  In every
window of ``length`` bytes the smallest hash of its ``GRAM``-byte grams is an anchor (winnowing,
Schleimer et al. 2003): equal windows choose the same anchor at the same place, so whatever repeats
meets under its anchor's hash, and every window belongs to one anchor.

* Anchors that occur once are dropped (a count with a map-side combine).
* An anchor's surroundings, all windows that chose it, are hashed too: equal surroundings of one anchor are a class, one
  row with its first position and its number, so a passage of a third of all texts is one row.  Classes go by these two 64-bit hashes.
* The classes of one anchor come together in a task, each with the bytes of its first occurrence.  Their windows are put in suffix
  order, those of a class that occurs again twice; previous and next smaller positions in that order give the longest previous
  factors (Crochemore and Ilie 2008), and these alone decide, for a class's first occurrence and for its later ones.
* Each occurrence takes the verdict of its class; the join sends the few hot classes to all tasks.
* Under an anchor with very many classes the windows are dealt on by their own hash, where
  only equal ones meet: the first position is an aggregate and nothing is gathered.

Texts are known by a 64-bit hash and their size; positions go by ``doc``, then text, then place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hand_back, long_texts, materialise, text_or_empty

LENGTH, GRAM, PART, CROWD, HOT = 200, 96, 1_000_000, 2_000, 1_000
_BASE = 0x9E3779B97F4A7C15
_POS = 24  # bits of a position in the ordering value; the rest is the gram's hash


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _Hashes:
    """Hashes of substrings of one byte array (polynomial over 64-bit integers, then mixed)."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_Hashes._powers) <= n:
            size = max(n + 1, PART + 1)
            _Hashes._powers = np.cumprod(np.append(np.uint64(1), np.full(size, _BASE, np.uint64)))
            _Hashes._inverse = np.cumprod(np.append(np.uint64(1), np.full(size, pow(_BASE, -1, 2**64), np.uint64)))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _Hashes._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * _Hashes._inverse[start])

    def grams(self, size: int) -> np.ndarray:
        n = max(len(self.sums) - size, 0)
        return _mix((self.sums[size:] - self.sums[:n]) * _Hashes._inverse[:n])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by block-wise running minima."""
    n = len(values) - width + 1
    padded = np.append(values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, last_start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, gram hash, surroundings hash) of runs of windows with one anchor.

    ``last_start[i]`` is the last window start allowed in the text that holds byte i, or less than i.
    """
    none = np.empty(0, np.int64)
    width = length - GRAM + 1
    if len(data) < length:
        return none, none, none, none, none
    hashes = _Hashes(data)
    grams = hashes.grams(GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    last = np.uint64((1 << _POS) - 1)
    low = _sliding_min((grams & ~last) | (last - place), width)  # of equal grams the rightmost
    start = np.flatnonzero(np.arange(len(low)) <= last_start[: len(low)])
    if not len(start):
        return none, none, none, none, none
    at = (last - (low[start] & last)).astype(np.int64)
    new = np.append(True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(new)
    begin, end = start[first], start[np.append(first[1:], len(start)) - 1]
    at = at[first]
    h2 = _mix(hashes.of(begin, end + length) ^ _mix((at - begin).astype(np.uint64) << np.uint64(16) | (at - end).astype(np.uint64)))
    return at, begin, end, grams[at].view(np.int64), h2.view(np.int64)


def _parts(texts: list[bytes], length: int, size: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, last window start per byte, number of text, offset of the text's byte 0 there) of about ``size`` bytes.

    A text beyond ``size`` is cut so that every window lies in one part and parts share
    ``length`` - 1 bytes.
    """

    def pack(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lens = np.array([len(b) for _, _, b in held])
        starts = np.cumsum(lens) - lens
        return (
            np.frombuffer(b"".join(b for _, _, b in held), np.uint8),
            np.repeat(starts + lens - length, lens),
            np.repeat([i for i, _, _ in held], lens),
            np.repeat(starts - np.array([o for _, o, _ in held]), lens),
        )

    held, total = [], 0
    for i, b in enumerate(texts):
        for at in range(0, max(len(b) - length + 1, 0), size):
            piece = b[at : at + size + length - 1]
            if held and total + len(piece) > size:
                yield pack(held)
                held, total = [], 0
            held.append((i, at, piece))
            total += len(piece)
    if held:
        yield pack(held)


_OCCURRENCE = "doc long, th long, tn int, h1 long, h2 long, at int, lo int, hi int, copies long"


def _occurrences(length: int):
    names = [x.split()[0] for x in _OCCURRENCE.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _OCCURRENCE.split(", ")])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, len(b), 1000)):
            copies: dict[tuple[int, int, int], list] = {}
            for doc, th, tn, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "th", "tn", "text")), strict=True):
                copies.setdefault((doc, th, tn), [text, 0])[1] += 1
            keys, texts = [*copies], [v[0].encode("utf-8", "surrogatepass") for v in copies.values()]
            doc, th, tn = (np.array(x, np.int64) for x in zip(*keys, strict=True)) if keys else (np.empty(0, np.int64),) * 3
            count = np.array([v[1] for v in copies.values()], np.int64)
            for data, last_start, text_no, shift in _parts(texts, length):
                at, begin, end, h1, h2 = anchors(data, last_start, length)
                i, o = text_no[at], shift[at]
                values = doc[i], th[i], tn[i], h1, h2, at - o, at - begin, at - end, count[i]
                yield pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip(values, schema.types, strict=True)], names)
        hand_back()

    return find


def _smaller_before(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Least common prefix on the way to the previous smaller position of each suffix; 0 where there is none.

    All suffixes look back in step: one that meets a greater position goes on to where that one has looked, as all between are greater still.
    """
    at, least = np.arange(-1, len(place) - 1), common.copy()
    open_ = np.flatnonzero(place[at] > place)
    open_ = open_[open_ > 0]
    while len(open_):
        to = at[open_]
        least[open_] = np.minimum(least[open_], least[to])
        at[open_] = at[to]
        open_ = open_[at[open_] >= 0]
        open_ = open_[place[at[open_]] > place[open_]]
    least[at < 0] = 0
    return least


def previous_factors(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, the suffixes given in suffix order.

    ``place`` is a suffix's position, every one different; ``common[i]`` is the length of its common prefix with the suffix before it
    (0 for the first).  The previous and next smaller positions in suffix order have the longest common prefixes
    of all smaller ones.
    """
    common = np.asarray(common, np.int64)
    after = _smaller_before(place[::-1], np.append(0, common[:0:-1])[: len(place)])[::-1]
    return np.maximum(_smaller_before(place, common), after)


def _suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each with the one before it) of equally long strings, the rows of a byte matrix."""
    order = np.argsort(np.ascontiguousarray(windows).view(f"V{windows.shape[1]}").ravel(), kind="stable")
    ranked, common = windows[order], np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = ranked[1:] != ranked[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), windows.shape[1])
    return order, common


def repeated_windows(around: list[bytes], lo: np.ndarray, hi: np.ndarray, twice: np.ndarray, length: int, later_only: bool) -> list[np.ndarray]:
    """Per row the largest and smallest distance from window start to anchor among its repeated windows; -1, -1 if none.

    The first two arrays are for a row's first occurrence, the next two for its later ones.
    ``around`` holds the bytes of all windows of a row, the anchor ``lo`` bytes in; ``hi`` is the distance of the last window.
    Rows ascend by first position; those marked ``twice`` occur again later, so their windows stand twice in suffix order.
    Windows of one anchor overlap, so what lies between the two distances is covered too.
    """
    windows = lo - hi + 1
    row = np.repeat(np.arange(len(lo)), windows)
    step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    lens = np.array([len(b) for b in around])
    data = np.frombuffer(b"".join(around), np.uint8)
    start = (np.cumsum(lens) - lens)[row] + step
    order, common = _suffix_order(np.lib.stride_tricks.sliding_window_view(data, length)[start])
    times = 1 + twice[row[order]]
    suffix, new = np.repeat(order, times), np.append(True, np.zeros(max(int(times.sum()) - 1, 0), bool))
    new[np.cumsum(times)[:-1]] = True
    shared = np.full(len(suffix), length)
    shared[new] = common
    place = np.where(new, suffix, len(row) + suffix)  # a later occurrence comes after all first ones of its anchor
    near = shared >= length  # a factor can reach the length only where a neighbour does
    keep = np.flatnonzero(near | np.append(near[1:], False))
    found = np.zeros((2, len(row)), bool)
    if len(keep):
        between = np.minimum.reduceat(shared[: keep[-1] + 1], np.append(0, keep[:-1] + 1))  # over what is left out in front of each
        hit = previous_factors(place[keep], between) >= length
        if not later_only:
            hit |= previous_factors(-place[keep], between) >= length
        found[(~new[keep]).astype(int), suffix[keep]] = hit
    distance, out = lo[row] - step, []
    for repeated in found:
        most, least = np.full(len(lo), -1), np.full(len(lo), np.iinfo(np.int64).max)
        np.maximum.at(most, row[repeated], distance[repeated])
        np.minimum.at(least, row[repeated], distance[repeated])
        out += [most, np.where(most < 0, -1, least)]
    return out


_WINDOWS = 50_000
_VERDICT = pa.schema(
    [("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("tn", pa.int32()), ("at", pa.int32())]
    + [(c, pa.int32()) for c in ("first_lo", "first_hi", "later_lo", "later_hi")]
)
_VERDICTS = "h1 long, h2 long, n long, doc long, th long, tn int, at int, first_lo int, first_hi int, later_lo int, later_hi int"


def _group_kernel(length: int, later_only: bool):
    """Verdicts of classes with a repeated window, from rows that come sorted by anchor, then first position."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        places = [rows[c].to_numpy() for c in ("h1", "doc", "th", "tn", "at")]
        new = np.logical_or.reduce([p[1:] != p[:-1] for p in places])  # rows of one document and text come as often as the document
        rows = rows.filter(pa.array(np.append(True, new)))
        lo, hi = (rows[c].to_numpy().astype(np.int64) for c in ("lo", "hi"))
        twice = rows["twice"].to_numpy(zero_copy_only=False).astype(bool)
        found = repeated_windows(rows["around"].to_pylist(), lo, hi, twice, length, later_only)
        hit = (found[0] >= 0) | (found[2] >= 0)
        values = [*(rows[c].to_numpy() for c in _VERDICT.names[:7]), *found]
        return pa.RecordBatch.from_arrays([pa.array(v[hit]).cast(t) for v, t in zip(values, _VERDICT.types, strict=True)], schema=_VERDICT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = pa.Table.from_batches([batch.slice(k, 500)])
                held = part if held is None else pa.concat_tables([held, part])
                h1 = held["h1"].to_numpy()
                cut = int(np.flatnonzero(h1 != h1[-1])[-1]) + 1 if len(h1) and h1[0] != h1[-1] else 0
                if cut and int((held["lo"].to_numpy() - held["hi"].to_numpy() + 1)[:cut].sum()) >= _WINDOWS:
                    yield solve(held.slice(0, cut).combine_chunks())
                    held = held.slice(cut)
        if held is not None and len(held):
            yield solve(held.combine_chunks())
        hand_back()

    return run


def _around_kernel(length: int):
    """Bytes of the surroundings asked for."""
    schema = pa.schema([(c, pa.int64()) for c in ("h1", "h2", "n", "doc", "th")] + [(c, pa.int32()) for c in ("tn", "at", "lo", "hi")] + [("twice", pa.bool_()), ("crowded", pa.bool_()), ("around", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, th, tn, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "th", "tn", "text", "wanted")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [(w["h1"], w["h2"], w["n"], doc, th, tn, w["at"], w["lo"], w["hi"], w["twice"], w["crowded"], data[w["at"] - w["lo"] : w["at"] - w["hi"] + length]) for w in wanted]
            columns = [*zip(*out, strict=True)] or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run, "h1 long, h2 long, n long, doc long, th long, tn int, at int, lo int, hi int, twice boolean, crowded boolean, around binary"


def _windows_kernel(length: int):
    """One row a window: its anchor's hash, its distance to the anchor and its own hash."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("d", pa.int32()), ("wh", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("tn", pa.int32()), ("at", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                rows = batch.slice(k, 1000)
                around = rows.column("around").to_pylist()
                lens = np.array([len(b) for b in around])
                if not len(lens):
                    continue
                hashes = _Hashes(np.frombuffer(b"".join(around), np.uint8))
                windows = lens - length + 1
                row = np.repeat(np.arange(len(lens)), windows)
                j = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
                start = np.repeat(np.cumsum(lens) - lens, windows) + j
                col = {c: rows.column(c).to_numpy(zero_copy_only=False)[row] for c in ("h1", "h2", "doc", "th", "tn", "at", "lo", "twice")}
                values = col["h1"], col["h2"], col["lo"] - j, hashes.of(start, start + length).view(np.int64), col["doc"], col["th"], col["tn"], col["at"], 1 + col["twice"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

    return run, "h1 long, h2 long, d int, wh long, doc long, th long, tn int, at int, n long"


def merged_spans(covers: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint spans, in order, of the byte ranges in the rows of ``covers``; ranges that touch become one."""
    if not len(covers):
        return []
    covers = covers[np.argsort(covers[:, 0], kind="stable")]
    reach = np.maximum.accumulate(covers[:, 1])
    first = np.flatnonzero(np.append(True, covers[1:, 0] > reach[:-1]))
    return [*zip(covers[first, 0].tolist(), reach[np.append(first[1:], len(covers)) - 1].tolist(), strict=True)]


def span_lists(covers: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """Merged spans of each row of a column of covers; none for null."""
    ranges = covers.flatten()
    flat = np.column_stack([np.asarray(ranges.field("a"), np.int64), np.asarray(ranges.field("b"), np.int64)])
    ends = np.cumsum([n or 0 for n in covers.value_lengths().to_pylist()])
    for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
        yield merged_spans(flat[a:b])


def keyed(docs: DataFrame, text_col: str = "text", doc: Column | None = None) -> DataFrame:
    """``docs`` with its text as ``text`` (null: empty), its hash ``th``, its bytes ``tn`` and its place ``doc`` in the corpus."""
    docs = docs.withColumn("text", text_or_empty(text_col))
    place = F.lit(0).cast("long") if doc is None else F.coalesce(doc.cast("long"), F.lit(-(2**63)))
    return docs.withColumns({"th": F.xxhash64("text"), "tn": F.octet_length("text"), "doc": place})


def beside(rows: DataFrame, sizes: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """``rows`` with the columns ``extra`` of ``sizes`` (``keys``, ``n`` rows each) by an inner join, spread if a key is hot.

    Keys with more than one of ``HOT`` parts of all rows are ``HOT`` at most, so they are broadcast; others are shuffled.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sizes.where(F.col("n") > total / HOT).select(*keys, *extra))
    cool = sizes.where(F.col("n") <= total / HOT).select(*keys, *extra)
    few = rows.join(F.broadcast(sizes.where(F.col("n") > total / HOT).select(*keys)), keys, "left_anti").join(cool, keys)
    return rows.join(hot, keys).unionByName(few)


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, doc: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(keyed ``docs``, ``doc, th, tn, covers``): covers are byte ranges [a, b) that may overlap.

    Covered are all bytes of ``length``-byte strings that start elsewhere too, in the same text or
    another, judged on the input; matches never cross texts.  With ``doc``, an id that orders the corpus (null:
    first; then text, then place), only strings that start at an earlier place too are covered, so that the first copy
    stays; rows of one id and text are one document.  Null texts are empty; an empty table gives no covers.
    """
    long_texts(docs.sparkSession)
    later_only = doc is not None
    docs = keyed(docs, doc=doc)
    long = docs.where(F.col("tn") >= length).select("doc", "th", "tn", "text")
    seen = long.mapInArrow(_occurrences(length), _OCCURRENCE)
    counts = materialise(seen.groupBy("h1").agg(F.sum("copies").alias("n")).where("n > 1").select("h1"))
    several = materialise(seen.join(counts, "h1"))
    place = F.struct("doc", "th", "tn", "at", "lo", "hi")
    kinds = several.groupBy("h1", "h2").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"), F.min(place).alias("one"))
    kinds = materialise(kinds.select("h1", "h2", "n", (F.col("copies") > 1).alias("twice"), "one"))
    crowds = kinds.groupBy("h1").agg((F.count(F.lit(1)) > crowd).alias("crowded"))
    asked = kinds.join(crowds, "h1").select("one.doc", "one.th", "one.tn", F.struct("h1", "h2", "n", "one.at", "one.lo", "one.hi", "twice", "crowded").alias("w"))
    asked = asked.groupBy("doc", "th", "tn").agg(F.collect_list("w").alias("wanted"))  # as many as one text has anchors
    around, schema = _around_kernel(length)
    around = materialise(docs.select("doc", "th", "tn", "text").join(asked, ["doc", "th", "tn"]).mapInArrow(around, schema))
    few = around.where("not crowded").drop("crowded").repartition("h1").sortWithinPartitions("h1", "doc", "th", "tn", "at")
    verdicts = few.mapInArrow(_group_kernel(length, later_only), _VERDICTS)
    if not around.where("crowded").isEmpty():
        windows, schema = _windows_kernel(length)
        many = around.where("crowded")
        windows = many.mapInArrow(windows, schema)
        start = F.struct("doc", "th", "tn", "at")
        met = materialise(windows.groupBy("h1", "d", "wh").agg(F.sum("n").alias("copies"), F.count(F.lit(1)).alias("n"), F.min(start).alias("one")).where("copies > 1").select("h1", "d", "wh", "n", "one"))
        hits = beside(windows.drop("n"), met, ["h1", "d", "wh"], ["one"])
        hits = hits.where(start != F.col("one")) if later_only else hits
        hits = hits.groupBy("h1", "h2").agg(F.max("d").alias("first_lo"), F.min("d").alias("first_hi"))
        again = [F.when(F.col("twice"), F.col(c)).otherwise(-1).alias(f"later_{c}") for c in ("lo", "hi")]
        first = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("first_lo", "first_hi")]
        decided = many.drop("around", "crowded").distinct().join(hits, ["h1", "h2"], "left").where(F.col("first_lo").isNotNull() | F.col("twice"))
        verdicts = verdicts.unionByName(decided.select("h1", "h2", "n", "doc", "th", "tn", "at", *first, *again))
    kept = ("doc", "th", "tn", "at")
    verdicts = materialise(verdicts.select("h1", "h2", "n", F.struct(*kept).alias("one"), "first_lo", "first_hi", "later_lo", "later_hi"))
    judged = beside(several, verdicts, ["h1", "h2"], ["one", "first_lo", "first_hi", "later_lo", "later_hi"])
    is_first = F.struct(*kept) == F.col("one")
    judged = judged.select("doc", "th", "tn", "at", *[F.when(is_first, F.col(f"first_{c}")).otherwise(F.col(f"later_{c}")).alias(c) for c in ("lo", "hi")])
    covers = judged.where("lo >= 0").select("doc", "th", "tn", (F.col("at") - F.col("lo")).alias("a"), (F.col("at") - F.col("hi") + length).alias("b"))
    return docs, covers.distinct().groupBy("doc", "th", "tn").agg(F.collect_list(F.struct("a", "b")).alias("covers"))


def without_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, id_col: str = "doc_id") -> DataFrame:
    """``row`` (struct of the other columns of ``docs``), ``text`` less its repeated strings, and ``spans`` (removed bytes, [a, b)).

    Later copies go and the first one stays, by ``id_col`` (null ids first), then text, then place.
    Null texts become empty.  A character stays where only some of its bytes repeat.  Rows of one id and text
    are one document and stay alike; other copies of a long text lose it whole.
    """
    others = [F.col(c) for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
    keyed_docs, covers = repeated_spans(docs.select(F.struct(*others).alias("row"), "text"), length, crowd, F.col(f"row.`{id_col}`"))
    joined = keyed_docs.join(covers, ["doc", "th", "tn"], "left")

    kind = joined.schema["row"].dataType.simpleString()
    return joined.select("row", "text", "covers").mapInArrow(_cut_rows, f"row {kind}, text string, spans array<struct<a: int, b: int>>")


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for batch in (b.slice(k, 200) for b in batches for k in range(0, len(b), 200)):
        texts, spans = [], []
        for text, found in zip(batch.column("text").to_pylist(), span_lists(batch.column("covers")), strict=True):
            raw = text.encode("utf-8", "surrogatepass") if found else b""
            own = whole_characters(raw, found)
            texts.append(kept_bytes(raw, own).decode("utf-8", "surrogatepass") if own else text)
            spans.append([{"a": a, "b": b} for a, b in own])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(spans, kind)], ["row", "text", "spans"])
    hand_back()


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to the characters that lie in them whole."""
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        out += [(a, b)] if a < b else []
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in spans for x in s], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of rows with doc_id, text and covers."""
    for batch in (b.slice(k, 200) for b in batches for k in range(0, len(b), 200)):
        out: list[tuple] = []
        for text, spans in zip(batch.column("text").to_pylist(), span_lists(batch.column("covers")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            out.append((len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()))
        columns = [*zip(*out, strict=True)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
