"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints at most d bits apart agree in one of d + 1 segments, and in one of d + 1 parts of
what is left; (segment, part) values are the keys that deal distinct fingerprints to tasks.  In a
task, a key's fingerprints are sorted by Gray rank, so neighbours share most bits.  Runs of them
become nodes that hold the bits all members share (a mask and a pattern); the bits a child shares
beyond its parent are counted there alone.  A search walks from the root, adds up differences and
drops whole groups once they exceed d.

A task joins its linked fingerprints and sends on one link each, so dense groups do not emit all
pairs; components are then found over distinct fingerprints only.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hand_back, long_texts, materialise, text_or_empty

FANOUT, QUERIES, PAIRS = 8, 20_000, 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of the ``size``-word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, ends = (ends - lens)[: max(1, len(words) - size + 1)].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id_col, fp`` (a signed long) of every whole text; null texts are empty."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, size) for t in texts], np.uint64).view(np.int64))

    return docs.select(id_col, fp(text_col).alias("fp"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def linked_pairs(codes: np.ndarray, group: np.ndarray, distance: int, most: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of positions of one group at most ``distance`` bits apart; rows are in (group, Gray rank) order.

    With ``most``, a block looks at that many pairs at most, or at those of one position.
    """
    levels = [{"mask": np.full(len(codes), np.uint64(2**64 - 1)), "pattern": codes, "group": group, "last": np.arange(len(codes))}]
    while True:
        low = levels[-1]
        new_group = np.append(True, low["group"][1:] != low["group"][:-1])
        first = np.flatnonzero(new_group)
        within = np.arange(len(low["group"])) - np.repeat(first, np.diff(np.append(first, len(new_group))))
        starts = np.flatnonzero(within % FANOUT == 0)
        if len(starts) == len(new_group):
            break
        both, some = np.bitwise_and.reduceat(low["pattern"], starts), np.bitwise_or.reduceat(low["pattern"], starts)
        mask = np.bitwise_and.reduceat(low["mask"], starts) & ~(both ^ some)
        stops = np.append(starts[1:], len(new_group))
        low["own"] = low["mask"] & ~np.repeat(mask, stops - starts)  # bits not yet told by the parent
        levels.append({"mask": mask, "pattern": both & mask, "group": low["group"][starts], "last": low["last"][stops - 1], "starts": starts, "stops": stops})
    top = levels[-1]
    top["own"] = top["mask"]
    cuts = [*range(0, len(codes), QUERIES), len(codes)]
    if most:
        seen = np.cumsum(np.searchsorted(group, group, "right") - np.arange(len(codes)) - 1)
        cuts = [0]
        while cuts[-1] < len(codes):
            before = seen[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(min(max(int(np.searchsorted(seen, before + most, "right")), cuts[-1] + 1), cuts[-1] + QUERIES))
    for at, end in zip(cuts[:-1], cuts[1:], strict=True):
        q = np.arange(at, end)
        node = np.searchsorted(top["group"], group[q])
        done = np.zeros(len(q), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            level = levels[k]
            done = done + np.bitwise_count((codes[q] ^ level["pattern"][node]) & level["own"][node])
            keep = (done <= distance) & (level["last"][node] > q)
            q, node, done = q[keep], node[keep], done[keep]
            if k:
                n = level["stops"][node] - level["starts"][node]
                ahead = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, done, node = np.repeat(q, n), np.repeat(done, n), np.repeat(level["starts"][node], n) + ahead
        yield q, node


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions."""
    label = np.arange(n)
    for a, b in pairs:
        while len(a):
            x, y = label[a], label[b]
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[a] != label[b]
            a, b = a[open_], b[open_]
    return label


def _search_keys(distance: int, more: tuple[str, ...] = (), total: int = 0):
    """Kernel over rows sorted by (kind, key): links that join what is at most ``distance`` bits apart in ``fp``.

    With ``more`` columns, all pairs are given, named by the column ``node``, that are also at most
    ``total`` bits apart in all columns together, differ in ``root`` and in ``home``, and differ in ``side`` unless it is -1.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            kind, key, codes = rows["kind"].to_numpy(), rows["key"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
            change = np.append(True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]))
            group = np.cumsum(change) - 1
            several = np.bincount(group)[group] > 1
            codes, group = codes[several], group[several]
            order = np.lexsort((gray_rank(codes), group))
            codes, group = codes[order], group[order]
            names = rows["node" if more else "fp"].to_numpy()[several][order]
            rest = [rows[c].to_numpy().view(np.uint64)[several][order] for c in more]
            if not len(codes):
                return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
            pairs = linked_pairs(codes, group, distance, PAIRS if more else 0)
            if more:
                root, home, side = (rows[c].to_numpy()[several][order] for c in ("root", "home", "side"))
                apart = lambda a, b: (root[a] != root[b]) & (home[a] != home[b]) & ((side[a] != side[b]) | (side[a] < 0))
                near = [(a[ok], b[ok]) for a, b in pairs for ok in [apart(a, b) & (sum(np.bitwise_count(w[a] ^ w[b]).astype(int) for w in (codes, *rest)) <= total)]]
                a, b = (names[np.concatenate(x)] for x in zip(*near, strict=True))
                return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            label = joined(len(codes), pairs)
            far = label != np.arange(len(codes))
            return pd.DataFrame({"a": names[far], "b": names[label[far]]})

        for pdf in batches:
            held = pd.concat([held, pdf], ignore_index=True) if len(held) else pdf
            if not len(held):
                continue
            last = (held["kind"] == held["kind"].iat[-1]) & (held["key"] == held["key"].iat[-1])
            closed = held[~last]
            held = held[last].reset_index(drop=True)
            if len(closed):
                yield links(closed.reset_index(drop=True))
        if len(held):
            yield links(held)
        hand_back()

    return search


def _cut(bits: int, parts: int) -> list[int]:
    return [bits // parts + (i < bits % parts) for i in range(parts)]


def fingerprint_links(distinct: DataFrame, distance: int) -> DataFrame:
    """Links ``a, b`` that join exactly what pairs of ``fp`` at most ``distance`` bits apart join."""
    keys, before = [], 0
    for width in _cut(64, distance + 1):
        turned = F.shiftleft("fp", before).bitwiseOR(F.shiftrightunsigned("fp", 64 - before)) if before else F.col("fp")
        shift = 0
        for part in _cut(64 - width, distance + 1):
            head = F.shiftrightunsigned(turned, 64 - width)
            tail = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit((1 << part) - 1))
            keys.append(F.struct(F.lit(len(keys)).alias("kind"), F.shiftleft(head, part).bitwiseOR(tail).alias("key")))
            shift += part
        before += width
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.kind", "k.key", "fp")
    dealt = dealt.repartition("kind", "key").sortWithinPartitions("kind", "key")
    return dealt.mapInPandas(_search_keys(distance), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a, b``: root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by
    doubling, and contracts the links; rounds are few and each result is written to the shared folder.
    """
    total = None
    links = materialise(links.where("a <> b"))
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        hook = materialise(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:
            ends = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = materialise(hook.join(ends, "root").select("node", "root", "next"))
            moved = not step.where("root <> next").isEmpty()
            hook = step.select("node", F.col("next").alias("root"))
            if not moved:
                break
        named = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
        total = hook if total is None else total.join(named, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        left = links.join(hook.withColumnsRenamed({"node": "a", "root": "ra"}), "a").join(hook.withColumnsRenamed({"node": "b", "root": "rb"}), "b")
        links = materialise(left.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if total is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 2) -> DataFrame:
    """``id_col, fp, component_id`` of every row: links join fingerprints at most ``distance`` bits apart.

    ``component_id`` is the smallest non-null id reachable, the row's own included.  Null texts
    count as empty; repeated rows and equal texts share a fingerprint and so a component.  Texts of any
    length are taken whole; an empty table gives no rows.
    """
    own = materialise(fingerprints(docs, id_col, text_col, size))
    distinct = materialise(own.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = components(fingerprint_links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    named = materialise(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.join(named.join(least, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


# ------------------------------------------- near copies by shingle similarity

WIDE, SIMILAR_BITS, FIRST_BITS = ("w0", "w1", "w2", "w3"), 72, 26
SIMILAR = 4, 5  # a Jaccard similarity of 4/5
BANDS, ROWS = 16, 6
CROWD, CELL = 200, 1_000
_KEYS = tuple(f"k{i}" for i in range(BANDS))
_TURNS = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    h = h + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, ends = (ends - lens)[: max(1, len(words) - size + 1)].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, ends, strict=True)), np.uint64, len(starts)))


def _bands(h: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of ``ROWS`` MinHash values each: two sets share a value with a probability of their Jaccard similarity."""
    low = np.full(len(_TURNS), 2**64 - 1, np.uint64)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, np.multiply.outer(h[at : at + 2048], _TURNS).min(axis=0))
    return (_mixed(low, 0).reshape(BANDS, ROWS) * _TURNS[:ROWS]).sum(axis=1, dtype=np.uint64)


def wide_simhash(text: str | None, size: int = 5) -> list[int]:
    """Hash of the set of ``size``-word shingles, its 256 SimHash bits and its ``BANDS`` MinHash keys; zeros without words."""
    h = shingles(text, size)
    if not len(h):
        return [0] * (1 + len(WIDE) + BANDS)
    out = []
    for turn in range(len(WIDE)):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):
            ones += np.unpackbits(_mixed(h[at : at + 65_536], turn).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h)).view(np.int64)[0]))
    node = np.uint64(xxhash.xxh64_intdigest(h.tobytes(), 42))
    return [int(node.view(np.int64)), *out, *_bands(h).view(np.int64).tolist()]


def shingle_sets(docs: DataFrame, nodes: DataFrame, text_col: str, size: int) -> DataFrame:
    """``node, set`` (bytes of sorted hashes) of ``nodes`` (``node, th``), each from one text of the hash ``th``."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, size).tobytes() for t in texts], dtype=object)

    texts = docs.select(F.xxhash64(text_or_empty(text_col)).alias("th"), F.col(text_col).alias("text")).join(nodes, "th")
    return materialise(texts.groupBy("node").agg(F.first("text").alias("text")).select("node", packed("text").alias("set")))


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` ``a, b`` with their shingle sets ``set_a, set_b``; a node of very many pairs goes to several tasks."""
    for side in ("a", "b"):
        parts = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("parts"))
        own = parts.join(sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")), side)
        own = own.select(side, f"set_{side}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
        other = F.col("b" if side == "a" else "a")
        pairs = pairs.join(parts, side).withColumn("salt", F.pmod(F.hash(other), "parts")).drop("parts").join(own, [side, "salt"]).drop("salt")
    return pairs.select("a", "b", "set_a", "set_b")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, whole = SIMILAR
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(whole * common >= part * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    hand_back()


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` ``a, b`` whose shingle ``sets`` have a Jaccard similarity of ``SIMILAR`` or more, exactly."""
    return with_sets(pairs, sets).mapInArrow(_similar, "a long, b long")


def _against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes: list[tuple[int, int, int]] = []
        novel: list[np.ndarray] = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            new = np.setdiff1d(y, x, assume_unique=True)
            sizes.append((len(x), len(y), len(y) - len(new)))
            novel.append(new.view(np.int64))
        columns = [pa.array(c, pa.int32()) for c in zip(*sizes, strict=True)] or [pa.array([], pa.int32())] * 3
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns, pa.array(novel, pa.list_(pa.int64()))], ["pivot", "node", "size", "n", "o", "novel"])
    hand_back()


def against_pivots(attached: DataFrame, sets: DataFrame) -> DataFrame:
    """``pivot, node, size, n, o, novel`` of ``attached`` (``pivot, node``): sizes of both sets, how much they share, and what only the node has."""
    pairs = attached.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return with_sets(pairs, sets).mapInArrow(_against_pivot, "pivot long, node long, size int, n int, o int, novel array<long>")


def rooted(dealt: DataFrame, roots: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows of ``dealt`` with their ``root``, ``kind, key, n`` of the keys whose rows are not yet all of one root)."""
    dealt = dealt.withColumn("root", F.col("node")) if roots is None else dealt.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = dealt.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("x"), F.max("root").alias("y"))
    return dealt, materialise(sizes.where("x <> y").select("kind", "key", "n"))


def pivots(rows: DataFrame, crowded: DataFrame) -> DataFrame:
    """``pivot, node, fame``: every row of the ``crowded`` keys (``kind, key, n``) with the pivot of each of its keys.

    A node's fame is the number of rows that share its keys; the most famous one is the pivot of a key.  In a group of copies
    that is the text they were made from, if it is there, since it has the commonest keys.
    """
    rows = rows.join(crowded, ["kind", "key"])
    fame = rows.groupBy("node").agg(F.sum("n").alias("fame"))
    middle = rows.join(fame, "node").groupBy("kind", "key").agg(F.max(F.struct("fame", F.xxhash64("node").alias("h"), "node")).alias("m"))
    return rows.join(middle, ["kind", "key"]).select(F.col("m.node").alias("pivot"), "node", F.col("m.fame").alias("fame")).where("pivot <> node").distinct()


def consensus(facts: DataFrame, crowd: int) -> DataFrame:
    """``pivot, node, size, n, o, novel`` of :func:`against_pivots`, where what more than ``crowd`` nodes have beyond the pivot counts as the pivot's too."""
    tokens = facts.select("pivot", "node", F.explode("novel").alias("t"))
    common = materialise(tokens.groupBy("pivot", "t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowd).select("pivot", "t"))
    mine = tokens.join(common, ["pivot", "t"]).groupBy("pivot", "node").agg(F.collect_list("t").alias("more"))
    grown = common.groupBy("pivot").agg(F.count(F.lit(1)).cast("int").alias("grown"))
    both = facts.join(mine, ["pivot", "node"], "left").join(grown, "pivot", "left").withColumn("more", F.coalesce("more", F.array().cast("array<bigint>")))
    return both.select("pivot", "node", (F.col("size") + F.coalesce("grown", F.lit(0))).alias("size"), "n", (F.col("o") + F.size("more")).alias("o"), F.array_except("novel", "more").alias("novel"))


def centre_pairs(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of the node nearest to what the nodes around a pivot have in common with each of them, unless they have one root."""
    near = F.col("o") / (F.col("size") + F.col("n") - F.col("o"))
    named = facts.select("pivot", "node", near.alias("near")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    middle = named.groupBy("pivot").agg(F.max(F.struct("near", F.xxhash64("node").alias("h"), "node", "root")).alias("m"))
    return named.join(middle, "pivot").where("root <> m.root").select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b")).distinct()


def around_pivots(facts: DataFrame, roots: DataFrame, homes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of different roots around one pivot that can still be similar.

    Two nodes share at most the lesser of their overlaps with the pivot (``facts`` of :func:`consensus`) and what both have beyond it.  So they are similar only if
    their sizes and overlaps alone allow it, or if they share something rare, on which they meet.  Pairs that share another ``home``, the most famous of their
    pivots, are settled there.
    """
    part, whole = SIMILAR
    named = facts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(homes, "node")
    tokens = named.select("pivot", "node", "root", "home", F.explode("novel").alias("t"))
    groups = materialise(tokens.groupBy("pivot", "t").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("x"), F.max("root").alias("y")).where("c > 1 and x <> y").select("pivot", "t"))
    few = tokens.join(groups, ["pivot", "t"])
    side = lambda df, n, *more: df.select("pivot", *more, F.col("node").alias(n), F.col("root").alias(f"r{n}"), F.col("home").alias(f"h{n}"))
    apart = "ra <> rb and not (ha = hb and ha <> pivot)"
    sharing = side(few, "a", "t").join(side(few, "b", "t"), ["pivot", "t"]).where(f"a < b and {apart}").select("a", "b")

    main = roots.select(F.col("node").alias("pivot"), F.col("root").alias("main"))
    sized = named.join(main, "pivot", "left").withColumn("out", F.col("root") != F.coalesce("main", "pivot"))
    sized = materialise(sized.select("pivot", "node", "root", "home", "n", F.col("o").cast("int").alias("o"), "out"))
    most = F.floor(((whole + part) * F.col("o") - part * F.col("n")) / part).cast("int")  # the largest size that the overlap allows
    low = sized.where(most >= F.col("o")).withColumn("n", F.explode(F.sequence("o", most)))

    def met(small: DataFrame, large: DataFrame) -> DataFrame:
        both = side(small, "a", "n", F.col("o").alias("oa")).join(side(large, "b", "n", F.col("o").alias("ob")), ["pivot", "n"])
        return both.where(f"ob >= oa and a <> b and {apart}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    return sharing.unionByName(met(low.where("out"), sized)).unionByName(met(low.where("not out"), sized.where("out"))).distinct()


def celled(dealt: DataFrame, open_keys: DataFrame, cell: int) -> DataFrame:
    """Rows of ``open_keys``, a key of more than ``cell`` rows dealt as pairs of parts of about that size.

    ``side`` tells the parts of a pair apart and is -1 where both are the same part.
    """
    rows = dealt.join(open_keys, ["kind", "key"]).withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    key = F.when(F.col("parts") > 1, F.xxhash64("key", low, high)).otherwise(F.col("key"))
    side = F.when(low == high, -1).when(F.col("part") == low, 0).otherwise(1)
    return rows.withColumn("key", key).withColumn("side", side).drop("n", "parts", "part", "other")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, crowd: int = CROWD, cell: int = CELL) -> DataFrame:
    """``id_col, th, node, root`` of every row: texts of one ``root`` are near copies of each other.

    Two texts are near copies when their sets of ``size``-word shingles have a Jaccard similarity of
    ``SIMILAR`` or more, which is decided by the sets.  Candidates share one of ``BANDS`` keys of ``ROWS``
    MinHash values of the shingles.  A value is shared with a probability of the similarity, whatever was
    edited and however many texts there are, so at 0.8 a pair has no common key with probability
    (1 - 0.8 ** ROWS) ** BANDS, less than 0.01.  Of them the 256-bit SimHash must differ in at most
    ``SIMILAR_BITS`` bits: at 0.8, 39 bits are expected to differ with a deviation of 6.

    A key of more than ``crowd`` texts is not paired: its texts meet one of them, the pivot, and what is similar to it
    gets one root; the rest is found through what texts have beyond the pivot (:func:`around_pivots`).  In all other keys pairs of different roots
    are searched, in parts of about ``cell`` texts; those that share a pivot are settled.
    Null texts are empty, and texts without words are near copies of each other; ``th`` is the text's hash and
    ``node`` that of its shingles.  Repeated rows stay; an empty table gives no rows.
    """

    long_texts(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def wide(texts: pd.Series) -> pd.Series:
        return pd.Series([wide_simhash(t, size) for t in texts], dtype=object)

    columns = ["node", *WIDE, *_KEYS]
    own = docs.select(id_col, F.xxhash64(text_or_empty(text_col)).alias("th"), wide(text_col).alias("v"))
    own = materialise(own.select(id_col, "th", *[F.col("v")[i].alias(c) for i, c in enumerate(columns)]))
    distinct = materialise(own.groupBy("node").agg(*[F.min(c).alias(c) for c in ("th", *columns[1:])]))
    keys = [F.struct(F.lit(t).alias("kind"), F.col(c).alias("key")) for t, c in enumerate(_KEYS)]
    dealt = distinct.select("node", *WIDE, F.explode(F.array(*keys)).alias("k")).select("k.kind", "k.key", "node", F.col("w0").alias("fp"), *WIDE[1:])
    several = dealt.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "key")
    dealt = materialise(dealt.join(several, ["kind", "key"]))
    sets = shingle_sets(docs, dealt.select("node").distinct().join(distinct.select("node", "th"), "node"), text_col, size)
    links, roots, home = [], None, F.col("node").alias("home")
    rows, left = rooted(dealt, None)
    crowded = left.where(F.col("n") > crowd)
    cells = celled(rows, left.where(F.col("n") <= crowd), cell)
    if not crowded.isEmpty():
        attached = materialise(pivots(rows, crowded))
        homes = materialise(attached.groupBy("node").agg(F.max(F.struct("fame", "pivot")).alias("h")).select("node", F.col("h.pivot").alias("home")))
        facts = materialise(against_pivots(attached.select("pivot", "node"), sets))
        part, whole = SIMILAR
        links.append(facts.where(whole * F.col("o") >= part * (F.col("size") + F.col("n") - F.col("o"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")))
        roots = components(functools.reduce(DataFrame.unionByName, links))
        facts = materialise(consensus(facts, crowd))
        links.append(materialise(similar(materialise(centre_pairs(facts, roots)), sets)))
        roots = components(functools.reduce(DataFrame.unionByName, links))
        links.append(materialise(similar(materialise(around_pivots(facts, roots, homes)), sets)))
        roots = components(functools.reduce(DataFrame.unionByName, links))
        rows, _ = rooted(dealt, roots)
        cells = celled(rows, left.where(F.col("n") <= crowd), cell).join(homes, "node", "left")
        home = F.coalesce("home", "node").alias("home")
    cells = cells.select("kind", "key", "node", "fp", *WIDE[1:], "root", "side", home).repartition("kind", "key").sortWithinPartitions("kind", "key")
    pairs = materialise(cells.mapInPandas(_search_keys(FIRST_BITS, WIDE[1:], SIMILAR_BITS), "a long, b long").distinct())
    roots = components(functools.reduce(DataFrame.unionByName, links + [similar(pairs, sets)]))
    return own.select(id_col, "th", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of ``docs`` with the smallest (id, text hash) of every group; of repeated rows the first by a hash of the row.

    ``groups`` is a result of :func:`near_copies` for ``docs``; rows with a null id count as smallest.  An empty
    table gives no rows.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit("~"))
    kept = groups.groupBy("root").agg(F.min(F.struct(id_col, "th")).alias("one")).select(name(F.col(f"one.{id_col}")).alias("_id"), F.col("one.th").alias("_th"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), name(F.col(id_col)).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_th")).join(kept, ["_id", "_th"])
    first = F.row_number().over(Window.partitionBy("_id", "_th").orderBy(F.xxhash64(F.to_json("row")), F.to_json("row")))
    return rows.withColumn("_n", first).where("_n = 1").select("row.*")
