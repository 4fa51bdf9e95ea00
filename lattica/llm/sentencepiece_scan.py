"""SentencePiece encoding and decoding as a max-plus scan over a lattice of pieces.

A text is a path through the lattice of its pieces.  For a unigram model a path weighs the sum of
its piece scores.  For a BPE model a path weighs 0 if every neighbouring pair is one that merging
leaves alone, and minus infinity otherwise; the one path of weight 0 is what merging gives.

No piece of a cuttable model goes on after white space has begun, so words are parsed alone and
remembered.  Documents longer than ``CHUNK`` characters are cut anywhere: a chunk yields its transfer matrix,
from the pieces that may lie across its start to those that may lie across its end.  A parallel scan combines
the matrices by max-plus products: ``FAN`` neighbours become one matrix, these again, in as many rounds as the
logarithm of the longest document's chunks; then the states at the outer boundaries go down the same rounds and
fix those within.  Last, each chunk is traced back on its own.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from .common import hand_back, long_texts, materialise

CHUNK, REMEMBERED, FAN = 32_768, 250_000, 16
SPACE = "▁"
UNIGRAM, BPE = 1, 2
_CUT = re.compile(f"[^{SPACE}]{SPACE}")
_RUN = re.compile(r"[^\W\d_]+|[\W\d_]")
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

State = tuple[int, int]  # a piece, and how many of its characters lie beyond the boundary
START: State = (-1, 0)  # nothing lies across, and what comes next does not depend on it


@dataclass
class PieceModel:
    """What encoding needs of a model file; refuses models that need a normaliser or lack byte pieces."""

    ids: dict[str, int]
    pieces: list[str]
    scores: list[float]
    kind: int
    byte_ids: list[int]
    prefix: bool

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.ids), default=1)
        self.cuttable = not any(p[i] == SPACE != p[i - 1] for p in self.ids for i in range(1, len(p)))
        self.unknown = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10
        self.stay: dict[int, bool] = {}  # by a * 2^21 + b
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remember = REMEMBERED
        self.crossing: dict[str, list[tuple[str, int]]] = {}  # pieces with two characters side by side where a run of letters ends
        for p in self.ids:
            for k in range(len(p) - 1):
                if not (p[k].isalpha() and p[k + 1].isalpha()):
                    self.crossing.setdefault(p[k : k + 2], []).append((p, k))
        self.sizes = [len(p) for p in self.pieces]
        self.rank = [-x for x in self.scores]
        self.split: dict[int, tuple[int, int] | None] = {}
        self.prefixes: dict[str, int] = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for value, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([value])

    @classmethod
    def read(cls, content: bytes) -> PieceModel:
        m = proto.ModelProto()
        m.ParseFromString(content)
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.trainer_spec.byte_fallback or m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with byte pieces and no normaliser")
        pieces, scores = [p.piece for p in m.pieces], [p.score for p in m.pieces]
        byte_ids = sorted((i for i, p in enumerate(m.pieces) if p.type == 6), key=lambda i: int(pieces[i][3:5], 16))
        return cls({p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}, pieces, scores, m.trainer_spec.model_type, byte_ids, m.normalizer_spec.add_dummy_prefix)

    def normal(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self.prefix and text else text

    def piece(self, text: str) -> int | None:
        """Id of a piece; for a character that is none, a number past the pieces that stands for its bytes."""
        found = self.ids.get(text)
        if found is None and len(text) == 1:
            found = len(self.pieces) + ord(text)
        return found

    def out(self, piece: int) -> list[int]:
        return [piece] if piece < len(self.pieces) else [self.byte_ids[b] for b in chr(piece - len(self.pieces)).encode("utf-8", "surrogatepass")]

    def chars(self, piece: int) -> str:
        return self.pieces[piece] if piece < len(self.pieces) else chr(piece - len(self.pieces))

    def weight(self, piece: int) -> float:
        return 0.0 if self.kind == BPE else self.scores[piece] if piece < len(self.pieces) else self.unknown

    def halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes a piece out of its characters; None for one that merging never makes."""
        if piece not in self.split:
            parts, last = [self.ids.get(c, -1) for c in self.pieces[piece]], None
            text = [*self.pieces[piece]]
            while len(text) > 1:
                ways = [(self.rank[i], k, i) for k in range(len(text) - 1) if (i := self.ids.get(text[k] + text[k + 1])) is not None]
                if not ways:
                    break
                _, k, i = min(ways)
                last = parts[k], parts[k + 1]
                text[k : k + 2], parts[k : k + 2] = [text[k] + text[k + 1]], [i]
            self.split[piece] = last if len(text) == 1 else None
        return self.split[piece]

    def fits(self, a: int, b: int) -> bool:
        """Would merging leave pieces a and b alone, side by side?

        Merges are undone from the last: while either piece is taken apart next to the border, a piece
        across the border must not have been due before the merge that is undone.
        """
        known = len(self.pieces)
        if self.kind != BPE or a < 0 or a >= known or b >= known:
            return True
        found = self.stay.get(a << 21 | b)
        if found is None:
            if len(self.stay) > REMEMBERED:
                self.stay.clear()
            found = self.stay[a << 21 | b] = self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        rank, single = self.rank, self.sizes
        if (single[a] > 1 and self.halves(a) is None) or (single[b] > 1 and self.halves(b) is None):
            return False
        # what would be merged across the border is due before ``due``; ties go to the left
        due: tuple[float, int] = (float("inf"), 0)
        while True:
            across = self.ids.get(self.pieces[a] + self.pieces[b])
            if across is not None and (rank[across], 1) < due:
                return False
            ra, rb = (rank[a] if single[a] > 1 else -1.0), (rank[b] if single[b] > 1 else -1.0)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                due, a = (ra, 1), self.halves(a)[1]
            else:
                due, b = (rb, 2), self.halves(b)[0]


@functools.lru_cache(maxsize=2)
def _model(content: bytes) -> PieceModel:
    return PieceModel.read(content)


def paths(model: PieceModel, text: str, start: int, last: int, stop: int) -> list[dict[int, tuple[float, int, int]]]:
    """Best ways from ``start``, after piece ``last``: per position the last piece -> (weight, where it begins, piece before).

    Pieces begin before ``stop`` and may end past it.  A unigram model keeps one piece a position
    before ``stop``, since what follows does not depend on it.
    """
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(text) + 1)]
    best[start][last] = (0.0, -1, -1)
    for p in range(start, stop):
        here = best[p]
        if not here:
            continue
        if model.kind == UNIGRAM and len(here) > 1:
            here = {t: w for t, w in here.items() if w[0] == max(x[0] for x in here.values())}
            here = dict([min(here.items(), key=lambda x: x[1][1])])  # the longest of equals
            best[p] = here
        for size in range(1, min(model.longest, len(text) - p) + 1):
            piece = model.piece(text[p : p + size])
            if piece is None:
                continue
            weight, there = model.weight(piece), best[p + size]
            for before, (w, _, _) in here.items():
                if (piece not in there or w + weight > there[piece][0]) and model.fits(before, piece):
                    there[piece] = (w + weight, p, before)
    return best


def _trace(best: list[dict[int, tuple[float, int, int]]], end: int, piece: int, start: int) -> list[int]:
    found = []
    while end > start:
        found.append(piece)
        _, end, piece = best[end][piece]
    return found[::-1]


def _best_end(best: list[dict[int, tuple[float, int, int]]], end: int) -> int:
    if not best[end]:
        raise ValueError("no path through the lattice")
    return max(best[end].items(), key=lambda x: (x[1][0], -x[1][1]))[0]


def _pieces_at(model: PieceModel, word: str, at: int) -> list[int]:
    """Pieces that begin at a place of the word, the longest last."""
    get, end, n, found = model.prefixes.get, at + 1, len(word), []
    piece = get(word[at:end], -1)
    if piece < 0:
        found.append(len(model.pieces) + ord(word[at]))
    while piece is not None:
        if piece >= 0:
            found.append(piece)
        end += 1
        if end > n:
            break
        piece = get(word[at:end])
    return found


def _merging_path(model: PieceModel, word: str) -> list[int]:
    """The one path of weight 0 through a BPE word's lattice, depth first with the longest piece first.

    Merging is unique for every beginning of a word, so a place is reached by one path at most and
    the search expands each place once.
    """
    known, stay, size, n = len(model.pieces), model.stay, model.sizes, len(word)
    found: list[int] = []
    waiting, at, before = [_pieces_at(model, word, 0)], 0, -1
    while True:
        open_ = waiting[-1]
        if not open_:
            if not found:
                raise ValueError("no path through the lattice")
            waiting.pop()
            piece = found.pop()
            at -= size[piece] if piece < known else 1
            before = found[-1] if found else -1
            continue
        piece = open_.pop()
        if before >= 0 and piece < known and before < known:
            fits = stay.get(before << 21 | piece)
            if not (model.fits(before, piece) if fits is None else fits):
                continue
        found.append(piece)
        before = piece
        at += size[piece] if piece < known else 1
        if at == n:
            return found
        waiting.append(_pieces_at(model, word, at))


def _known_ids(model: PieceModel, word: str) -> bytes:
    """Ids of a word; single runs of letters are remembered, what is made of several is put together from them."""
    found = model.words.get(word)
    if found is None:
        cuts, crossing = [0], model.crossing
        if len(word) > 1 and not word[-1].isalpha() and word[-2:] not in crossing:
            return _known_ids(model, word[:-1]) + _known_ids(model, word[-1])
        for m in _RUN.finditer(word):
            i = m.end()
            if i < len(word) and not any(i > k and word.startswith(p, i - 1 - k) for p, k in crossing.get(word[i - 1 : i + 1], ())):
                cuts.append(i)
        if len(cuts) > 1:
            return b"".join([_known_ids(model, word[a:b]) for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)])
        found = model.older.get(word)
        if found is None:
            found = word_ids(model, word)
        if len(model.words) > model.remember:  # words met again move on to the new generation
            model.older, model.words = model.words, {}
        model.words[word] = found
    return found


def word_ids(model: PieceModel, word: str) -> bytes:
    """Ids (int32) of a stretch that nothing lies across."""
    if model.kind == BPE:
        found = _merging_path(model, word)
        if max(found) >= len(model.pieces):
            found = [i for p in found for i in model.out(p)]
        return array("i", found).tobytes()
    best = paths(model, word, 0, -1, len(word))
    return np.array([i for p in _trace(best, len(word), _best_end(best, len(word)), 0) for i in model.out(p)], np.int32).tobytes()


def encode_whole(model: PieceModel, text: str) -> bytes:
    """Ids (int32) of a whole text of moderate length."""
    if not model.cuttable:
        return word_ids(model, model.normal(text))
    return _words(model, model.normal(text))


def _words(model: PieceModel, text: str) -> bytes:
    """Ids of a text whose spaces are marks already."""
    if SPACE + SPACE in text:
        return b"".join([_known_ids(model, w) for w in _WORD.findall(text)])
    known = model.words
    return b"".join([known.get(w) or _known_ids(model, w) for w in text.replace(SPACE, " " + SPACE).split(" ") if w])


def decode(model: PieceModel, ids: np.ndarray) -> str:
    """The text of ids: bytes joined, white space marks back to spaces, the leading one dropped."""
    raw = model.raw
    text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
    return text[1:] if model.prefix and text.startswith(" ") else text


# ---------------------------------------------------------------- giant texts


@dataclass
class _Cut:
    """A chunk with its surroundings; positions are within ``text``."""

    text: str
    begin: int
    end: int
    final: bool

    def cuts(self, model: PieceModel) -> tuple[int, int]:
        """First and last place in [begin, end] that no piece lies across; (-1, -1) if none."""
        if self.final and self.begin == 0:
            return 0, self.end
        first = last = -1
        if self.begin == 0:
            first = last = 0
        if model.cuttable:
            found = _CUT.search(self.text, max(self.begin - 1, 0), self.end + 1)
            if found:
                last = self.text.rfind(SPACE, self.begin, self.end + 1)
                while last > 0 and self.text[last - 1] == SPACE:
                    last -= 1
                first = first if first >= 0 else found.start() + 1
                last = max(last, first)
        if self.final:
            first, last = first if first >= 0 else self.end, self.end
        return first, last

    def starts(self, model: PieceModel) -> list[State]:
        """States that the text allows at the chunk's begin."""
        if self.begin == 0 or (model.cuttable and self.text[self.begin] == SPACE != self.text[self.begin - 1]):
            return [START]
        return [
            (piece, p + size - self.begin)
            for p in range(max(0, self.begin - model.longest), self.begin)
            for size in range(self.begin - p, model.longest + 1)
            if p + size <= len(self.text) and (piece := model.piece(self.text[p : p + size])) is not None
        ]


def _ends(best: list[dict[int, tuple[float, int, int]]], end: int, cut_there: bool) -> dict[State, float]:
    if cut_there:
        return {START: max(w for w, _, _ in best[end].values())} if best[end] else {}
    return {(piece, e - end): w for e in range(end, len(best)) for piece, (w, begun, _) in best[e].items() if e == end or begun < end}


def transfer(model: PieceModel, cut: _Cut) -> dict[State, dict[State, float]]:
    """Max-plus matrix of a chunk: from each state at its begin to each state at its end."""
    first, last = cut.cuts(model)
    if first < 0:
        return {s: _ends(paths(model, cut.text, cut.begin + s[1], s[0], cut.end), cut.end, False) for s in cut.starts(model)}
    body = 0.0
    if model.kind == UNIGRAM:
        body = sum(model.weight(i) for w in ([cut.text[first:last]] if not model.cuttable else _WORD.findall(cut.text[first:last])) if w for i in _pieces(model, w))
    tail = {START: 0.0} if last == cut.end else _ends(paths(model, cut.text, last, -1, cut.end), cut.end, False)
    out = {}
    for s in cut.starts(model):
        at = cut.begin + s[1]
        if s == START and at == first:
            head = 0.0
        elif at > first:
            continue
        else:
            best = paths(model, cut.text[:first], at, s[0], first)
            if not best[first]:
                continue
            head = max(w for w, _, _ in best[first].values())
        out[s] = {e: head + body + w for e, w in tail.items()}
    return out


def _pieces(model: PieceModel, word: str) -> list[int]:
    best = paths(model, word, 0, -1, len(word))
    return _trace(best, len(word), _best_end(best, len(word)), 0)


def product(a: dict[State, dict[State, float]], b: dict[State, dict[State, float]]) -> dict[State, dict[State, float]]:
    """Max-plus product; associative, so chunks may be combined in any grouping."""
    out: dict[State, dict[State, float]] = {}
    for s, row in a.items():
        new = out[s] = {}
        for mid, w in row.items():
            for e, v in b.get(mid, {}).items():
                if e not in new or w + v > new[e]:
                    new[e] = w + v
    return out


def boundary_states(matrices: list[dict[State, dict[State, float]]], start: State = START, end: State | None = None) -> list[State]:
    """States at the n + 1 boundaries of n chunks on the best path from ``start`` to ``end`` (default: the best end)."""
    prefix = [{start: {start: 0.0}}]
    for m in matrices:
        prefix.append(product(prefix[-1], m))
    states = [max(prefix[-1][start].items(), key=lambda x: (x[1], x[0]))[0] if end is None else end]
    for before, m in zip(prefix[-2::-1], matrices[::-1], strict=True):
        after = states[-1]
        states.append(max((w + m[s][after], s) for s, w in before[start].items() if after in m.get(s, {}))[1])
    return states[::-1]


def _matrices_of(rows: pd.DataFrame) -> dict[int, dict[State, dict[State, float]]]:
    """Matrix of each chunk from its entries ``chunk, a, ax, b, bx, w``, by ascending chunk."""
    found: dict[int, dict[State, dict[State, float]]] = {}
    for r in rows.itertuples(index=False):
        found.setdefault(r.chunk, {}).setdefault((r.a, r.ax), {})[r.b, r.bx] = r.w
    return dict(sorted(found.items()))


_ENTRY = "uid long, chunk int, a int, ax int, b int, bx int, w double"
_STATES = "uid long, chunk int, a int, ax int, b int, bx int"


def _entries(uid: int, chunk: int, matrix: dict[State, dict[State, float]]) -> list[tuple]:
    return [(uid, chunk, *s, *e, w) for s, line in matrix.items() for e, w in line.items()]


def _combined(rows: pd.DataFrame) -> pd.DataFrame:
    """Entries of the product of up to ``FAN`` neighbouring matrices of one document."""
    found = _matrices_of(rows)
    return pd.DataFrame(_entries(rows["uid"].iat[0], rows["chunk"].iat[0] // FAN, functools.reduce(product, found.values())), columns=["uid", "chunk", "a", "ax", "b", "bx", "w"])


def _fixed(outer: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """States before and after each of up to ``FAN`` neighbouring chunks, from those around them all."""
    found, o = _matrices_of(rows), next(outer.itertuples(index=False))
    states = boundary_states([*found.values()], (o.a, o.ax), (o.b, o.bx))
    return pd.DataFrame([(o.uid, c, *states[k], *states[k + 1]) for k, c in enumerate(found)], columns=["uid", "chunk", "a", "ax", "b", "bx"])


def scanned(entries: DataFrame) -> DataFrame:
    """``uid, chunk`` and the states before (``a, ax``) and after (``b, bx``) each chunk on its document's best path."""
    last = entries.agg(F.max("chunk")).first()[0]
    levels, n = [entries], 1 + (last or 0)
    block = F.expr(f"chunk div {FAN}").cast("int")
    while n > 1:
        levels.append(levels[-1].withColumn("block", block).groupBy("uid", "block").applyInPandas(_combined, _ENTRY))
        n = -(-n // FAN)
        if n > 1:
            levels[-1] = materialise(levels[-1])
    whole = levels[-1].where((F.col("a") == START[0]) & (F.col("ax") == START[1]))  # a document's matrix, from its begin
    best = F.max_by(F.struct("b", "bx"), F.struct("w", "b", "bx"))
    states = whole.groupBy("uid", "chunk").agg(best.alias("e")).select("uid", "chunk", F.lit(START[0]).alias("a"), F.lit(START[1]).alias("ax"), "e.b", "e.bx")
    for level in levels[-2::-1]:
        outer = states.withColumnRenamed("chunk", "block")
        states = outer.groupBy("uid", "block").cogroup(level.withColumn("block", block).groupBy("uid", "block")).applyInPandas(_fixed, _STATES)
    return states


def chunk_ids(model: PieceModel, cut: _Cut, before: State, after: State) -> bytes:
    """Ids of the pieces that begin in the chunk, given the states at both boundaries."""
    first, last = cut.cuts(model)
    at, to = cut.begin + before[1], cut.end + after[1]
    ids = lambda found: np.array([i for p in found for i in model.out(p)], np.int32).tobytes()
    if first < 0:
        best = paths(model, cut.text, at, before[0], cut.end)
        return ids(_trace(best, to, after[0], at))
    head = b""
    if at < first:
        best = paths(model, cut.text[:first], at, before[0], first)
        head = ids(_trace(best, first, _best_end(best, first), at))
    middle = cut.text[first:last]
    body = b"" if not middle else _words(model, middle) if model.cuttable else word_ids(model, middle)
    tail = b""
    if last < cut.end:
        best = paths(model, cut.text, last, -1, cut.end)
        tail = ids(_trace(best, to, after[0], last))
    return head + body + tail


def _cut_of(row: dict, longest: int) -> _Cut:
    begin = len(row["left"])
    return _Cut(row["left"] + row["body"] + row["right"], begin, begin + len(row["body"]), row["chunk"] == row["chunks"] - 1)


# ------------------------------------------------------------------ operators


def _id_lists(found: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def encode(docs: DataFrame, model_file: bytes, keep: list[str], text_col: str = "text", chunk: int = CHUNK, remember: int = REMEMBERED) -> DataFrame:
    """``keep`` columns, ``chunks`` (how many the text was cut into), ``ids`` and ``decoded`` of every whole text.

    ``decoded`` is the text that the ids give back.

    These replace columns of ``keep`` of the same name.  Null texts are empty and get an empty list.  Texts longer than ``chunk`` characters take the
    chunked path; both paths give the same ids.  A worker remembers up to twice ``remember`` words (about 150 bytes each).  Repeated rows stay;
    extra columns are ignored; an empty table gives no rows.
    """
    long_texts(docs.sparkSession)
    longest = _model(model_file).longest
    names = [c for c in keep if c not in ("chunks", "ids", "decoded")]
    keep = [f"_{i}" for i in range(len(names))]  # apart from the names used below
    docs = docs.select(*[F.col(c).alias(k) for c, k in zip(names, keep, strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_file)
        model.remember = remember
        for batch in batches:
            texts = batch.column("_text")
            for at in range(0, len(texts), 500):
                found = [encode_whole(model, t) for t in texts.slice(at, 500).to_pylist()]
                back = pa.array([decode(model, np.frombuffer(x, np.int32)) for x in found], pa.string())
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([1] * len(found), pa.int32()), _id_lists(found), back], [*keep, "chunks", "ids", "decoded"])
        hand_back()

    short = docs.where(F.length("_text") < chunk).mapInArrow(whole, f"{schema}, chunks int, ids array<int>, decoded string")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(model_file)
        for pdf in batches:
            for uid, t in zip(pdf["uid"], pdf["_text"], strict=True):
                t = model.normal(t)
                n = -(-len(t) // chunk)
                for c in range(n):
                    a, b = c * chunk, min((c + 1) * chunk, len(t))
                    yield pd.DataFrame({"uid": [uid], "chunk": [c], "chunks": [n], "left": [t[max(0, a - longest) : a]], "body": [t[a:b]], "right": [t[b : b + longest]]})

    long = materialise(docs.where(F.length("_text") >= chunk).withColumn("uid", F.monotonically_increasing_id()))
    kinds = "uid long, chunk int, chunks int, left string, body string, right string"
    cut = materialise(long.select("uid", "_text").mapInPandas(split, kinds).repartition("uid", "chunk"))

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(model_file)
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.to_dict("records"):
                out += _entries(row["uid"], row["chunk"], transfer(model, _cut_of(row, longest)))
            yield pd.DataFrame(out, columns=["uid", "chunk", "a", "ax", "b", "bx", "w"])

    entries = materialise(cut.mapInPandas(matrices, _ENTRY))
    states = scanned(entries)

    def traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(model_file)
        for pdf in batches:
            ids = [np.frombuffer(chunk_ids(model, _cut_of(r, longest), (r["a"], r["ax"]), (r["b"], r["bx"])), np.int32) for r in pdf.to_dict("records")]
            yield pd.DataFrame({"uid": pdf["uid"], "chunk": pdf["chunk"], "ids": ids})

    parts = cut.join(states, ["uid", "chunk"]).mapInPandas(traced, "uid long, chunk int, ids array<int>")
    lists = parts.groupBy("uid").agg(F.count(F.lit(1)).cast("int").alias("chunks"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    lists = lists.withColumn("decoded", decoded("ids", model_file))
    found = short.unionByName(long.select("uid", *keep).join(lists, "uid").select(*keep, "chunks", "ids", "decoded"))
    return found.select(*[F.col(k).alias(c) for c, k in zip(names, keep, strict=True)], "chunks", "ids", "decoded")


def decoded(ids_col: str, model_file: bytes):
    """Column of the texts of lists of ids."""

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        model = _model(model_file)
        return pd.Series([decode(model, np.asarray(x, np.int64)) for x in ids], dtype=object)

    return texts(ids_col)
