"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built over a bounded piece of labelled text.  A text is parsed
greedily into phrases, each the longest prefix of what is left that occurs in the language's text;
its phrase rate (phrases per symbol) estimates the cross entropy.  The language with the fewest
phrases wins.

The automata become dense tables whose missing transitions restart at the root and carry a phrase
mark, so a batch of texts is parsed in step, one table lookup a symbol and language.  Long texts
are parsed in runs of ``RUN`` symbols (a phrase ends at a run's end, in every language alike).

Every letter counts: the commonest letters of the training text have symbols of their own, every other letter
has one of ``BLOCKS`` symbols by its block of 256 code points, so that scripts stay apart.

Only the automata look at a sample, bounded by parameters of :func:`fit_languages`: ``chars`` symbols a language
(default 40,000) and ``total`` symbols of all languages (default 400,000, which is what the tables' memory grows
with), from at most ``BUCKETS`` documents a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hand_back

RUN, BUCKETS, ALPHABET, BLOCKS, PIECE = 512, 128, 64, 14, 600


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    symbols: np.ndarray  # code point below 65536 -> symbol; 0 separator, 1 to BLOCKS other letters by block
    tables: list[np.ndarray]  # (state * alphabet + symbol) -> 2 * next state + phrase mark


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings of ``seq`` (Blumer et al. 1985); state 0 is the root."""
    nexts, links, lengths, last = [{}], [-1], [0], 0
    for c in seq:
        new = len(nexts)
        nexts.append({})
        links.append(0)
        lengths.append(lengths[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if lengths[q] == lengths[p] + 1:
                links[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = links[p]
                links[q] = links[new] = twin
        last = new
    return nexts


def parse_table(seq: list[int], alphabet: int) -> np.ndarray:
    """The automaton of ``seq`` as a table; the symbol ``alphabet - 1`` pads and neither moves nor counts."""
    nexts = suffix_automaton(seq)
    root = np.ones(alphabet, np.int32)  # unknown symbol: back at the root, one phrase
    for c, s in nexts[0].items():
        root[c] = 2 * s + 1
    table = np.tile(root, (len(nexts), 1))
    table[0, [*nexts[0]]] -= 1  # the phrase that begins at the root is marked when it ends
    for s, own in enumerate(nexts[1:], 1):
        table[s, [*own]] = 2 * np.fromiter(own.values(), np.int32, len(own))
    table[:, alphabet - 1] = 2 * np.arange(len(nexts))
    return table.ravel()


def to_symbols(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, length of each); runs of other characters become one separator."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    s = symbols[np.minimum(code, len(symbols) - 1)]
    above = np.flatnonzero(code >= 65_536)  # planes above the first: letters share a symbol, signs such as emoji are none
    if len(above):
        kinds, which = np.unique(code[above], return_inverse=True)
        s[above] = np.where([chr(c).isalpha() for c in kinds.tolist()], BLOCKS, 0)[which]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0) | (doc[1:] != doc[:-1])
    return s[keep], np.bincount(doc[keep], minlength=len(texts))


def phrase_counts(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages phrase counts, letters of each text)."""
    s, lens = to_symbols(texts, model.symbols)
    runs = -(-lens // RUN)
    owner = np.repeat(np.arange(len(texts)), runs)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = np.repeat(np.cumsum(lens) - lens, runs) + within * RUN
    size = np.minimum(RUN, np.repeat(lens, runs) - within * RUN)
    order = np.argsort(-size, kind="stable")  # so that ended runs drop off at the back
    owner, begin, size = owner[order], begin[order], size[order]
    active = len(size) - np.searchsorted(size[::-1], np.arange(RUN), side="right")
    counts = np.zeros((len(texts), len(model.languages)), np.int64)
    for k, table in enumerate(model.tables):
        state, phrases = np.zeros(len(size), np.int32), np.ones(len(size), np.int32)
        for i in range(RUN):
            n = active[i]
            if not n:
                break
            got = table[state[:n] * ALPHABET + s[begin[:n] + i]]
            phrases[:n] += got & 1
            state[:n] = got >> 1
        counts[:, k] = np.bincount(owner, weights=phrases, minlength=len(texts))
    text_of = np.repeat(np.arange(len(texts)), lens)
    return counts, np.bincount(text_of[s != 0], minlength=len(texts))


def in_parts(texts: list[str], chars: int = 2_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters together, to bound the arrays of a step."""
    part, held = [], 0
    for t in texts:
        if part and held + len(t) > chars:
            yield part
            part, held = [], 0
        part.append(t)
        held += len(t)
    if part:
        yield part


def letter_symbols(letters: Counter) -> np.ndarray:
    """Symbol of every code point below 65536."""
    code = np.arange(65_536)
    block = 1 + ((code >> 8) * 11) % BLOCKS
    symbols = np.where([chr(c).isalpha() for c in code], block, 0).astype(np.uint8)
    first = {c: n for c, n in letters.items() if ord(c) < 65_536}
    for k, (c, _) in enumerate(sorted(first.items(), key=lambda x: (-x[1], x[0]))[: ALPHABET - BLOCKS - 2]):
        symbols[ord(c)] = BLOCKS + 1 + k
    return symbols


def fit_languages(docs: DataFrame, chars: int = 40_000, total: int = 400_000) -> LanguageModel | None:
    """Fit on ``docs`` (doc_id, text, lang); rows with a null id, text or lang take no part; None without any.

    Of several texts of an id and language the first in order counts.
    """
    docs = docs.where("text is not null and lang is not null and doc_id is not null")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    picked = docs.groupBy("lang", bucket.alias("b")).agg(F.min_by("doc_id", F.struct(F.xxhash64("doc_id", F.lit(1)), "doc_id")).alias("doc_id")).select("doc_id").collect()
    if not picked:
        return None
    ids = sorted({r["doc_id"] for r in picked})
    start = (F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1) + 1).cast("int")
    pieces = docs.where(F.col("doc_id").isin(ids)).select("doc_id", "lang", F.substring("text", start, F.lit(PIECE)).alias("p"))
    rows = pieces.groupBy("doc_id", "lang").agg(F.min("p").alias("p")).orderBy("lang", F.xxhash64("doc_id"), "doc_id").collect()  # one piece an id and language
    languages = sorted({r["lang"] for r in rows})
    chars = max(min(chars, total // len(languages)), 1)
    symbols = letter_symbols(Counter(c for r in rows for c in r["p"].lower() if c.isalpha() and ord(c) < 65_535))
    tables = []
    for lang in languages:
        s, _ = to_symbols([" " + " ".join(r["p"] for r in rows if r["lang"] == lang) + " "], symbols)
        tables.append(parse_table(s[:chars].tolist(), ALPHABET))
    return LanguageModel(languages, symbols, tables)


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``lang_pred`` and ``score`` (0 to 1) from its ``text``; these replace columns of the same name.

    ``und`` with score 0 for a text that is null or has no letter (or without a model).  The score
    is ``second / (best + second)`` of the phrase counts, 0.5 on a tie, which goes to the
    alphabetically first language; with one language it is 1.  Texts of any length are parsed whole, repeated
    rows stay, and an empty table gives no rows.
    """

    keep = [c for c in keep if c not in ("lang_pred", "score")]

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if model and texts:
                parts = [phrase_counts(part, model) for part in in_parts(texts)]
                counts, letters = (np.concatenate(x) for x in zip(*parts, strict=True))
                ranked = np.sort(counts, axis=1)
                best, second = ranked[:, 0], ranked[:, min(1, ranked.shape[1] - 1)]
                some = letters > 0
                pred[some] = np.array(model.languages, object)[counts.argmin(axis=1)[some]]
                score[some] = 1.0 if len(model.languages) == 1 else (second / np.maximum(best + second, 1))[some]
            yield pdf[keep].assign(lang_pred=pred, score=score)
        hand_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(predict, f"{schema}, lang_pred string, score double")
