"""Secret scan: pattern rules, and windows of high Shannon entropy in token-like strings.

Rules give the base spans.  Beside them, every candidate string (a run of token characters) is cut into runs of one character
class at a time; a window slides over such a run while the counts of its characters are kept up by one addition and one removal a step, and
with them ``sum(c log2 c)``, which gives the window's entropy.  Windows that reach the class's bits are joined to spans.
Candidates that an allow-list knows (paths, hosts, hyphened words, ordered alphabets, placeholders) give no entropy
spans; it never touches the rules' spans.

Texts are scanned whole in the task that reads them, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hand_back


class Rule(NamedTuple):
    """A pattern, the group whose length counts, and its least length; shorter matches go."""

    kind: str
    pattern: str
    group: int
    least: int
    any_case: bool = False


class CharClass(NamedTuple):
    """Characters, the window's length and the bits a character that a window must reach."""

    kind: str
    chars: str
    window: int
    bits: float


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs match whole, so asking for the length here finds the same ones
)

#: 20 hexadecimal digits drawn at random have 3.3 bits on average; 24 letters and digits have 4.3, words written together 3.5.
CLASSES = (
    CharClass("dense_hex", "0-9a-f", 20, 3.0),
    CharClass("dense_upper", "A-Z0-9", 20, 3.6),
    CharClass("dense_base64", "A-Za-z0-9+/_-", 24, 4.0),
)

CANDIDATE = r"[A-Za-z0-9+/_.=-]{20,}"

#: Whole candidates that are no secrets: names and words joined by marks, paths and hosts, numbers and dates.
ALLOW = (
    r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[/._=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[/._=+-]*",
    r"[0-9.+/=_-]+",
)

#: Candidates that hold one of these (letters in either case) are placeholders.
PLACEHOLDERS = ("example", "placeholder", "changeme", "xxxx", "0000000000", "abcdefghij", "0123456789", "qwertyuiop")

SPANS = "array<struct<kind:string,start:long,end:long,bits:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))


def dense_windows(text: str, window: int, bits: float) -> list[tuple[int, int, float]]:
    """(start, end, highest entropy) of the joined windows of ``text`` with ``bits`` or more a character; short texts have none."""
    if len(text) < window:
        return []
    table = [0.0] + [c * float(np.log2(c)) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, found = 0.0, []
    need = window * (np.log2(window) - bits) + 1e-9  # sum(c log2 c) must not exceed this
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += table[c + 1] - table[c]
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += table[c - 1] - table[c]
        if i >= window - 1 and total <= need:
            start, entropy = i - window + 1, float(np.log2(window)) - total / window
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1, max(found[-1][2], entropy))
            else:
                found.append((start, i + 1, entropy))
    return found


class Scanner:
    """Compiled rules, classes and allow-list."""

    def __init__(self, rules=RULES, classes=CLASSES, allow=ALLOW, placeholders=PLACEHOLDERS, candidate: str = CANDIDATE) -> None:
        self.rules = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0))) for r in rules]
        self.classes = [(c, re.compile(f"[{c.chars}]{{{c.window},}}")) for c in classes]
        self.allow = [re.compile(a) for a in allow]
        self.placeholders = tuple(placeholders)
        self.candidate = re.compile(candidate)
        self.order = {k: i for i, k in enumerate([*(r.kind for r in rules), *(c.kind for c in classes)])}

    def allowed(self, token: str) -> bool:
        """Whether the allow-list knows the candidate."""
        low = token.lower()
        return any(p in low for p in self.placeholders) or any(a.fullmatch(token) for a in self.allow)

    def scan(self, text: str) -> list[tuple[str, int, int, float | None]]:
        """(kind, start, end, bits) by start, then kind as listed; code points, end exclusive; rules have no bits."""
        found: list[tuple[str, int, int, float | None]] = []
        for rule, pattern in self.rules:
            for m in pattern.finditer(text):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    found.append((rule.kind, m.start(), m.end(), None))
        for m in self.candidate.finditer(text):
            token, at = m.group(), m.start()
            if self.allowed(token):
                continue
            for cls, pattern in self.classes:
                for run in pattern.finditer(token):
                    found += [(cls.kind, at + run.start() + a, at + run.start() + b, h) for a, b, h in dense_windows(run.group(), cls.window, cls.bits)]
        found.sort(key=lambda s: (s[1], self.order[s[0]], s[2]))
        return found


def masked(text: str, spans: list[tuple[str, int, int, float | None]]) -> str:
    """The text with every joined stretch of spans replaced by the first one's kind in brackets."""
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end, _ = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end, k = max(end, spans[k][2]), k + 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text", rules=RULES, classes=CLASSES, allow=ALLOW, placeholders=PLACEHOLDERS) -> DataFrame:
    """``keep`` plus ``secrets`` (array of ``kind, start, end, bits`` by start, then kind as listed) and ``masked``, the text without them.

    Places are code points, ends are exclusive; spans of different kinds may overlap.  Null and empty texts have no spans and an empty
    ``masked``; repeated rows are rows each, an empty table gives none; columns not in ``keep`` play no part.  Whole texts are scanned, at a cost
    linear in their length.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema.fields)
    setup = tuple(rules), tuple(classes), tuple(allow), tuple(placeholders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*setup)
        for batch in batches:
            spans, left = [], []
            for value in batch.column(len(keep)):
                text = value.as_py() or ""
                own = scanner.scan(text)
                spans.append([{"kind": k, "start": a, "end": b, "bits": h} for k, a, b, h in own])
                left.append(masked(text, own))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(spans, _SPANS), pa.array(left, pa.string())], [*keep, "secrets", "masked"])
        hand_back()

    return docs.select(*[f"`{c}`" for c in keep], f"`{text_col}`").mapInArrow(run, f"{schema}, secrets {SPANS}, masked string")


__all__ = ["ALLOW", "CLASSES", "PLACEHOLDERS", "RULES", "CharClass", "Rule", "Scanner", "dense_windows", "find_secrets", "masked"]
