"""Chat formatting with a small sandboxed template language compiled to Python closures.

A template is parsed into a syntax tree, constants are folded, and every node becomes a closure
that writes to an output; ``{% generation %}`` marks the spans that a training loss covers.

Templates know ``{{ expression }}``, ``{% if %}/{% elif %}/{% else %}``, ``{% for x in list %}``
(with ``loop.index0``, ``loop.first``, ``loop.last``), ``{% set %}`` and ``{% generation %}``.
Expressions have names, literals, ``.key`` and ``[key]`` of dicts and lists, ``== != < <= > >= in``,
``and or not``, ``+``, ``~`` and filters.  Nothing else can be reached: no calls, no attributes of
Python objects, no imports.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the escape filter writes for each character that could begin or end a mark.
ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g"}
_BACK = {v[1]: k for k, v in ESCAPES.items()}

TURNS = (
    "{% for m in messages %}<turn {{ m.role | escape }}>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
)


def escape(text: str) -> str:
    return re.sub(r"[\\<>]", lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


FILTERS: dict[str, Callable[..., Any]] = {
    "escape": lambda v: escape(str(v)),
    "trim": lambda v: str(v).strip(),
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "length": len,
    "default": lambda v, d="": d if v is None else v,
}


class TemplateError(ValueError):
    pass


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


# ---------------------------------------------------------------- expressions

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-<>+~.|()\[\],]))")
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b}
_LITERALS = {"true": True, "false": False, "none": None}
_STRING = {"n": "\n", "t": "\t"}


def _add(a: Any, b: Any) -> Any:
    if type(a) is not type(b) or not isinstance(a, (str, int)):
        raise TemplateError("+ takes two texts or two numbers")
    return a + b


def _item(obj: Any, key: Any) -> Any:
    if isinstance(obj, dict):
        return obj.get(key)
    if isinstance(obj, (list, tuple, str)) and isinstance(key, int):
        return obj[key] if -len(obj) <= key < len(obj) else None
    raise TemplateError(f"no member {key!r}")


class _Parser:
    """Recursive descent; a node is ('const', v), ('name', n) or ('op', function, *nodes)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "str"

    def take(self, *values: str) -> str:
        if self.at >= len(self.tokens) or (values and self.tokens[self.at][1] not in values):
            raise TemplateError(f"expected {values or 'an expression'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("op", operator.not_, self.negated())
        return self.compared()

    def compared(self) -> tuple:
        node = self.sum()
        while self.peek(*_COMPARE):
            node = ("op", _COMPARE[self.take()], node, self.sum())
        return node

    def sum(self) -> tuple:
        node = self.filtered()
        while self.peek("+", "~"):
            how = _add if self.take() == "+" else (lambda a, b: _text(a) + _text(b))
            node = ("op", how, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.member()
        while self.peek("|"):
            self.take()
            name, args = self.take(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.peek("("):
                self.take()
                while not self.peek(")"):
                    args.append(self.either())
                    if not self.peek(")"):
                        self.take(",")
                self.take(")")
            node = ("op", FILTERS[name], node, *args)
        return node

    def member(self) -> tuple:
        node = self.atom()
        while self.peek(".", "["):
            if self.take() == ".":
                node = ("op", _item, node, ("const", self.take()))
            else:
                node = ("op", _item, node, self.either())
                self.take("]")
        return node

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("expected an expression")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("const", int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _STRING.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return ("const", _LITERALS[value]) if value in _LITERALS else ("name", value)
        if value == "(":
            node = self.either()
            self.take(")")
            return node
        if value == "-":
            return ("op", operator.neg, self.member())
        raise TemplateError(f"unexpected {value!r}")


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def fold_constants(node: tuple) -> tuple:
    if node[0] in ("and", "or"):
        a, b = fold_constants(node[1]), fold_constants(node[2])
        if a[0] == "const":
            return b if bool(a[1]) == (node[0] == "and") else a
        return (node[0], a, b)
    if node[0] == "op":
        args = [fold_constants(x) for x in node[2:]]
        if all(x[0] == "const" for x in args):
            return ("const", node[1](*[x[1] for x in args]))
        return ("op", node[1], *args)
    return node


def compiled_expression(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda ctx: value
    if kind == "name":
        name = node[1]
        return lambda ctx: ctx.get(name)
    args = [compiled_expression(x) for x in node[1 if kind != "op" else 2 :]]
    if kind == "and":
        return lambda ctx: args[0](ctx) and args[1](ctx)
    if kind == "or":
        return lambda ctx: args[0](ctx) or args[1](ctx)
    how = node[1]
    if len(args) == 1:
        (one,) = args
        return lambda ctx: how(one(ctx))
    return lambda ctx: how(*[a(ctx) for a in args])


# ----------------------------------------------------------------- statements

_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)


def parse(template: str) -> list[tuple]:
    """Syntax tree: text, put, if, for, set and generation nodes."""
    pieces, at = [], 0
    for m in _PIECE.finditer(template):
        pieces += [("text", template[at : m.start()])] if m.start() > at else []
        pieces.append(("put", m[1]) if m[1] is not None else ("tag", m[2]))
        at = m.end()
    pieces += [("text", template[at:])] if at < len(template) else []
    pos = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal pos
        body: list[tuple] = []
        while pos < len(pieces):
            kind, value = pieces[pos]
            pos += 1
            if kind == "text":
                body.append(("text", value))
            elif kind == "put":
                body.append(("put", fold_constants(_Parser(value).whole())))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return body, value
                body.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, ""

    def statement(word: str, rest: str) -> tuple:
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read for {rest!r}")
            return ("for", m[1], fold_constants(_Parser(m[2]).whole()), block("endfor")[0])
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read set {rest!r}")
            return ("set", m[1], fold_constants(_Parser(m[2]).whole()))
        if word == "if":
            arms, test = [], fold_constants(_Parser(rest).whole())
            while True:
                body, end = block("elif", "else", "endif")
                arms.append((test, body))
                if end == "endif":
                    break
                test = ("const", True) if end == "else" else fold_constants(_Parser(end.partition(" ")[2]).whole())
            return ("if", arms)
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


def simplified(body: list[tuple]) -> list[tuple]:
    """Constant puts become text, decided branches stay alone, neighbouring texts join."""
    out: list[tuple] = []
    for node in body:
        found = [node]
        if node[0] == "put" and node[1][0] == "const":
            found = [("text", _text(node[1][1]))]
        elif node[0] == "for":
            found = [(*node[:3], simplified(node[3]))]
        elif node[0] == "generation":
            found = [("generation", simplified(node[1]))]
        elif node[0] == "if":
            arms = []
            for test, inner in node[1]:
                if test[0] != "const" or test[1]:
                    arms.append((test, simplified(inner)))
                if test[0] == "const" and test[1]:
                    break
            found = arms[0][1] if arms and arms[0][0][0] == "const" else [("if", arms)] if arms else []
        for x in found:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            else:
                out.append(x)
    return out


def _closure(body: list[tuple]) -> Callable[[dict, Output], None]:
    steps = [_step(x) for x in body]

    def run(ctx: dict, out: Output) -> None:
        for s in steps:
            s(ctx, out)

    return run


def _step(node: tuple) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda ctx, out: out.write(text)
    if kind == "put":
        value = compiled_expression(node[1])
        return lambda ctx, out: out.write(_text(value(ctx)))
    if kind == "set":
        name, value = node[1], compiled_expression(node[2])
        return lambda ctx, out: ctx.__setitem__(name, value(ctx))
    if kind == "generation":
        inner = _closure(node[1])

        def generation(ctx: dict, out: Output) -> None:
            start = out.length
            inner(ctx, out)
            out.spans.append((start, out.length))

        return generation
    if kind == "for":
        name, items, inner = node[1], compiled_expression(node[2]), _closure(node[3])

        def loop(ctx: dict, out: Output) -> None:
            rows = list(items(ctx) or [])
            own = dict(ctx)
            for i, row in enumerate(rows):
                own[name], own["loop"] = row, {"index0": i, "first": i == 0, "last": i == len(rows) - 1}
                inner(own, out)

        return loop
    arms = [(compiled_expression(test), _closure(inner)) for test, inner in node[1]]

    def choose(ctx: dict, out: Output) -> None:
        for test, inner in arms:
            if test(ctx):
                inner(ctx, out)
                return

    return choose


def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a context to (text, spans in code points that the loss covers)."""
    run = _closure(simplified(parse(template)))

    def render(context: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(context), out)
        return "".join(out.parts), out.spans

    return render


# ------------------------------------------------------------------ operators


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a text that :data:`TURNS` wrote."""
    return [(unescape(r), unescape(t)) for r, t in re.findall(r"<turn ([^<>]*)>\n([^<>]*)</turn>\n", formatted)]


def format_conversations(turns: DataFrame, template: str = TURNS) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of each conversation of ``turns`` (conv_id, turn, role, text).

    Turns go by ``turn``, then role and text (a repeated turn number keeps all its rows); null
    turns come first, null roles and texts are empty; rows with a null conv_id are one
    conversation.  Conversations stream through sorted partitions, so a task holds one at a time;
    its formatted text is one value and must fit one row.
    """
    compile_template(template)  # errors show on the driver

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, current, messages, begun = compile_template(template), None, [], False
        for batch in batches:
            ids, texts, spans = [], [], []

            def close() -> None:
                text, covered = draw({"messages": messages})
                ids.append(current)
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in covered])

            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if begun and conv != current:
                    close()
                    messages = []
                current, begun = conv, True
                messages.append({"role": role or "", "text": text or ""})
            yield _formatted(ids, texts, spans)
        if begun:
            text, covered = draw({"messages": messages})
            yield _formatted([current], [text], [[{"start": a, "end": b} for a, b in covered]])

    dealt = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(render, "conv_id long, formatted string, loss_spans array<struct<start: long, end: long>>")


def _formatted(ids: list, texts: list, spans: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "loss_spans"])
