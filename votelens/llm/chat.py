"""Chat formatting: a small sandboxed template language, compiled to Python closures.

Grammar: text, `{{ expression }}`, `{% for name in messages %}..{% endfor %}`, `{% if e %}..{% elif e %}..{% else %}..{% endif %}`
and `{% generation %}..{% endgeneration %}`, whose output is what a model is trained on.  Expressions have strings,
integers, names, `.field` of messages and of `loop` (index0, first), `+`, `==`, `!=`, `and`, `or`, `not`, `~` and the
filters below.  There are no calls, no other attributes and no other names, so a template can't reach Python.

Closures are generators, so conversations of any length stream through them turn by turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CHAT_TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|im_start|>' + (message.role | escape_line) + '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}"
    "{% else %}{{ message.content | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\\n' }}"
    "{% endfor %}"
)
ASSISTANT = "assistant"

# ---------------------------------------------------------------- escaping


def escape(text: str) -> str:
    """No control string is left: each backslash is doubled, and `<|` becomes `<\\|`."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    """As escape, on one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower,
}

# ---------------------------------------------------------------- syntax tree


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str
    field: str | None = None


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


TOKENS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|(\w+)|(==|!=|[|+~().]))""")
FIELDS = {"role", "content", "index0", "first"}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str, names: set[str]):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append(m.groups())
            at = m.end()
        self.at, self.names = 0, names

    def peek(self) -> str | None:
        return next((x for x in self.tokens[self.at][1:] if x), None) if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if (found := self.peek()) in wanted:
            self.at += 1
            return found
        return None

    def whole(self) -> Any:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at]}")
        return node

    def chain(self, below: Callable[[], Any], *ops: str) -> Any:
        node = below()
        while op := self.take(*ops):
            node = Op(op, (node, below()))
        return node

    def either(self) -> Any:
        return self.chain(self.both, "or")

    def both(self) -> Any:
        return self.chain(self.negated, "and")

    def negated(self) -> Any:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        return self.chain(self.summed, "==", "!=")

    def summed(self) -> Any:
        return self.chain(self.filtered, "+", "~")

    def filtered(self) -> Any:
        node = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            self.at += 1
            node = Op("|" + name, (node,))
        return node

    def atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        string, number, name, sign = self.tokens[self.at]
        self.at += 1
        if string:
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), string[1:-1]))
        if number:
            return Const(int(number))
        if sign == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return node
        if name not in self.names:
            raise TemplateError(f"no name {name or sign}")
        if not self.take("."):
            return Name(name)
        if (attribute := self.peek()) not in FIELDS:
            raise TemplateError(f"no field {attribute}")
        self.at += 1
        return Name(name, attribute)


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.DOTALL)
    at = 0

    def body(names: set[str], *ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(Out(_Expression(part[2:-2], names).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return tuple(nodes), f"{word} {rest}".strip()
                if word == "for":
                    if not (m := re.fullmatch(r"(\w+) in messages", rest.strip())):
                        raise TemplateError(f"can't loop over {rest!r}")
                    inner, _ = body(names | {m[1], "loop"}, "endfor")
                    nodes.append(For(m[1], inner))
                elif word == "generation":
                    inner, _ = body(names, "endgeneration")
                    nodes.append(Generation(inner))
                elif word == "if":
                    arms, condition = [], _Expression(rest, names).whole()
                    while True:
                        inner, end = body(names, "elif", "else", "endif")
                        arms.append((condition, inner))
                        if end == "endif":
                            break
                        condition = Const(True) if end == "else" else _Expression(end[5:], names).whole()
                    nodes.append(If(tuple(arms)))
                else:
                    raise TemplateError(f"no statement {word}")
            elif part:
                nodes.append(Out(Const(part)))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(nodes), ""

    return body(set())[0]


def fold(node: Any) -> Any:
    """The tree with constant expressions computed, dead branches cut and neighbouring texts merged."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            if isinstance(x, If) and len(x.arms) == 1 and x.arms[0][0] == Const(True):
                out += x.arms[0][1]
            elif isinstance(x, If) and not x.arms:
                continue
            elif isinstance(x, Out) and isinstance(x.value, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                out[-1] = Out(Const(str(out[-1].value.value) + str(x.value.value)))
            else:
                out.append(x)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a) for a in node.args)
        folded = Op(node.op, args)
        return Const(_closure(folded)({})) if all(isinstance(a, Const) for a in args) else folded
    if isinstance(node, Out):
        return Out(fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, inner in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const):
                if not condition.value:
                    continue
                arms.append((Const(True), fold(inner)))
                break
            arms.append((condition, fold(inner)))
        return If(tuple(arms))
    return node


# ---------------------------------------------------------------- closures

Piece = tuple[str, bool]  # text, under the loss mask


def _closure(node: Any) -> Callable[[dict], Any]:
    """An expression as a function of the names' values."""
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        if node.field is None:
            return lambda scope, name=node.name: scope[name]
        return lambda scope, name=node.name, attribute=node.field: scope[name].get(attribute, "")
    run = [_closure(a) for a in node.args]
    if node.op.startswith("|"):
        return lambda scope, f=FILTERS[node.op[1:]], a=run[0]: f(str(a(scope)))
    if node.op == "not":
        return lambda scope, a=run[0]: not a(scope)
    a, b = run
    return {
        "or": lambda scope: a(scope) or b(scope),
        "and": lambda scope: a(scope) and b(scope),
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "+": lambda scope: a(scope) + b(scope),
        "~": lambda scope: str(a(scope)) + str(b(scope)),
    }[node.op]


def _renderer(nodes: tuple, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    """Statements as a generator of pieces."""
    steps: list[Callable[[dict], Iterator[Piece]]] = []
    for node in nodes:
        if isinstance(node, Out):
            value = _closure(node.value)

            def step(scope, value=value):
                yield str(value(scope)), masked
        elif isinstance(node, Generation):
            step = _renderer(node.body, True)
        elif isinstance(node, For):
            inner = _renderer(node.body, masked)

            def step(scope, name=node.name, inner=inner):
                for i, item in enumerate(scope["messages"]):
                    yield from inner({**scope, name: item, "loop": {"index0": i, "first": i == 0}})
        else:
            arms = [(_closure(c), _renderer(body, masked)) for c, body in node.arms]

            def step(scope, arms=arms):
                for condition, body in arms:
                    if condition(scope):
                        yield from body(scope)
                        return
        steps.append(step)

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


@dataclass
class Template:
    """A compiled template: render(messages) gives pieces of text, each with its loss mask."""

    source: str = CHAT_TEMPLATE
    tree: tuple = field(init=False)

    def __post_init__(self) -> None:
        self.tree = fold(parse(self.source))
        self._run = _renderer(self.tree, False)

    def render(self, messages: Iterator[dict]) -> Iterator[Piece]:
        return self._run({"messages": messages})


# ---------------------------------------------------------------- Spark

CHUNK = "conv_id long, chunk int, formatted string, spans array<struct<start:long,stop:long>>"
CHUNK_CHARS = 1 << 20


def _by_conversation(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[Any, Iterator[tuple]]]:
    """Sorted rows as (conv_id, its rows), one row in memory at a time."""
    from itertools import chain, groupby

    rows = chain.from_iterable(zip(*(f[c] for c in columns), strict=True) for f in frames)
    for key, group in groupby(rows, key=lambda r: None if pd.isna(r[0]) else int(r[0])):
        yield key, group


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: str = CHAT_TEMPLATE, chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Formatted conversations in chunks: conv_id, chunk (from 0), formatted, spans (loss mask inside the chunk).

    Rows of a conversation are rendered by turn (null turns first; ties by role, then text).  A null text or role is
    empty; a null conv_id is one conversation.  A conversation streams through its task turn by turn, and leaves in
    chunks that end at a piece of the template, so that none is held whole; usually it is one chunk.
    """
    ordered = (
        rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    )

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = Template(template)
        out: list[tuple] = []
        size = 0
        for key, group in _by_conversation(frames, ["conv_id", "turn", "role", "text"]):
            messages = ({"role": r or "", "content": t or ""} for _, _, r, t in group)
            pieces: list[str] = []
            spans: list[tuple[int, int]] = []
            at = chunk = 0
            for piece, masked in compiled.render(messages):
                if masked:
                    spans.append((at, at + len(piece)))
                pieces.append(piece)
                at += len(piece)
                if at >= chunk_chars:
                    out.append((key, chunk, "".join(pieces), spans))
                    pieces, spans, size, at, chunk = [], [], size + at, 0, chunk + 1
                    if size >= chunk_chars:
                        yield _frame(out)
                        out, size = [], 0
            if pieces or not chunk:
                out.append((key, chunk, "".join(pieces), spans))
                size += at
            if size >= chunk_chars:
                yield _frame(out)
                out, size = [], 0
        if out:
            yield _frame(out)

    return ordered.mapInPandas(work, CHUNK)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "chunk", "formatted", "spans"]).astype({"conv_id": "Int64"})
    out["spans"] = [[{"start": a, "stop": b} for a, b in x] for x in out["spans"]]
    return out


class _Reader:
    """Reads a formatted conversation back, chunk by chunk."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest: list[str] = []

    def add(self, formatted: str, spans: list[dict]) -> None:
        self.chars += len(formatted)
        for s in spans:
            plain = unescape(formatted[s["start"] : s["stop"]])
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.rest.append(formatted)
        if END not in formatted and not formatted.startswith("\n"):
            return  # the turn goes on
        whole = "".join(self.rest)
        at = 0
        while (stop := whole.find(END + "\n", at)) >= 0:
            role, _, content = whole[at + len(START) : stop].partition("\n")
            self.turns.update(f"{unescape(role)}\n{unescape(content)}\n".encode())
            self.n_turns += 1
            at = stop + len(END) + 1
        self.rest = [whole[at:]]


def read_back(formatted: DataFrame, in_place: bool = True) -> DataFrame:
    """What chunks in their order say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The rows of `format_conversations`, as they come, are already together and in order; no shuffle follows.  Chunks of a
    stored table may lie anywhere: with `in_place` false they are brought together first, and without it, missing or
    disordered chunks are an error.
    """
    if not in_place:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for key, group in _by_conversation(frames, ["conv_id", "chunk", "formatted", "spans"]):
            reader = _Reader()
            for expected, (_, chunk, text, spans) in enumerate(group):
                if chunk != expected:
                    raise ValueError(f"conversation {key}: chunk {chunk} comes where {expected} should; read with in_place=False")
                reader.add(text, list(spans))
            out.append({
                "conv_id": key, "n_turns": reader.n_turns, "turns_sha256": reader.turns.hexdigest(), "loss_chars": reader.loss_chars,
                "loss_sha256": reader.loss.hexdigest(), "formatted_chars": reader.chars,
            })
            if len(out) == 1000:
                yield pd.DataFrame(out).astype({"conv_id": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out).astype({"conv_id": "Int64"})

    return formatted.mapInPandas(
        work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
