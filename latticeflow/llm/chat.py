"""Chat formatting by a small template language compiled to Python closures.

Templates know output (``{{ expr }}``), ``{% for x in xs %}``, ``{% if %}`` / ``{% elif %}`` /
``{% else %}``, ``{% set %}`` and ``{% generation %}`` (the text between it and its end is what a
model is trained on).  Expressions have literals, names, attributes (mapping keys only),
``+``, comparisons, ``and`` / ``or`` / ``not``, ``in``, conditionals and registered filters.
There are no calls, imports or Python attributes: a template can touch only its own data.

``compile_template`` parses to a syntax tree, folds constants (joining neighbouring texts)
and generates closures.  They yield pieces ``(text, is generation)`` lazily, and ``for`` runs
over any iterator, so a conversation of any length renders turn by turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """A template that the language does not allow."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Output:
    expr: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)


@dataclass(frozen=True)
class Set:
    name: str
    expr: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+<>|.()]))""")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", '"': '"', "'": "'"}
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}


class _Expressions:
    """Recursive descent over one expression."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            kind = next(i for i in range(1, 5) if m[i] is not None)
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != 1 else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self):
        out = self.conditional()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return out

    def conditional(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.conditional() if self.take("else") else Const("")
            return Op("choose", (test, value, other))
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.summed()
        while sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            left = Op(sign, (left, self.summed()))
        return left

    def summed(self):
        left = self.filtered()
        while sign := self.take("+", "-"):
            left = Op(sign, (left, self.filtered()))
        return left

    def filtered(self):
        value = self.atom()
        while True:
            if self.take("|"):
                value = Op("filter", (Const(self.name()), value))
            elif self.take("."):
                key = self.name()
                if key.startswith("_"):
                    raise TemplateError(f"no access to {key!r}")
                value = Item(value, key)
            else:
                return value

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != 3:
            raise TemplateError(f"a name is missing in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError(f"{self.text!r} ends too soon")
        kind, token = self.tokens[self.at]
        if self.take("("):
            value = self.conditional()
            if not self.take(")"):
                raise TemplateError(f"an open bracket in {self.text!r}")
            return value
        self.at += 1
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), token[1:-1], flags=re.S))
        if kind == 2:
            return Const(int(token))
        if kind == 3:
            if token in ("true", "false", "none"):
                return Const({"true": True, "false": False, "none": None}[token])
            if token in _WORDS or token.startswith("_"):
                raise TemplateError(f"unexpected {token!r}")
            return Name(token)
        raise TemplateError(f"unexpected {token!r} in {self.text!r}")


_PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)


def parse(template: str) -> tuple:
    """The template's syntax tree."""
    parts = [p for p in _PART.split(template) if p]
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        nodes: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(Output(_Expressions(part[2:-2]).whole()))
                continue
            if not part.startswith("{%"):
                nodes.append(Output(Const(part)))
                continue
            word, _, rest = part[2:-2].strip().partition(" ")
            if word in ends:
                return tuple(nodes), f"{word} {rest}".strip()
            if word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {part!r}")
                nodes.append(For(m[1], _Expressions(m[2]).whole(), block("endfor")[0]))
            elif word == "generation":
                nodes.append(Generation(block("endgeneration")[0]))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z]\w*)\s*=\s*(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {part!r}")
                nodes.append(Set(m[1], _Expressions(m[2]).whole()))
            elif word == "if":
                arms, test = [], _Expressions(rest).whole()
                while True:
                    body, end = block("elif", "else", "endif")
                    arms.append((test, body))
                    if end == "endif":
                        break
                    test = Const(True) if end == "else" else _Expressions(end[5:]).whole()
                nodes.append(If(tuple(arms)))
            else:
                raise TemplateError(f"unknown statement {part!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""

    return block()[0]


def _text(value: object) -> str:
    return "" if value is None else str(value)


_APPLY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "-": lambda a, b: a - b,
    "+": lambda a, b: a + b if type(a) is type(b) else _text(a) + _text(b), "not": lambda a: not a,
}


def _checked(name: str, apply: Callable) -> Callable:
    """``apply``, whose operands may not suit it."""

    def run(*values):
        try:
            return apply(*values)
        except TypeError:
            raise TemplateError(f"{name!r} of {' and '.join(type(v).__name__ for v in values)}") from None

    return run


_APPLY = {name: _checked(name, apply) for name, apply in _APPLY.items()}


def _folded(node, filters: dict[str, Callable]):
    """Constant folding of an expression; filters are pure."""
    if isinstance(node, Item):
        return Item(_folded(node.of, filters), node.key)
    if not isinstance(node, Op):
        return node
    args = tuple(_folded(a, filters) for a in node.args)
    if node.name == "filter" and args[0].value not in filters:
        raise TemplateError(f"unknown filter {args[0].value!r}")
    if isinstance(args[0], Const) and node.name in ("choose", "and", "or"):
        if node.name == "choose":
            return args[1] if args[0].value else args[2]
        return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
    if all(isinstance(a, Const) for a in args) and node.name != "choose":
        values = [a.value for a in args]
        return Const(filters[values[0]](values[1]) if node.name == "filter" else _APPLY[node.name](*values))
    return Op(node.name, args)


def fold(nodes: tuple, filters: dict[str, Callable]) -> tuple:
    """The tree with constants folded, dead arms gone and neighbouring texts joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Output):
            node = Output(_folded(node.expr, filters))
            if isinstance(node.expr, Const):
                value = _text(node.expr.value)
                if not value:
                    continue
                if out and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const):
                    value = out.pop().expr.value + value
                node = Output(Const(value))
        elif isinstance(node, For):
            node = For(node.name, _folded(node.over, filters), fold(node.body, filters))
        elif isinstance(node, Set):
            node = Set(node.name, _folded(node.expr, filters))
        elif isinstance(node, Generation):
            node = Generation(fold(node.body, filters))
        elif isinstance(node, If):
            arms = []
            for test, body in node.arms:
                test = _folded(test, filters)
                if isinstance(test, Const) and not test.value:
                    continue
                arms.append((test, fold(body, filters)))
                if isinstance(test, Const):
                    break
            if not arms:
                continue
            if isinstance(arms[0][0], Const):
                out.extend(arms[0][1])
                continue
            node = If(tuple(arms))
        out.append(node)
    return tuple(out)


def _evaluator(node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env):
            try:
                return env[name]
            except KeyError:
                raise TemplateError(f"{name!r} is not defined") from None

        return look
    if isinstance(node, Item):
        of, key = _evaluator(node.of, filters), node.key

        def item(env):
            value = of(env)
            if not isinstance(value, dict):
                raise TemplateError(f"{key!r} of something that has no items")
            return value.get(key)

        return item
    args = [_evaluator(a, filters) for a in node.args]
    if node.name == "choose":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    if node.name == "filter":
        apply, of = filters[node.args[0].value], args[1]
        return lambda env: apply(of(env))
    apply = _APPLY[node.name]
    return (lambda env: apply(args[0](env))) if len(args) == 1 else (lambda env: apply(args[0](env), args[1](env)))


def _renderer(nodes: tuple, filters: dict[str, Callable], inside: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    def step(node):
        if isinstance(node, Output):
            if isinstance(node.expr, Const):
                piece = ((node.expr.value, inside),)
                return lambda env: piece
            value = _evaluator(node.expr, filters)
            return lambda env: ((_text(value(env)), inside),)
        if isinstance(node, Set):
            name, value = node.name, _evaluator(node.expr, filters)

            def assign(env):
                env[name] = value(env)
                return ()

            return assign
        if isinstance(node, Generation):
            return _renderer(node.body, filters, True)
        if isinstance(node, If):
            arms = [(_evaluator(t, filters), _renderer(b, filters, inside)) for t, b in node.arms]

            def choose(env):
                for test, body in arms:
                    if test(env):
                        return body(env)
                return ()

            return choose
        name, over, body = node.name, _evaluator(node.over, filters), _renderer(node.body, filters, inside)

        def loop(env):
            for env[name] in over(env):
                yield from body(env)

        return loop

    steps = [step(n) for n in nodes]

    def render(env):
        for s in steps:
            yield from s(env)

    return render


def compile_template(template: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[..., Iterator[tuple[str, bool]]]:
    """``render(**data)`` of a template: yields its pieces ``(text, is generation)``."""
    filters = dict(filters or {})
    render = _renderer(fold(parse(template), filters), filters, False)
    return lambda **data: render(dict(data))


#: Turn marks of the standard template; ``escape`` makes them impossible inside a role or text.
OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
TEMPLATE = (
    "{% for turn in turns %}### {{ turn.role | escape }}: "
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}</turn>\n{% endfor %}"
)


def escape(text: str) -> str:
    """Reversible: no output holds a turn mark (nor a bare colon, so a role ends at the first one)."""
    return text.replace("\\", "\\\\").replace("#", "\\h").replace("<", "\\l").replace(":", "\\c")


_BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":"}
_ESCAPED = re.compile(r"\\([\\hlc])")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


class Reader:
    """Reads turns and the loss text back from formatted pieces, however they are cut."""

    def __init__(self):
        self.held, self.turns = "", hashlib.sha256()
        self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), 0, 0, 0
        self.mask = ""  # generated text whose last escape may be incomplete

    def feed(self, text: str, generated: bool) -> None:
        self.chars += len(text)
        self.held += text
        if generated:
            self._loss(text)
        while (end := self.held.find(CLOSE)) >= 0:
            turn, self.held = self.held[:end], self.held[end + len(CLOSE) :]
            if not turn.startswith(OPEN) or MID not in turn:
                raise ValueError(f"not a turn: {turn[:40]!r}")
            role, _, body = turn[len(OPEN) :].partition(MID)
            self.n += 1
            self.turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))

    def _loss(self, text: str) -> None:
        text = self.mask + text
        cut = len(text) - (len(text) - len(text.rstrip("\\"))) % 2
        self.mask, plain = text[cut:], unescape(text[:cut])
        self.loss_chars += len(plain)
        self.loss.update(plain.encode("utf-8", "surrogatepass"))

    def close(self) -> tuple[int, str, int, str, int]:
        if self.held or self.mask:
            raise ValueError("the text ends within a turn")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            yield conv, {"role": role or "", "text": text or ""}


def _grouped(batches, template: str, finish: Callable):
    """Each run of equal conv_ids, rendered lazily: ``finish(conv_id, pieces)``."""
    render = compile_template(template, {"escape": escape})
    rows = _conversations(batches)
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def turns(conv=conv):
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield ahead[1]
                ahead = next(rows, None)

        yield finish(conv, render(turns=turns()))


def _sorted(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``(conv_id, formatted, spans)``: each conversation's text and its generated spans ``(start, end)``.

    Rows are ordered by turn (nulls first; ties by role and text), null roles and texts are
    empty, and rows with a null conv_id form one conversation.  Other columns are not read;
    no rows give no conversations.
    """

    def run(batches):
        def finish(conv, pieces):
            texts, spans, at = [], [], 0
            for text, generated in pieces:
                if generated and text:
                    if spans and spans[-1]["end"] == at:
                        spans[-1]["end"] = at + len(text)
                    else:
                        spans.append({"start": at, "end": at + len(text)})
                texts.append(text)
                at += len(text)
            return conv, "".join(texts), spans

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for conv, text, spans in _grouped(batches, template, finish):
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([text], pa.string()), pa.array([spans], kind)], names=["conv_id", "formatted", "spans"])

    return _sorted(conversations).mapInArrow(run, "conv_id long, formatted string, spans array<struct<start: long, end: long>>")


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What a reader gets back from each formatted conversation, with memory for one turn at a time.

    Rows as in :func:`formatted`; ``turns_sha256`` covers role and text of every turn,
    ``loss_sha256`` and ``loss_chars`` all generated text, unescaped.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        def finish(conv, pieces):
            reader = Reader()
            for text, generated in pieces:
                reader.feed(text, generated)
            return conv, *reader.close()

        rows = []
        for row in _grouped(batches, template, finish):
            rows.append(row)
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    return _sorted(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
