"""A small sandboxed template language, compiled to Python closures.

    text  {{ expression }}  {% for x in e %} .. {% endfor %}  {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set x = e %}  {% generation %} .. {% endgeneration %}

Expressions: string and integer literals, true, false, none, names, ``a.b`` and ``a['b']`` (keys of mappings only), ``==``, ``!=``, ``+``,
``not``, ``and``, ``or``, parentheses and ``| filter`` with the filters handed to the compiler.  Inside a loop ``loop.index0``,
``loop.first`` and ``loop.last`` hold.  There are no calls, no attributes of Python objects and no imports, so a template can reach
nothing but the values that it is given.

Parsing gives a syntax tree; folding evaluates what is constant, drops dead branches and joins neighbouring texts; each remaining node
becomes a closure that yields (piece, is generated) pairs, so a loop over a stream of messages needs the memory of one message.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEXEMES = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+.|()\[\]=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    """The template is not in the language."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Unary:
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class For:
    name: str
    of: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    of: object


@dataclass(frozen=True)
class Generation:
    body: tuple


class _Expression:
    """Recursive descent over one expression's lexemes."""

    def __init__(self, source: str):
        self.lexemes, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _LEXEMES.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.lexemes.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.lexemes[self.at] if self.at < len(self.lexemes) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        if self.peek()[1] in wanted and self.peek()[0] in ("op", "name"):
            self.at += 1
            return self.lexemes[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name expected, found {value!r}")
        self.at += 1
        return value

    def whole(self):
        out = self.disjunction()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def disjunction(self):
        out = self.conjunction()
        while self.take("or"):
            out = Binary("or", out, self.conjunction())
        return out

    def conjunction(self):
        out = self.negation()
        while self.take("and"):
            out = Binary("and", out, self.negation())
        return out

    def negation(self):
        return Unary(self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        out = self.sum()
        if op := self.take("==", "!="):
            out = Binary(op, out, self.sum())
        return out

    def sum(self):
        out = self.filtered()
        while self.take("+"):
            out = Binary("+", out, self.filtered())
        return out

    def filtered(self):
        out = self.primary()
        while True:
            if self.take("."):
                out = Item(out, Const(self.name()))
            elif self.take("["):
                out = Item(out, self.disjunction())
                self.need("]")
            elif self.take("|"):
                out = Filter(out, self.name())
            else:
                return out

    def primary(self):
        kind, value = self.peek()
        if self.take("("):
            out = self.disjunction()
            self.need(")")
            return out
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name" and value in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[value])
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of nodes."""
    pieces, at = [], 0
    for m in _PARTS.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        pieces.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    place = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        nodes = []
        while place < len(pieces):
            kind, value = pieces[place]
            place += 1
            if kind == "text":
                nodes.append(Text(value))
            elif kind == "out":
                nodes.append(Output(_Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(nodes), value
                nodes.append(tag(word, rest))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(nodes), ""

    def branch(test: str) -> If:
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            other: tuple = (branch(end[4:]),)
        else:
            other = block("endif")[0] if end == "else" else ()
        return If(_Expression(test).whole(), then, other)

    def tag(word: str, rest: str):
        if word == "if":
            return branch(rest)
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            return For(name, e.whole(), block("endfor")[0])
        if word == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            return Set(name, e.whole())
        if word == "generation":
            return Generation(block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


def _text(value: object) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


def _binary(op: str, a: object, b: object) -> object:
    if op == "==":
        return a == b
    if op == "!=":
        return a != b
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


def fold(node, filters: dict[str, Callable[[str], str]]):
    """The node with everything constant worked out; lists of nodes come back shorter where they can."""
    if isinstance(node, tuple):
        out: list = []
        for n in (fold(x, filters) for x in node):
            for x in n if isinstance(n, tuple) else (n,):
                if isinstance(x, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + x.text)
                elif x != Text(""):
                    out.append(x)
        return tuple(out)
    if isinstance(node, Output):
        of = fold(node.of, filters)
        return Text(_text(of.value)) if isinstance(of, Const) else Output(of)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Unary):
        of = fold(node.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Unary(of)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of = fold(node.of, filters)
        return Const(filters[node.name](_text(of.value))) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Binary):
        a, b = fold(node.left, filters), fold(node.right, filters)
        if node.op in ("and", "or") and isinstance(a, Const):
            return b if bool(a.value) == (node.op == "and") else a
        if isinstance(a, Const) and isinstance(b, Const) and node.op not in ("and", "or"):
            return Const(_binary(node.op, a.value, b.value))
        return Binary(node.op, a, b)
    if isinstance(node, If):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return If(test, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.of, filters), fold(node.body, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.of, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


Env = dict
Pieces = Iterator[tuple[str, bool]]


def _value(node, filters) -> Callable[[Env], object]:
    """A closure that works out an expression."""
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(env):
            v = of(env)
            return v.get(key(env)) if isinstance(v, dict) else None

        return item
    if isinstance(node, Unary):
        of = _value(node.of, filters)
        return lambda env: not of(env)
    if isinstance(node, Filter):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda env: f(_text(of(env)))
    left, right = _value(node.left, filters), _value(node.right, filters)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    return lambda env, op=node.op: _binary(op, left(env), right(env))


def _looped(of: Iterable) -> Iterator[tuple[object, dict]]:
    """Items with their loop variables; it looks one item ahead."""
    source = iter(of)
    try:
        here = next(source)
    except StopIteration:
        return
    i = 0
    for ahead in source:
        yield here, {"index0": i, "first": i == 0, "last": False}
        here, i = ahead, i + 1
    yield here, {"index0": i, "first": i == 0, "last": True}


def _closure(nodes: tuple, filters, generated: bool) -> Callable[[Env], Pieces]:
    steps = [_step(n, filters, generated) for n in nodes]

    def run(env: Env) -> Pieces:
        for s in steps:
            yield from s(env)

    return run


def _step(node, filters, generated: bool) -> Callable[[Env], Pieces]:
    if isinstance(node, Text):
        piece = ((node.text, generated),)
        return lambda env: piece
    if isinstance(node, Output):
        of = _value(node.of, filters)
        return lambda env: ((_text(of(env)), generated),)
    if isinstance(node, Generation):
        return _closure(node.body, filters, True)
    if isinstance(node, If):
        test, then, other = _value(node.test, filters), _closure(node.then, filters, generated), _closure(node.other, filters, generated)
        return lambda env: then(env) if test(env) else other(env)
    if isinstance(node, Set):
        of = _value(node.of, filters)

        def bind(env: Env) -> Pieces:
            env[node.name] = of(env)
            return iter(())

        return bind
    of, body = _value(node.of, filters), _closure(node.body, filters, generated)

    def loop(env: Env) -> Pieces:
        for item, state in _looped(of(env) or ()):
            inner = {**env, node.name: item, "loop": state}
            yield from body(inner)

    return loop


def compiled(source: str, filters: dict[str, Callable[[str], str]]) -> Callable[[Env], Pieces]:
    """A function from the template's variables to its output as (piece, is generated) pairs."""
    return _closure(fold(parse(source), filters), filters, False)
