"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% for x in expression %}..{% endfor %}   {% set name = expression %}
    {% if e %}..{% elif e %}..{% else %}..{% endif %}   {% generation %}..{% endgeneration %}   {# comment #}

Expressions have string and integer literals, true, false, none, names, a.b on mappings, == != < <= > >=, in,
and, or, not, + - %, ~ (join as text) and filters from a fixed table. There are no calls and no attribute access on
Python objects, so a template reaches nothing but the values that it is given. A closure yields
(text, generated) pieces; what stands in a generation block is marked as generated. Loops take any iterable and
look one item ahead, so the messages of a conversation may be a stream."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_TAG = re.compile(r"\{#.*?#\}|\{\{-?(?P<e>.*?)-?\}\}|\{%-?(?P<s>.*?)-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+\-%~.|()]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}
_CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def guard(value) -> str:
    """value with control strings broken up, reversibly: a backslash is doubled, ``<|`` becomes ``<\\|``."""
    return _text(value).replace("\\", "\\\\").replace("<|", "<\\|")


def guard_line(value) -> str:
    """As guard, for a value that must stay on its line."""
    return guard(value).replace("\n", "\\n")


def unguard(text: str) -> str:
    """What guard or guard_line was given."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable] = {"guard": guard, "guard_line": guard_line, "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(v)}

# Syntax tree: tuples whose first item names the kind.


def _lex(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over one expression."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("%",))

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise TemplateError(f"expected {kind or 'more'} after token {self.at}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def level(self, n: int) -> tuple:
        if n == len(self.LEVELS):
            return self.filtered()
        if self.LEVELS[n] == ("not",):
            if self.peek() == "not":
                self.take()
                return ("not", self.level(n))
            return self.level(n + 1)
        node = self.level(n + 1)
        while self.peek() in self.LEVELS[n]:
            node = ("op", self.take(), node, self.level(n + 1))
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.peek() in (".", "|"):
            if self.take() == ".":
                node = ("get", node, self.take("name"))
            elif (name := self.take("name")) in FILTERS:
                node = ("filter", name, node)
            else:
                raise TemplateError(f"no filter {name!r}")
        return node

    def atom(self) -> tuple:
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else None
        value = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return ("const", _CONSTANTS[value]) if value in _CONSTANTS else ("name", value)
        if value == "(":
            node = self.level(0)
            if self.take() != ")":
                raise TemplateError("expected )")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        if m["e"] is not None:
            pieces.append(("show", m["e"]))
        elif m["s"] is not None:
            pieces.append(("do", m["s"].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pieces.reverse()

    def block(*ends: str) -> tuple[list, str]:
        body = []
        while pieces:
            kind, value = pieces.pop()
            if kind == "text":
                body.append(("text", ("const", value)))
            elif kind == "show":
                body.append(("text", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return body, value
                body.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for":
            name, _, over = rest.strip().partition(" in ")
            if not name.isidentifier():
                raise TemplateError(f"cannot loop over {rest!r}")
            return ("for", name, _Expression(over).whole(), block("endfor")[0])
        if word == "if":
            body, end = block("elif", "else", "endif")
            other: list = []
            if end.startswith("elif"):
                other = [statement("if", end[4:])]
            elif end == "else":
                other, _ = block("endif")
            return ("if", _Expression(rest).whole(), body, other)
        if word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError(f"cannot set {name!r}")
            return ("set", name.strip(), _Expression(value).whole())
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    return ("block", block()[0])


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "%": lambda a, b: a % b, "~": lambda a, b: _text(a) + _text(b),
}


def fold(node):
    """The tree with constant expressions evaluated, constant branches chosen and neighbouring texts joined."""
    if isinstance(node, list):
        out = []
        for x in map(fold, node):
            inner = x[1] if x[0] == "block" else [x]
            for y in inner:
                if y[0] == "text" and y[1][0] == "const":
                    y = ("text", ("const", _text(y[1][1])))
                    if not y[1][1]:
                        continue
                    if out and out[-1][0] == "text" and out[-1][1][0] == "const":
                        y = ("text", ("const", out.pop()[1][1] + y[1][1]))
                out.append(y)
        return out
    if not isinstance(node, tuple):
        return node
    kind = node[0]
    if kind in ("const", "name"):
        return node
    node = tuple(fold(x) if isinstance(x, (tuple, list)) else x for x in node)
    constant = lambda x: x[0] == "const"
    if kind == "op":
        _, name, a, b = node
        if name in ("and", "or") and constant(a):
            return (b if a[1] else a) if name == "and" else (a if a[1] else b)
        if name in _OPS and constant(a) and constant(b):
            return ("const", _OPS[name](a[1], b[1]))
    elif kind == "not" and constant(node[1]):
        return ("const", not node[1][1])
    elif kind == "filter" and constant(node[2]):
        return ("const", FILTERS[node[1]](node[2][1]))
    elif kind == "if" and constant(node[1]):
        return ("block", node[2] if node[1][1] else node[3])
    return node


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        constant = node[1]
        return lambda names: constant
    if kind == "name":
        name = node[1]
        return lambda names: names.get(name)
    if kind == "get":
        of, key = _value(node[1]), node[2]

        def get(names):
            value = of(names)
            return value.get(key) if isinstance(value, dict) else None

        return get
    if kind == "not":
        inner = _value(node[1])
        return lambda names: not inner(names)
    if kind == "filter":
        apply, inner = FILTERS[node[1]], _value(node[2])
        return lambda names: apply(inner(names))
    _, name, a, b = node
    a, b = _value(a), _value(b)
    if name == "and":
        return lambda names: a(names) and b(names)
    if name == "or":
        return lambda names: a(names) or b(names)
    apply = _OPS[name]
    return lambda names: apply(a(names), b(names))


Piece = tuple[str, bool]


def _run(node, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, list):
        parts = [_run(x, generated) for x in node]

        def run_all(names):
            for part in parts:
                yield from part(names)

        return run_all
    kind = node[0]
    if kind == "block":
        return _run(node[1], generated)
    if kind == "generation":
        return _run(node[1], True)
    if kind == "text":
        value = _value(node[1])

        def show(names):
            if text := _text(value(names)):
                yield text, generated

        return show
    if kind == "set":
        name, value = node[1], _value(node[2])

        def assign(names):
            names[name] = value(names)
            return iter(())

        return assign
    if kind == "if":
        test, yes, no = _value(node[1]), _run(node[2], generated), _run(node[3], generated)
        return lambda names: yes(names) if test(names) else no(names)
    _, name, over, body = node
    over, body = _value(over), _run(body, generated)

    def loop(names):
        items, inner = iter(over(names) or ()), dict(names)
        index, item = 0, next(items, items)
        while item is not items:
            after = next(items, items)
            inner[name], inner["loop"] = item, {"index": index + 1, "index0": index, "first": index == 0, "last": after is items}
            yield from body(inner)
            index, item = index + 1, after

    return loop


def compiled(source: str) -> Callable[..., Iterator[Piece]]:
    """A function of the template's names that yields (text, generated) pieces."""
    run = _run(fold(parse(source)), False)
    return lambda **names: run(dict(names))
