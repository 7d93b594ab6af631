"""A small sandboxed template language for chat formats, compiled to Python closures.

Source is parsed into a syntax tree, constants are folded, and every node becomes a closure. Templates reach
mapping keys, list places and the filters below, never Python attributes or calls. Text written inside
{% generation %} is reported to the sink as such, so a loss mask comes with the rendering.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable

TAG = re.compile(r"\{\{-?(?P<expr>.*?)-?\}\}|\{%-?(?P<stmt>.*?)-?%\}|\{#(?P<note>.*?)#\}", re.S)
TOKEN = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*/%~<>()\[\].,|]))", re.S)


class TemplateError(ValueError):
    """A template that cannot be parsed, or that reaches for something outside the sandbox."""


class Undefined:
    """A name or key that is not there: false, empty as text."""

    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""


UNDEFINED = Undefined()


def text_of(value) -> str:
    return "" if value is None or value is UNDEFINED else value if isinstance(value, str) else str(value)


FILTERS: dict[str, Callable] = {
    "upper": lambda v: text_of(v).upper(),
    "lower": lambda v: text_of(v).lower(),
    "trim": lambda v: text_of(v).strip(),
    "length": lambda v: 0 if v is UNDEFINED or v is None else len(v),
    "default": lambda v, other="": other if v is UNDEFINED or v is None else v,
}

BINARY = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.floordiv, "%": operator.mod,
    "~": lambda a, b: text_of(a) + text_of(b), "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}
LEVELS = (("==", "!=", "<", ">", "<=", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "/", "%"))
KEYWORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}

# Expressions are tuples: ("lit", v), ("name", n), ("get", a, b), ("bin", op, a, b), ("not", a), ("and"/"or", a, b),
# ("filter", name, a, args), ("test", name, a). Statements: ("text", s), ("out", e), ("for", n, e, body), ("if", [(e, body)], other),
# ("set", n, e), ("gen", body).


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        hit = self.peek(*values)
        self.at += hit
        return hit

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def whole(self):
        tree = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.binary(0)

    def binary(self, level: int):
        if level == len(LEVELS):
            return self.postfix()
        tree = self.binary(level + 1)
        while True:
            if level == 0 and self.take("is"):
                negate = self.take("not")
                if not self.peek("defined", "none"):
                    raise TemplateError("unknown test")
                tree = ("test", self.name(), tree)
                tree = ("not", tree) if negate else tree
                continue
            if level == 0 and self.peek("not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                op = "not in"
            elif self.peek(*LEVELS[level]):
                op = self.tokens[self.at][1]
                self.at += 1
            else:
                return tree
            tree = ("bin", op, tree, self.binary(level + 1))

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def postfix(self):
        tree = self.atom()
        while True:
            if self.take("."):
                tree = ("get", tree, ("lit", self.name()))
            elif self.take("["):
                tree = ("get", tree, self.either())
                self.need("]")
            elif self.take("|"):
                name, args = self.name(), []
                if self.take("("):
                    while not self.take(")"):
                        args.append(self.either())
                        self.take(",")
                tree = ("filter", name, tree, args)
            else:
                return tree

    def atom(self):
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        if self.take("-"):
            return ("bin", "-", ("lit", 0), self.postfix())
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("lit", int(value))
        if kind == "str":
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return ("lit", KEYWORDS[value]) if value in KEYWORDS else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """Syntax tree of a template."""
    parts, at, strip = [], 0, False
    for m in TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        parts.append(("text", text.rstrip() if m[0][2:3] == "-" else text))
        strip, at = m[0][-3:-2] == "-", m.end()
        if m["expr"] is not None:
            parts.append(("expr", m["expr"]))
        elif m["stmt"] is not None:
            parts.append(("stmt", m["stmt"].strip()))
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    parts = [p for p in parts if p != ("text", "")]
    place = 0

    def block(*ends: str):
        nonlocal place
        body = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                body.append(("text", value))
            elif kind == "expr":
                body.append(("out", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return body, word, rest
                body.append(statement(word, rest))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return body, "", ""

    def statement(word: str, rest: str):
        if word == "for":
            name, _, seq = rest.strip().partition(" in ")
            if not name.strip().isidentifier() or not seq:
                raise TemplateError("for needs a name and a sequence")
            return ("for", name.strip(), _Expression(seq).whole(), block("endfor")[0])
        if word == "if":
            arms, other, condition = [], [], rest
            while True:
                body, end, more = block("elif", "else", "endif")
                arms.append((_Expression(condition).whole(), body))
                if end == "else":
                    other = block("endif")[0]
                if end != "elif":
                    return ("if", arms, other)
                condition = more
        if word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not name.strip().isidentifier():
                raise TemplateError("set needs a name and a value")
            return ("set", name.strip(), _Expression(value).whole())
        if word == "generation":
            return ("gen", block("endgeneration")[0])
        raise TemplateError(f"unknown statement {word!r}")

    return block()[0]


def fold(node, filters: dict[str, Callable]):
    """The tree with constant expressions computed, dead branches dropped and neighbouring texts joined."""
    if isinstance(node, list):
        out = []
        for n in map(lambda n: fold(n, filters), node):
            for part in n if isinstance(n, list) else [n]:
                if part[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + part[1])
                elif part != ("text", ""):
                    out.append(part)
        return out
    kind = node[0]
    if kind == "out":
        e = fold(node[1], filters)
        return ("text", text_of(e[1])) if e[0] == "lit" else ("out", e)
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "gen":
        return ("gen", fold(node[1], filters))
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "if":
        arms = []
        for condition, body in node[1]:
            c = fold(condition, filters)
            if c[0] != "lit":
                arms.append((c, fold(body, filters)))
            elif c[1]:
                return ("if", arms, fold(body, filters)) if arms else fold(body, filters)
        return ("if", arms, fold(node[2], filters)) if arms else fold(node[2], filters)
    if kind in ("lit", "name", "text"):
        return node
    parts = tuple(fold(p, filters) if isinstance(p, tuple) else [fold(x, filters) for x in p] if isinstance(p, list) else p for p in node)
    inner = [p for p in parts[1:] if isinstance(p, tuple)] + [x for p in parts[1:] if isinstance(p, list) for x in p]
    if inner and all(p[0] == "lit" for p in inner):
        return ("lit", _expression(parts, filters)({}))
    return parts


def _lookup(value, key):
    if isinstance(value, dict):
        return value.get(key, UNDEFINED)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else UNDEFINED
    return UNDEFINED


def _expression(node, filters) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "lit":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name, UNDEFINED)
    if kind == "get":
        base, key = _expression(node[1], filters), _expression(node[2], filters)
        return lambda env: _lookup(base(env), key(env))
    if kind == "bin":
        op, a, b = BINARY[node[1]], _expression(node[2], filters), _expression(node[3], filters)
        return lambda env: op(a(env), b(env))
    if kind == "not":
        a = _expression(node[1], filters)
        return lambda env: not a(env)
    if kind in ("and", "or"):
        a, b = _expression(node[1], filters), _expression(node[2], filters)
        return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))
    if kind == "test":
        a, want_none = _expression(node[2], filters), node[1] == "none"
        return (lambda env: a(env) is None) if want_none else (lambda env: a(env) is not UNDEFINED)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        f, a, args = filters[node[1]], _expression(node[2], filters), [_expression(x, filters) for x in node[3]]
        return lambda env: f(a(env), *[x(env) for x in args])
    raise TemplateError(f"not an expression: {kind}")


def _loop(items: Iterable):
    """(item, loop variables) with one item of look-ahead, so that sequences may be streams."""
    it = iter(items)
    try:
        ahead = next(it)
    except StopIteration:
        return
    i = 0
    while True:
        item = ahead
        try:
            ahead = next(it)
            last = False
        except StopIteration:
            last = True
        yield item, {"index0": i, "index": i + 1, "first": i == 0, "last": last}
        if last:
            return
        i += 1


def _statements(body: list, filters) -> Callable[[dict, Callable[[str, bool], None], bool], None]:
    steps = [_statement(n, filters) for n in body]
    if len(steps) == 1:
        return steps[0]

    def run(env, write, masked):
        for step in steps:
            step(env, write, masked)

    return run


def _statement(node, filters):
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, write, masked: write(text, masked)
    if kind == "out":
        value = _expression(node[1], filters)
        return lambda env, write, masked: write(text_of(value(env)), masked)
    if kind == "set":
        name, value = node[1], _expression(node[2], filters)
        return lambda env, write, masked: env.__setitem__(name, value(env))
    if kind == "gen":
        inner = _statements(node[1], filters)
        return lambda env, write, masked: inner(env, write, True)
    if kind == "if":
        arms = [(_expression(c, filters), _statements(b, filters)) for c, b in node[1]]
        other = _statements(node[2], filters)

        def choose(env, write, masked):
            for condition, body in arms:
                if condition(env):
                    return body(env, write, masked)
            return other(env, write, masked)

        return choose
    name, sequence, body = node[1], _expression(node[2], filters), _statements(node[3], filters)

    def each(env, write, masked):
        items = sequence(env)
        for item, state in _loop(() if items is UNDEFINED or items is None else items):
            body(env | {name: item, "loop": state}, write, masked)

    return each


class Template:
    """A compiled template. render() streams (text, under the loss mask?) pieces to a sink."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        known = FILTERS | (filters or {})
        self.tree = fold(parse(source), known)
        self._run = _statements(self.tree, known)

    def stream(self, write: Callable[[str, bool], None], **variables) -> None:
        self._run(dict(variables), write, False)

    def render(self, **variables) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the (start, end) spans written under a generation marker."""
        parts, spans, at = [], [], 0

        def write(text: str, masked: bool) -> None:
            nonlocal at
            if masked and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            parts.append(text)
            at += len(text)

        self.stream(write, **variables)
        return "".join(parts), spans
