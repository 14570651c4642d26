"""Tokens and a precedence-climbing parser."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .tree import (
    AGGREGATORS,
    COMPARISONS,
    NAME,
    PARAMETRISED,
    SIGNATURES,
    Aggregate,
    At,
    Binary,
    Call,
    Matcher,
    Matching,
    Negate,
    Node,
    Number,
    Paren,
    QueryError,
    Selector,
    Subquery,
    Text,
    Window,
)


class ParseError(QueryError):
    """A text that is no query."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


_UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "y": 31_536_000_000}
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+)
    |(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
    |(?P<duration>\d+[smhdwy][\dsmhdwy]*)
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d*)?)
    |(?P<name>[A-Za-z_:][A-Za-z0-9_:]*)
    |(?P<op>=~|!~|==|!=|<=|>=|[-+*/%^<>={}()\[\],@])""",
    re.X | re.S,
)
_IN_BRACKETS = re.compile(r"(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>:)")
_ESCAPES = {"n": "\n", "t": "\t"}
_LEVELS = {"or": 1, "and": 2, "unless": 2, **dict.fromkeys(COMPARISONS, 3), "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 6}


def tokens_of(query: str) -> list[Token]:
    out, at, depth = [], 0, 0
    while at < len(query):
        # ":" stands alone between brackets, where it ends a range; elsewhere it belongs to names
        found = (_IN_BRACKETS.match(query, at) if depth else None) or _TOKEN.match(query, at)
        if not found:
            raise ParseError(f"unexpected character {query[at]!r} at {at}")
        kind, text = found.lastgroup, found.group()
        depth += (text == "[") - (text == "]") if kind == "op" else 0
        if kind == "text":
            text = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
        if kind != "space":
            out.append(Token(kind, text, at))
        at = found.end()
    return [*out, Token("end", "", at)]


def duration_ms(text: str) -> int:
    parts = re.findall(r"(\d+)([smhdwy])", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ParseError(f"malformed duration {text!r}")
    return sum(int(n) * _UNITS[u] for n, u in parts)


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise ParseError(f"malformed number {text!r}") from None


class _Parser:
    def __init__(self, query: str):
        self.tokens, self.at = tokens_of(query), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        token = self.now
        self.at += token.kind != "end"
        return token

    def is_(self, *texts: str, kind: str = "op") -> bool:
        return self.now.kind == kind and self.now.text in texts

    def skip(self, text: str, kind: str = "op") -> bool:
        if self.is_(text, kind=kind):
            self.take()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.skip(text):
            raise ParseError(f"expected {text!r} at {self.now.at}, found {self.now.text!r}")

    def need_kind(self, kind: str) -> str:
        if self.now.kind != kind:
            raise ParseError(f"expected a {kind} at {self.now.at}, found {self.now.text!r}")
        return self.take().text

    def expression(self, lowest: int = 1) -> Node:
        left = self.unary()
        while True:
            op = self.now.text if self.now.kind == "op" or self.now.text in ("and", "or", "unless") and self.now.kind == "name" else ""
            level = _LEVELS.get(op, 0)
            if level < lowest or not level:
                return left
            self.take()
            as_bool = self.skip("bool", "name")
            matching = self.matching()
            right = self.expression(level if op == "^" else level + 1)
            left = Binary(op, left, right, as_bool, matching)

    def matching(self) -> Matching:
        out = Matching()
        if self.is_("on", "ignoring", kind="name"):
            out.given, out.on = True, self.take().text == "on"
            out.labels = self.label_list()
        if self.is_("group_left", "group_right", kind="name"):
            out.many = self.take().text.removeprefix("group_")
            if self.is_("("):
                out.include = self.label_list()
        return out

    def label_list(self) -> list[str]:
        self.need("(")
        out = []
        while not self.skip(")"):
            out.append(self.need_kind("name"))
            if not self.is_(")"):
                self.need(",")
        return out

    def unary(self) -> Node:
        if self.is_("-", "+"):
            minus = self.take().text == "-"
            inner = self.expression(_LEVELS["^"])  # binds looser than a power, tighter than the rest
            return Negate(inner) if minus else inner
        return self.postfix(self.primary())

    def primary(self) -> Node:
        token = self.now
        if token.kind == "number":
            return Number(_number(self.take().text))
        if token.kind == "text":
            return Text(self.take().text)
        if self.skip("("):
            inner = self.expression()
            self.need(")")
            return Paren(inner)
        if self.is_("{"):
            return self.selector(None)
        if token.kind == "name":
            following = self.tokens[self.at + 1]
            opens = following.kind == "op" and following.text == "("
            if token.text in AGGREGATORS and (opens or following.kind == "name" and following.text in ("by", "without")):
                return self.aggregate()
            if token.text in SIGNATURES and opens:
                return self.call()
            return self.selector(self.take().text)
        raise ParseError(f"unexpected {token.text or 'end'!r} at {token.at}")

    def selector(self, metric: str | None) -> Selector:
        matchers = [Matcher(NAME, "=", metric)] if metric is not None else []
        if self.skip("{"):
            while not self.skip("}"):
                name = self.need_kind("name")
                if not self.is_("=", "!=", "=~", "!~"):
                    raise ParseError(f"expected a matcher at {self.now.at}")
                op = self.take().text
                value = self.need_kind("text")
                if op in ("=~", "!~"):
                    _check_pattern(value)
                matchers.append(Matcher(name, op, value))
                if not self.is_("}"):
                    self.need(",")
        if not matchers:
            raise ParseError("a selector needs at least one matcher")
        return Selector(matchers)

    def aggregate(self) -> Node:
        op, labels, without = self.take().text, [], False
        if self.is_("by", "without", kind="name"):
            without = self.take().text == "without"
            labels = self.label_list()
        args = self.arguments()
        if self.is_("by", "without", kind="name"):
            without = self.take().text == "without"
            labels = self.label_list()
        wanted = 2 if op in PARAMETRISED else 1
        if len(args) != wanted:
            raise ParseError(f"{op} takes {wanted} arguments")
        return Aggregate(op, args[-1], args[0] if wanted == 2 else None, labels, without)

    def call(self) -> Node:
        return Call(self.take().text, self.arguments())

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.skip(")"):
            out.append(self.expression())
            if not self.is_(")"):
                self.need(",")
        return out

    def postfix(self, node: Node) -> Node:
        if self.skip("["):
            length = duration_ms(self.need_kind("duration"))
            if self.skip(":"):
                step = duration_ms(self.take().text) if self.now.kind == "duration" else 0
                self.need("]")
                node = Subquery(node, length, step)
            else:
                self.need("]")
                if not isinstance(node, Selector):
                    raise ParseError("a range needs a series selector")
                node = Window(node, length)
        while self.is_("offset", kind="name") or self.is_("@"):
            target = node.selector if isinstance(node, Window) else node
            if not isinstance(target, Selector | Subquery):
                raise ParseError(f"{self.now.text} needs a selector or a subquery")
            if self.take().text == "@":
                target.at = self.at_time()
            else:
                sign = -1 if self.skip("-") else 1
                if sign > 0:
                    self.skip("+")
                target.offset = sign * duration_ms(self.need_kind("duration"))
        return node

    def at_time(self) -> At:
        if self.is_("start", "end", kind="name"):
            bound = self.take().text
            self.need("(")
            self.need(")")
            return At(bound=bound)
        sign = -1 if self.skip("-") else 1
        return At(ms=round(sign * _number(self.need_kind("number")) * 1000))


def _check_pattern(pattern: str) -> None:
    from ..functions.regex import java_pattern

    try:
        java_pattern(pattern)
    except ValueError as error:
        raise ParseError(str(error)) from None


def parse(query: str) -> Node:
    """The tree of a query; raises ParseError."""
    parser = _Parser(query)
    node = parser.expression()
    if parser.now.kind != "end":
        raise ParseError(f"unexpected {parser.now.text!r} at {parser.now.at}")
    return node


def parse_matchers(query: str) -> list[Matcher]:
    """The matchers of a series selector (or range selector)."""
    node = parse(query)
    if isinstance(node, Window):
        node = node.selector
    if not isinstance(node, Selector):
        raise ParseError(f"{query!r} is not a series selector")
    return node.matchers


__all__ = ["ParseError", "duration_ms", "parse", "parse_matchers", "tokens_of"]
