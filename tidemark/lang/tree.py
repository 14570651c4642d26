"""Nodes of a parsed query, and the kind of value each one has."""

from __future__ import annotations

from dataclasses import dataclass, field

NAME = "__name__"
SCALAR, VECTOR, MATRIX, STRING = "scalar", "vector", "matrix", "string"

AGGREGATORS = frozenset("sum avg min max count group stddev stdvar quantile topk bottomk count_values".split())
#: Aggregators that take a parameter before the vector.
PARAMETRISED = frozenset("quantile topk bottomk count_values".split())
COMPARISONS = frozenset(["==", "!=", "<", ">", "<=", ">="])
SET_OPERATORS = frozenset(["and", "or", "unless"])

#: Argument kinds by function; "*" repeats the last, "?" ends what must be given.
SIGNATURES: dict[str, tuple[tuple[str, ...], str]] = {
    **{
        f: ((MATRIX,), VECTOR)
        for f in (
            "rate irate increase delta idelta deriv changes resets sum_over_time avg_over_time min_over_time max_over_time count_over_time stddev_over_time stdvar_over_time last_over_time present_over_time absent_over_time"
        ).split()
    },
    **{f: ((VECTOR,), VECTOR) for f in "abs ceil floor exp ln log2 log10 sqrt sgn timestamp sort sort_desc".split()},
    **{f: (("?", VECTOR), VECTOR) for f in "minute hour day_of_week day_of_month day_of_year days_in_month month year".split()},
    "absent": ((VECTOR,), VECTOR),
    "predict_linear": ((MATRIX, SCALAR), VECTOR),
    "quantile_over_time": ((SCALAR, MATRIX), VECTOR),
    "round": ((VECTOR, "?", SCALAR), VECTOR),
    "clamp": ((VECTOR, SCALAR, SCALAR), VECTOR),
    "clamp_min": ((VECTOR, SCALAR), VECTOR),
    "clamp_max": ((VECTOR, SCALAR), VECTOR),
    "scalar": ((VECTOR,), SCALAR),
    "vector": ((SCALAR,), VECTOR),
    "time": ((), SCALAR),
    "label_replace": ((VECTOR, STRING, STRING, STRING, STRING), VECTOR),
    "label_join": ((VECTOR, STRING, STRING, "*", STRING), VECTOR),
    "histogram_quantile": ((SCALAR, VECTOR), VECTOR),
}


class QueryError(ValueError):
    """A query that cannot be evaluated."""


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str


@dataclass
class At:
    """A fixed evaluation time: milliseconds, or a bound of the query."""

    ms: int | None = None
    bound: str | None = None


@dataclass
class Node:
    pass


@dataclass
class Number(Node):
    value: float


@dataclass
class Text(Node):
    value: str


@dataclass
class Paren(Node):
    inner: Node


@dataclass
class Selector(Node):
    matchers: list[Matcher]
    offset: int = 0
    at: At | None = None


@dataclass
class Window(Node):
    """A range selector."""

    selector: Selector
    range_ms: int


@dataclass
class Subquery(Node):
    inner: Node
    range_ms: int
    step_ms: int = 0
    offset: int = 0
    at: At | None = None


@dataclass
class Negate(Node):
    inner: Node


@dataclass
class Matching:
    """How two vectors are matched: labels to use (or to leave out) and the many side, if any."""

    on: bool = False
    labels: list[str] = field(default_factory=list)
    given: bool = False
    many: str | None = None
    include: list[str] = field(default_factory=list)


@dataclass
class Binary(Node):
    op: str
    left: Node
    right: Node
    as_bool: bool = False
    matching: Matching = field(default_factory=Matching)


@dataclass
class Aggregate(Node):
    op: str
    inner: Node
    param: Node | None = None
    labels: list[str] = field(default_factory=list)
    without: bool = False


@dataclass
class Call(Node):
    name: str
    args: list[Node]


def kind_of(node: Node) -> str:
    """The kind of a node's value; raises for what can never be evaluated."""
    match node:
        case Number():
            return SCALAR
        case Text():
            return STRING
        case Paren(inner):
            return kind_of(inner)
        case Selector():
            return VECTOR
        case Window():
            return MATRIX
        case Subquery(inner):
            if kind_of(inner) not in (VECTOR, SCALAR):
                raise QueryError("a subquery needs an instant vector or a scalar")
            return MATRIX
        case Negate(inner):
            kind = kind_of(inner)
            if kind not in (VECTOR, SCALAR):
                raise QueryError(f"cannot negate a {kind}")
            return kind
        case Aggregate():
            return _kind_of_aggregate(node)
        case Call():
            return _kind_of_call(node)
        case Binary():
            return _kind_of_binary(node)
    raise QueryError(f"unknown node {node!r}")


def _kind_of_aggregate(node: Aggregate) -> str:
    if kind_of(node.inner) != VECTOR:
        raise QueryError(f"{node.op} needs an instant vector")
    if node.op in PARAMETRISED:
        if node.param is None:
            raise QueryError(f"{node.op} needs a parameter")
        kind_of(node.param)
    return VECTOR


def _kind_of_call(node: Call) -> str:
    wanted, result = SIGNATURES[node.name]
    optional, repeat, last, at = False, False, None, 0
    for kind in wanted:
        if kind == "?":
            optional = True
        elif kind == "*":
            repeat = True
        else:
            last = kind
            if at >= len(node.args):
                if optional or repeat:
                    break
                raise QueryError(f"{node.name}: missing argument {at + 1}")
            _check_argument(node, at, kind)
            at += 1
    while repeat and at < len(node.args):
        _check_argument(node, at, last)
        at += 1
    return result


def _check_argument(node: Call, at: int, kind: str) -> None:
    arg = node.args[at]
    found = STRING if isinstance(arg, Text) else kind_of(arg)
    # a text must be a literal: not even one in parentheses will do
    if found != kind or (kind == STRING and not isinstance(arg, Text)):
        raise QueryError(f"{node.name}: argument {at + 1} must be a {kind}, not a {found}")


def _kind_of_binary(node: Binary) -> str:
    kinds = kind_of(node.left), kind_of(node.right)
    if any(k not in (SCALAR, VECTOR) for k in kinds):
        raise QueryError(f"{node.op} needs scalars or instant vectors")
    if node.op in SET_OPERATORS and kinds != (VECTOR, VECTOR):
        raise QueryError(f"{node.op} needs two instant vectors")
    if kinds == (SCALAR, SCALAR):
        if node.op in COMPARISONS and not node.as_bool:
            raise QueryError("a comparison of scalars needs bool")
        return SCALAR
    return VECTOR
