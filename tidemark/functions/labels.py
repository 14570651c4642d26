"""Label sets: maps from name to value, with a canonical text that is a series' identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.tree import NAME, Matcher
from .regex import anchored

LABELS = "map<string,string>"


def get(labels: Column, name: str) -> Column:
    """A label's value; an absent one reads as empty."""
    return F.coalesce(labels[name], F.lit(""))


def holds(labels: Column, matcher: Matcher) -> Column:
    value = get(labels, matcher.name)
    if matcher.op == "=":
        return value == matcher.value
    if matcher.op == "!=":
        return value != matcher.value
    found = value.rlike(anchored(matcher.value))
    return found if matcher.op == "=~" else ~found


def all_hold(labels: Column, matchers: Sequence[Matcher]) -> Column:
    out = F.lit(True)
    for m in matchers:
        out = out & holds(labels, m)
    return out


def _quoted(value: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        value = F.replace(value, F.lit(plain), F.lit(code))
    return F.concat(F.lit('"'), value, F.lit('"'))


def text_of(labels: Column) -> Column:
    """``name{a="x",b="y"}`` with names in byte order; the metric name in front, braces only where needed."""
    others = F.array_sort(F.map_entries(F.map_filter(labels, lambda k, _: k != NAME)))
    pairs = F.array_join(F.transform(others, lambda e: F.concat(e["key"], F.lit("="), _quoted(e["value"]))), ",")
    name = get(labels, NAME)
    return F.when((F.size(others) == 0) & (name != ""), name).otherwise(F.concat(name, F.lit("{"), pairs, F.lit("}")))


def keep(labels: Column, names: Sequence[str]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(*names)) if names else empty()


def drop(labels: Column, names: Sequence[str]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names)) if names else labels


def drop_name(labels: Column) -> Column:
    return drop(labels, [NAME])


def empty() -> Column:
    return F.create_map().cast(LABELS)


def literal(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]).cast(LABELS) if pairs else empty()


def overlay(under: Column, over: Column) -> Column:
    """Both sets; where both have a name, the value of ``over``."""
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k)), over)


def with_label(labels: Column, name: str, value: Column) -> Column:
    """``labels`` with ``name`` set to ``value``, or without it where that is empty."""
    rest = drop(labels, [name])
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))
