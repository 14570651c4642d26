"""Arithmetic as IEEE 754 has it, where Spark's expressions do something else.

Spark raises on division by zero, orders NaN above all numbers and equal to itself, gives null for
logarithms of non-positive numbers, and rounds to a BIGINT; none of that holds here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def number(value: float) -> Column:
    return F.lit(float(value))


def divide(a: Column, b: Column) -> Column:
    # x * 0 ** -1 has the sign and the NaN of x / 0
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def remainder(a: Column, b: Column) -> Column:
    return F.when(b == 0, number(NAN)).when(is_inf(b) & ~is_inf(a) & ~F.isnan(a), a).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def power(a: Column, b: Column) -> Column:
    return F.when(a == 1, F.lit(1.0)).when((a == -1) & is_inf(b), F.lit(1.0)).otherwise(F.pow(a, b))


def is_inf(a: Column) -> Column:
    return (a == number(INF)) | (a == number(-INF))


def logarithm(a: Column, base: float | None = None) -> Column:
    raw = F.ln(a) if base is None else F.log2(a) if base == 2 else F.log10(a)
    return F.when(F.isnan(a), a).when(a == 0, number(-INF)).when(a < 0, number(NAN)).otherwise(raw)


def floor(a: Column) -> Column:
    return F.when(F.isnan(a) | (F.abs(a) >= float(1 << 52)), a).otherwise(F.floor(F.when(F.isnan(a) | (F.abs(a) >= float(1 << 52)), F.lit(0.0)).otherwise(a)).cast("double"))


def ceil(a: Column) -> Column:
    return -floor(-a)


def minimum(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), number(NAN)).otherwise(F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)  # NaN is the greatest


def round_to(v: Column, nearest: Column) -> Column:
    n = F.when(nearest == 0, F.lit(1.0)).otherwise(nearest)
    return floor(divide(v, n) + 0.5) * n


def compare(op: str, a: Column, b: Column) -> Column:
    """A comparison in which NaN is unequal to everything and in no order."""
    either = F.isnan(a) | F.isnan(b)
    if op == "!=":
        return either | (a != b)
    plain = {"==": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    return ~either & plain


def arithmetic(op: str, a: Column, b: Column) -> Column:
    if op in ("+", "-", "*"):
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    return {"/": divide, "%": remainder, "^": power}[op](a, b)


def to_long(v: Column) -> Column:
    """Whole seconds or counts: truncated; NaN and what is out of range give null."""
    return F.when(F.isnan(v) | (F.abs(v) > 9.2e18), F.lit(None)).otherwise(F.when(F.isnan(v) | (F.abs(v) > 9.2e18), F.lit(0.0)).otherwise(v).cast("long"))
