"""Numbers as text: the shortest digits that read back, an exponent from 1e+06 on and below 1e-04."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_of(v: Column) -> Column:
    """The text of a double, from the digits that Spark prints (those are the shortest)."""
    raw = F.abs(v).cast("string")  # 30.0, 1.0E21, 1.25E-7
    mantissa = F.regexp_replace(F.split_part(raw, F.lit("E"), F.lit(1)), r"\.0$", "")
    whole, fraction = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    given = F.coalesce(F.try_to_number(F.split_part(raw, F.lit("E"), F.lit(2)), F.lit("S999")).cast("int"), F.lit(0))
    joined = F.concat(whole, fraction)
    lead = F.length(joined) - F.length(F.ltrim(joined, F.lit("0")))
    digits = F.rtrim(F.ltrim(joined, F.lit("0")), F.lit("0"))
    exponent = F.length(whole) - 1 - lead + given  # of the first digit
    n = F.length(digits)
    scientific = F.concat(
        F.substring(digits, 1, 1),
        F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")),
    )
    plain = (
        F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
        .when(exponent + 1 >= n, F.rpad(digits, exponent + 1, F.lit("0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, n)))
    )
    sign = F.when((v < 0) | (F.atan2(F.lit(0.0), v) > 3) & (v == 0), "-").otherwise("")
    return (
        F.when(F.isnan(v), "NaN")
        .when(v == math.inf, "+Inf")
        .when(v == -math.inf, "-Inf")
        .when(v == 0, F.concat(sign, F.lit("0")))
        .otherwise(F.concat(sign, F.when((exponent < -4) | (exponent >= 6), scientific).otherwise(plain)))
    )


def format_float(v: float) -> str:
    """The same on the driver."""
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "+Inf" if v > 0 else "-Inf"
    if v == 0:
        return "-0" if math.copysign(1, v) < 0 else "0"
    head, _, exp = f"{abs(v):.17e}".partition("e")
    for digits in range(17):
        head, _, exp = f"{abs(v):.{digits}e}".partition("e")
        if float(f"{head}e{exp}") == abs(v):
            break
    sign, exponent, number = "-" if v < 0 else "", int(exp), head.replace(".", "")
    if exponent < -4 or exponent >= 6:
        tail = "." + number[1:] if len(number) > 1 else ""
        return f"{sign}{number[0]}{tail}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if exponent < 0:
        return f"{sign}0.{'0' * (-exponent - 1)}{number}"
    if exponent + 1 >= len(number):
        return sign + number.ljust(exponent + 1, "0")
    return f"{sign}{number[: exponent + 1]}.{number[exponent + 1 :]}"
