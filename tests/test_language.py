import pytest

from tidemark.functions.numfmt import format_float
from tidemark.functions.regex import anchored, java_pattern, template_parts
from tidemark.lang import ParseError, kind_of, parse, parse_matchers
from tidemark.lang import tree as q
from tidemark.lang.parser import duration_ms


@pytest.mark.parametrize("text", ["m{", "sum(", "* 3", "m[5m", "(m)[5m]", "m offset", "m @", "sum by (m)", "{}", "m[5m][5m]", "m offset 5m [5m]", "topk(m)", "5min", '"open', "m{a=~\"(?=x)\"}"])
def test_what_is_no_query(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", ["1 == 2", "rate()", "rate(m)", "abs(1)", "m and 1", '-"x"', "sum(1)", 'label_join(m, ("a"), "b")', "clamp(m, 1)"])
def test_what_has_no_value(text):
    with pytest.raises(q.QueryError):
        kind_of(parse(text))


@pytest.mark.parametrize(
    "text,kind",
    [("1 + 2", "scalar"), ("m", "vector"), ("m[5m]", "matrix"), ("m[1h:]", "matrix"), ('"a"', "string"), ("1 == bool 2", "scalar"), ("time()", "scalar"), ("hour()", "vector"), ("Inf", "vector"), ("count_values(\"x\", m)", "vector")],
)
def test_kinds(text, kind):
    assert kind_of(parse(text)) == kind


def test_precedence():
    node = parse("1 + 2 * 3 ^ 2 ^ -1 or m")
    assert node.op == "or" and node.left.op == "+" and node.left.right.op == "*" and node.left.right.right.right.op == "^"
    assert isinstance(parse("-2 ^ 2"), q.Negate) and parse("-2 * 3").op == "*"


def test_modifiers_and_names():
    node = parse("a:b:c{x!~\"y\",}[1h30m] offset -5m @ 2.5")
    assert node.range_ms == 5_400_000 and node.selector.offset == -300_000 and node.selector.at.ms == 2500
    assert parse("rate(m[5m:])").args[0].step_ms == 0
    assert [m.op for m in parse_matchers('m{a="1",b=~"2"}[5m]')] == ["=", "=", "=~"]
    assert duration_ms("1d2h") == 93_600_000


@pytest.mark.parametrize(
    "pattern,java",
    [("[[:alpha:]]+", r"[\p{Alpha}]+"), ("[[:^digit:]_]", r"[\P{Digit}_]"), ("a[b[c]", r"a[b\[c]"), ("[]a]", r"[\]a]"), ("[^]a&&b]", r"[^\]a\&\&b]"), (r"\s\v", r"[\t\n\f\r ]\x0B"), (r"\pL\p{Greek}\P{Lu}\p{^Lu}", r"\p{L}\p{IsGreek}\P{Lu}\P{Lu}"), (r"\Qa.b\E[x]", r"\Qa.b\E[x]"), ("[[:word:]]", r"[\w]")],
)
def test_what_java_reads_otherwise(pattern, java):
    assert java_pattern(pattern) == java


@pytest.mark.parametrize("pattern", ["(?U)a", r"\h", "[[:foo:]]", r"a\Z", "a**"])
def test_what_is_no_pattern(pattern):
    with pytest.raises(ValueError):
        java_pattern(pattern)


def test_patterns():
    assert anchored("a|b") == r"(?d)\A(?:a|b)\z"
    assert java_pattern("(?P<x>a)") == "(?<x>a)"
    for foreign in ("(?=a)", "a*+", r"(a)\1", "("):
        with pytest.raises(ValueError):
            java_pattern(foreign)
    assert template_parts("a$1${x}$$") == [("text", "a"), ("group", "1"), ("group", "x"), ("text", "$")]


@pytest.mark.parametrize("v,text", [(30.0, "30"), (123456.0, "123456"), (1e6, "1e+06"), (37156664.0, "3.7156664e+07"), (0.0001, "0.0001"), (0.00001, "1e-05"), (-1.5, "-1.5"), (float("inf"), "+Inf"), (float("nan"), "NaN"), (0.0, "0"), (12345.678, "12345.678")])
def test_number_text(spark, v, text):
    from pyspark.sql import functions as F

    from tidemark.functions import numfmt

    assert format_float(v) == text
    assert spark.range(1).select(numfmt.text_of(F.lit(v)).alias("x")).first()[0] == text
