"""The text exposition format: lines of samples with labels, and comments that describe metrics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.tree import NAME

MAX_LINE = 4 << 20
_SPECIAL = {"+inf": "inf", "inf": "inf", "+infinity": "inf", "infinity": "inf", "-inf": "-inf", "-infinity": "-inf", "nan": "nan"}
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_HEX_FLOAT = re.compile(r"[+-]?0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+")
_NAME = re.compile(r"[A-Za-z_:][A-Za-z0-9_:]*")
_LABEL = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*\"((?:[^\"\\]|\\.)*)\"\s*(,|(?=\}))", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)
TYPES = ("counter", "gauge", "histogram", "summary")


def parse_float(text: str) -> float:
    special = _SPECIAL.get(text.lower())
    if special:
        return float(special)
    if _HEX_FLOAT.fullmatch(text):
        return float.fromhex(text)
    if not _FLOAT.fullmatch(text):
        raise ValueError(f"malformed value {text!r}")
    return float(text)


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def parse_sample(line: str) -> tuple[dict[str, str], float, int | None]:
    """Labels, value and milliseconds (if given) of a sample line; raises ValueError."""
    if len(line.encode()) > MAX_LINE:
        raise ValueError("a line is too long")
    line = line.strip()
    found = _NAME.match(line)
    if not found:
        raise ValueError(f"no metric name in {line[:80]!r}")
    labels, rest = {}, line[found.end() :].lstrip()
    if rest.startswith("{"):
        at = 1
        while True:
            closing = re.compile(r"\s*\}").match(rest, at)
            if closing:
                rest = rest[closing.end() :]
                break
            pair = _LABEL.match(rest, at)
            if not pair:
                raise ValueError(f"malformed labels in {line[:80]!r}")
            labels[pair[1]] = _unescape(pair[2])
            at = pair.end()
    # a name among the labels could pass for another metric's
    labels[NAME] = found[0]
    parts = rest.split()
    if not 1 <= len(parts) <= 2:
        raise ValueError(f"a value and at most a time are expected in {line[:80]!r}")
    if len(parts) == 2 and not re.fullmatch(r"[+-]?\d+", parts[1]):
        raise ValueError(f"malformed time {parts[1]!r}")
    return labels, parse_float(parts[0]), int(parts[1]) if len(parts) == 2 else None


@dataclass
class Parsed:
    samples: list[tuple[dict[str, str], float, int | None]] = field(default_factory=list)
    metadata: dict[str, tuple[str, str]] = field(default_factory=dict)  # name -> type, help
    bad: int = 0
    error: str | None = None


def parse(text: str) -> Parsed:
    """Everything in ``text``; bad lines are counted and passed over, the first error is kept."""
    out = Parsed()
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith("#"):
            comment = re.match(r"#\s*(HELP|TYPE)\s+(\S+)\s*(.*)", line, re.S)
            if comment:
                kind, note = out.metadata.get(comment[2], ("untyped", ""))
                if comment[1] == "TYPE":
                    kind = comment[3].strip() if comment[3].strip() in TYPES else "untyped"
                else:
                    note = _unescape(comment[3])
                out.metadata[comment[2]] = (kind, note)
        elif line:
            try:
                out.samples.append(parse_sample(line))
            except ValueError as error:
                out.bad += 1
                out.error = out.error or str(error)
    return out


def samples(lines: DataFrame, column: str = "value") -> DataFrame:
    """From lines of text: (labels, v, timestamp_ms, error); a bad line has only an error. Comments give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, values, times, errors = [], [], [], []
            for line in batch.column(0).to_pylist():
                try:
                    a, v, t = parse_sample(line)
                    error = None
                except ValueError as e:
                    a, v, t, error = None, None, None, str(e)
                labels.append(a)
                values.append(v)
                times.append(t)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([pa.array([x and list(x.items()) for x in labels], pa.map_(pa.string(), pa.string())), pa.array(values, pa.float64()), pa.array(times, pa.int64()), pa.array(errors, pa.string())], ["labels", "v", "timestamp_ms", "error"])

    text = F.trim(F.col(column))
    plain = lines.filter((text != "") & ~F.startswith(text, F.lit("#"))).select(F.col(column))
    return plain.mapInArrow(run, "labels map<string,string>, v double, timestamp_ms long, error string")


def metadata(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, type, help) from the comments; an unknown type is untyped."""
    text = F.trim(F.col(column))
    part = lambda kind, n: F.regexp_extract(text, rf"(?s)^#\s*{kind}\s+(\S+)\s*(.*)$", n)
    kind = F.when(part("TYPE", 2).isin(*TYPES), part("TYPE", 2)).otherwise("untyped")
    note = F.replace(F.replace(F.replace(part("HELP", 2), F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))
    rows = lines.select(F.when(part("TYPE", 1) != "", part("TYPE", 1)).when(part("HELP", 1) != "", part("HELP", 1)).alias("name"), F.when(part("TYPE", 1) != "", kind).alias("type"), F.when(part("HELP", 1) != "", note).alias("help"))
    return rows.filter("name is not null").groupBy("name").agg(F.coalesce(F.max("type"), F.lit("untyped")).alias("type"), F.coalesce(F.max("help"), F.lit("")).alias("help"))


def render(rows: DataFrame) -> DataFrame:
    """Sample lines (value) from (labels, v): a sink for any text writer."""
    from ..functions import numfmt
    from ..functions.labels import text_of

    key = F.regexp_replace(text_of(F.col("labels")), r"\{\}$", "")
    return rows.select(F.concat(key, F.lit(" "), numfmt.text_of(F.col("v"))).alias("value"))
