"""Queries over a store: instant and range evaluation, and lookups of series and labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import labels as L
from .lang import kind_of, parse, parse_matchers
from .lang import tree as q
from .plans.compiler import LOOKBACK_MS, Compiler
from .plans.grid import MAX_POINTS, Grid
from .plans.values import Scalar
from .store import Store


@dataclass
class Result:
    """A query's value. ``kind``: scalar (frame: t, v), vector and matrix (key, labels, t, v), or string (text)."""

    kind: str
    frame: DataFrame | None = None
    text: str = ""


def _root(node: q.Node) -> q.Node:
    while isinstance(node, q.Paren):
        node = node.inner
    return node


class Engine:
    def __init__(self, store: Store, lookback_ms: int = LOOKBACK_MS):
        self.store, self.lookback_ms = store, lookback_ms
        self.spark = store.samples.sparkSession

    def _shown(self, data: DataFrame, dim: DataFrame, t: str) -> DataFrame:
        keyed = dim.select("sid", L.text_of(F.col("labels")).alias("key"), "labels", "okey")
        return data.join(keyed, "sid").select("key", "labels", F.col(t).alias("t"), "v", "okey", *(["ord"] if "ord" in data.columns else []))

    def instant(self, query: str, ts: int) -> Result:
        """The value at ``ts`` (milliseconds)."""
        node = parse(query)
        kind = kind_of(node)
        compiler, grid = Compiler(self.store, ts, ts, self.lookback_ms), Grid.at(ts)
        if kind == q.STRING:
            return Result(kind, text=_root(node).value)
        if kind == q.MATRIX:
            points, _ = compiler.points(node, grid)
            low, high = points.grid.start - points.shift - points.length, points.grid.start - points.shift
            data = points.data.filter(F.col("t").between(low, high))
            return Result(kind, self._shown(data, points.dim, "t").select("key", "labels", "t", "v").orderBy("key", "t"))
        got = compiler.value(node, grid)
        if isinstance(got, Scalar):
            return Result(kind, got.beside(grid.frame(self.spark)).select(F.col("step_ts").alias("t"), got.column.alias("v")))
        shown = self._shown(got.data, got.dim, "step_ts")
        root = _root(node)
        order = [F.col("ord").asc()] if "ord" in shown.columns else []
        order += [F.col("okey").asc(), F.col("key").asc()]
        if isinstance(root, q.Call) and root.name in ("sort", "sort_desc"):
            order = [F.isnan("v").asc(), F.col("v").asc() if root.name == "sort" else F.col("v").desc(), *order]
        return Result(kind, shown.orderBy(*order).select("key", "labels", "t", "v"))

    def range(self, query: str, start: int, end: int, step: int) -> Result:
        """The values at start, start + step, ... up to ``end``, as a matrix sorted by label text and time."""
        got = self.range_frame(query, start, end, step)
        return Result(q.MATRIX, got.orderBy("key", "t"))

    def range_frame(self, query: str, start: int, end: int, step: int) -> DataFrame:
        """The same, unsorted: (key, labels, t, v)."""
        if step <= 0:
            raise q.QueryError("the step must be positive")
        if end < start:
            raise q.QueryError("the end lies before the start")
        count = (end - start) // step + 1
        if count > MAX_POINTS:
            raise q.QueryError(f"more than {MAX_POINTS} points; use a shorter range or a longer step")
        node = parse(query)
        if kind_of(node) not in (q.SCALAR, q.VECTOR):
            raise q.QueryError("a range query needs a scalar or an instant vector")
        compiler, grid = Compiler(self.store, start, end, self.lookback_ms), Grid(start, step, count)
        got = compiler.value(node, grid)
        if isinstance(got, Scalar):
            got = compiler.constant_vector(got, grid)
        return self._shown(got.data, got.dim, "step_ts").select("key", "labels", "t", "v")

    def _matching(self, selectors: list[str]) -> DataFrame:
        held = F.lit(False)
        for s in selectors:
            held = held | L.all_hold(F.col("labels"), parse_matchers(s))
        return self.store.series.filter(held) if selectors else self.store.series

    def series(self, selectors: list[str], start: int, end: int) -> DataFrame:
        """(key, labels) of the series that any selector matches and that have a sample in [start, end]."""
        if not selectors:
            raise q.QueryError("at least one selector is needed")
        alive = self.store.between(start, end).select("sid")
        return self._matching(selectors).join(alive, "sid", "left_semi").select("key", "labels")

    def label_names(self, selectors: list[str] | None = None) -> DataFrame:
        names = self._matching(selectors or []).select(F.explode(F.map_keys("labels")).alias("name"))
        return names.distinct().orderBy("name")

    def label_values(self, name: str, selectors: list[str] | None = None) -> DataFrame:
        values = self._matching(selectors or []).select(L.get(F.col("labels"), name).alias("value"))
        return values.filter("value <> ''").distinct().orderBy("value")
