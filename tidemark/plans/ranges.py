"""Functions over the samples of a sliding window, all steps at once.

Each sample knows the one before it (``pt``, ``pv``, from one lag per series), so pairwise folds are
sums of per-sample terms: a pair lies in a window if ``pt`` does. Each sample goes to every step
whose window holds it, and one hash aggregation by (series, step) does the rest.

Where samples are dense, those of one tile (between two steps, or on one) are folded first, so that
only one row per tile and series is spread over the steps. A tile acts as one sample does: its inner
pairs are always in a window with it, its first pair only if the sample before it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from .grid import Grid


@dataclass
class Points:
    """Window contents: (sid, t, v). A point at t is in the window of step s if s - shift - length <= t <= s - shift.

    ``every`` and aligned are for subqueries: points lie ``every`` apart counted from the window's start,
    and where steps are no multiple of that, a step's window leaves out the points of others.
    """

    data: DataFrame
    dim: DataFrame
    grid: Grid
    shift: int
    length: int
    every: int | None = None

    @property
    def aligned(self) -> bool:
        return self.every is None or self.grid.count == 1 or self.grid.step % self.every == 0


def _lagged(data: DataFrame, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("t")
    return data.withColumn("pt", F.lag("t").over(w)).withColumn("pv", F.lag("v").over(w))


def _rise() -> Column:
    return F.when(F.col("v") >= F.col("pv"), F.col("v") - F.col("pv")).otherwise(F.col("v"))


def _change() -> Column:
    return F.when(F.col("v") != F.col("pv"), 1.0).otherwise(0.0)


def _reset() -> Column:
    return F.when(~F.isnan("pv") & (F.col("v") < F.col("pv")), 1.0).otherwise(0.0)


#: The term of a pair of samples, by function.
PAIRWISE = {"rate": _rise, "increase": _rise, "changes": _change, "resets": _reset}
#: Functions whose windows can be put together from tiles.
TILED = frozenset("rate increase changes resets sum_over_time avg_over_time count_over_time min_over_time max_over_time last_over_time present_over_time delta irate idelta".split())


def _tiles(points: Points, data: DataFrame) -> tuple[Column, Column, Column]:
    """A sample's tile, and the first and last step whose window holds the tile."""
    rel = F.col("t") + points.shift - points.grid.start
    q = F.floor(rel / F.lit(points.grid.step)).cast("long")
    odd = (F.pmod(rel, F.lit(points.grid.step)) > 0).cast("long")
    return 2 * q + odd, q + odd, q + F.lit(points.length // points.grid.step)


def apply(points: Points, name: str, dense: bool, scalar: Column | None = None) -> DataFrame:
    """(step_ts, sid, t, v) of function ``name``; ``scalar`` may use step_ts and what was joined before."""
    grid, data = points.grid, points.data
    pairs = name in PAIRWISE or name in ("irate", "idelta")
    low = F.col("step_ts") - points.shift - points.length
    if pairs and points.aligned:
        data = _lagged(data, "sid")
    if dense and name in TILED and points.aligned and points.length % grid.step == 0 and grid.count > 1 and grid.some is None:
        spread = _folded(points, data, name)
    else:
        first, last = grid.first_from(F.col("t") + points.shift), grid.last_until(F.col("t") + points.shift + points.length)
        spread = grid.spread(data, first, last)
        if not points.aligned:
            spread = spread.filter(F.pmod(F.col("t") - low, F.lit(points.every)) == 0)
            if pairs:
                spread = _lagged(spread, "sid", "step_ts")
        spread = _as_tiles(spread, name)
    return _value(spread, name, low, points, scalar)


def _as_tiles(spread: DataFrame, name: str) -> DataFrame:
    """Every sample as a tile of its own."""
    if name in PAIRWISE:
        return spread.select("step_ts", "sid", F.lit(1).cast("long").alias("n"), F.col("t").alias("t0"), F.col("t").alias("t1"), F.lit(0.0).alias("inner"), F.col("pt").alias("hp"), PAIRWISE[name]().alias("head"))
    return spread.withColumn("n", F.lit(1).cast("long"))


def _folded(points: Points, data: DataFrame, name: str) -> DataFrame:
    tile, first, last = _tiles(points, data)
    data = data.withColumn("__tile", tile).withColumn("__i0", first).withColumn("__i1", last)
    by = data.groupBy("sid", "__tile", "__i0", "__i1")
    n = F.count(F.lit(1)).alias("n")
    if name in PAIRWISE:
        rel = F.col("pt") + points.shift - points.grid.start
        before = 2 * F.floor(rel / F.lit(points.grid.step)).cast("long") + (F.pmod(rel, F.lit(points.grid.step)) > 0).cast("long")
        inside = F.coalesce(before == F.col("__tile"), F.lit(False))
        term = PAIRWISE[name]()
        out = by.agg(n, F.min("t").alias("t0"), F.max("t").alias("t1"), F.sum(F.when(inside, term).otherwise(0.0)).alias("inner"), F.max(F.when(~inside, F.col("pt"))).alias("hp"), F.max(F.when(~inside & F.col("pt").isNotNull(), term)).alias("head"))
    elif name in ("sum_over_time", "avg_over_time", "count_over_time", "present_over_time"):
        out = by.agg(n, F.sum("v").alias("v"))
    elif name in ("min_over_time", "max_over_time"):
        real = F.when(~F.isnan("v"), F.col("v"))
        out = by.agg(n, F.coalesce(F.min(real) if name[:3] == "min" else F.max(real), ieee.number(ieee.NAN)).alias("v"))
    elif name == "delta":
        out = by.agg(n, F.min_by("v", "t").alias("v0"), F.min("t").alias("t0"), F.max_by("v", "t").alias("v"), F.max("t").alias("t"))
    else:  # the latest sample stands for the tile
        out = by.agg(n, F.max_by(F.struct(*[c for c in data.columns if c in ("t", "v", "pt", "pv")]), "t").alias("x")).select("sid", "__i0", "__i1", "n", "x.*")
    first = F.greatest(F.lit(0).cast("long"), F.col("__i0"))
    last = F.least(F.lit(points.grid.count - 1).cast("long"), F.col("__i1"))
    return points.grid.spread(out, first, last)


def _value(spread: DataFrame, name: str, low: Column, points: Points, scalar: Column | None) -> DataFrame:
    by = spread.groupBy("sid", "step_ts")
    n = F.sum("n").alias("n")
    seconds = lambda ms: ms / F.lit(1000.0)
    if name in PAIRWISE:
        total = F.sum(F.col("inner") + F.when(F.coalesce(F.col("hp") >= low, F.lit(False)), F.col("head")).otherwise(0.0)).alias("x")
        out = by.agg(n, total, (F.max("t1") - F.min("t0")).alias("ms"))
        if name == "rate":
            return _select(out.filter("n >= 2 and ms > 0"), F.col("x") / seconds(F.col("ms")))
        return _select(out.filter("n >= 2") if name == "increase" else out, F.col("x"))
    if name in ("irate", "idelta"):
        out = by.agg(F.max_by(F.struct("v", "pv", "t", "pt"), "t").alias("x")).select("sid", "step_ts", "x.*").filter(F.coalesce(F.col("pt") >= low, F.lit(False)))
        if name == "idelta":
            return _select(out, F.col("v") - F.col("pv"))
        return _select(out.filter("t > pt"), _rise() / seconds(F.col("t") - F.col("pt")))
    if name == "delta":
        first = F.min_by("v0", "t0") if "v0" in spread.columns else F.min_by("v", "t")
        return _select(by.agg(n, (F.max_by("v", "t") - first).alias("x")).filter("n >= 2"), F.col("x"))
    if name in ("deriv", "predict_linear"):
        return _fitted(spread, name, scalar)
    if name == "last_over_time":
        return _select(by.agg(F.max_by("v", "t").alias("x")), F.col("x"))
    if name == "quantile_over_time":
        out = by.agg(F.sort_array(F.collect_list(F.struct((~F.isnan("v")).alias("r"), F.col("v").alias("v")))).alias("a"))
        return out.select("step_ts", "sid", F.col("step_ts").alias("t"), F.transform("a", lambda x: x["v"]).alias("a"))
    real = F.when(~F.isnan("v"), F.col("v"))
    value = {
        "sum_over_time": F.sum("v"),
        "avg_over_time": F.sum("v") / F.sum("n"),
        "count_over_time": F.sum("n").cast("double"),
        "present_over_time": F.first(F.lit(1.0)),
        "min_over_time": F.coalesce(F.min(real), ieee.number(ieee.INF)),
        "max_over_time": F.coalesce(F.max(real), ieee.number(-ieee.INF)),
        "stddev_over_time": F.stddev_pop("v"),
        "stdvar_over_time": F.var_pop("v"),
    }[name]
    return _select(by.agg(value.alias("x")), F.col("x"))


def _fitted(spread: DataFrame, name: str, scalar: Column | None) -> DataFrame:
    """Least squares over time in seconds from the step: slope, or the line's value ``scalar`` seconds on."""
    x, v = (F.col("t") - F.col("step_ts")) / F.lit(1000.0), F.col("v")
    sums = spread.groupBy("sid", "step_ts").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(v).alias("sy"), F.sum(x * v).alias("sxy"), F.sum(x * x).alias("sxx"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    below = n * F.col("sxx") - sx * sx
    slope = F.when((F.col("lo") == F.col("hi")) | (below == 0), F.lit(0.0)).otherwise((n * F.col("sxy") - sx * sy) / F.when(below == 0, F.lit(1.0)).otherwise(below))
    out = sums.filter("n >= 2").withColumn("slope", slope)
    if name == "deriv":
        return _select(out, F.col("slope"))
    return _select(out, None, ("slope", ((sy - F.col("slope") * sx) / n).alias("intercept")))


def _select(df: DataFrame, value: Column | None, more: tuple = ()) -> DataFrame:
    columns = [F.col("step_ts"), F.col("sid"), F.col("step_ts").alias("t")]
    return df.select(*columns, value.alias("v")) if value is not None else df.select(*columns, *more)


def quantile(q: Column, values: Column) -> Column:
    """The q-quantile of a sorted array (NaN first), interpolated; beyond 0 and 1 the infinities."""
    n = F.size(values)
    rank = q * (n - 1).cast("double")
    at = F.when(F.isnan(q) | (q < 0) | (q > 1), F.lit(0)).otherwise(F.floor(F.when(F.isnan(rank), F.lit(0.0)).otherwise(rank)).cast("int"))
    at = F.least(F.greatest(at, F.lit(0)), n - 1)
    weight = rank - at.cast("double")
    low, high = F.get(values, at), F.get(values, F.least(F.when(weight > 0, at + 1).otherwise(at), n - 1))
    return (
        F.when(F.isnan(q), ieee.number(ieee.NAN))
        .when(q < 0, ieee.number(-ieee.INF))
        .when(q > 1, ieee.number(ieee.INF))
        .otherwise(low * (1.0 - weight) + high * weight)
    )
