"""Evaluation times of a query: a regular grid, of which a subquery may use only some points."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.tree import QueryError

MAX_POINTS = 11_000


@dataclass(frozen=True)
class Grid:
    """``count`` times from ``start`` on, ``step`` apart; ``some`` (step_ts) names those in use, if not all."""

    start: int
    step: int
    count: int
    some: DataFrame | None = None

    @property
    def end(self) -> int:
        return self.start + (self.count - 1) * self.step

    @classmethod
    def at(cls, ts: int) -> Grid:
        return cls(ts, 1, 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """All times, as (step_ts)."""
        if self.some is not None:
            return self.some
        return spark.range(self.count).select((F.lit(self.start) + F.col("id") * self.step).alias("step_ts"))

    def first_from(self, t: Column) -> Column:
        """The index of the first time at or after ``t``."""
        return F.greatest(F.lit(0).cast("long"), F.ceil((t - self.start) / F.lit(self.step)).cast("long"))

    def last_until(self, t: Column) -> Column:
        """The index of the last time at or before ``t``."""
        return F.least(F.lit(self.count - 1).cast("long"), F.floor((t - self.start) / F.lit(self.step)).cast("long"))

    def most_steps(self, length: int) -> int:
        """How many times can lie in ``length``, both ends included."""
        return min(self.count, length // self.step + 1)

    def spread(self, df: DataFrame, first: Column, last: Column) -> DataFrame:
        """Each row once for every time with an index from ``first`` to ``last``, as step_ts."""
        if self.count == 1:
            return df.filter((first <= 0) & (last >= 0)).withColumn("step_ts", F.lit(self.start).cast("long"))
        # sequence() counts down where first > last
        index = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        out = df.withColumn("__i", F.explode(index)).withColumn("step_ts", F.lit(self.start) + F.col("__i") * self.step).drop("__i")
        return out if self.some is None else out.join(self.some, "step_ts", "left_semi")

    def everywhere(self, df: DataFrame) -> DataFrame:
        """Each row at every time (what does not depend on the time is computed once)."""
        return self.spread(df, F.lit(0).cast("long"), F.lit(self.count - 1).cast("long"))


def inner_grid(spark: SparkSession, outer: Grid, shift: int, length: int, step: int) -> Grid:
    """Times of a subquery: from each outer time less ``shift`` and ``length``, every ``step`` up to that time less ``shift``."""
    per = length // step
    if per + 1 > MAX_POINTS:
        raise QueryError(f"a subquery has more than {MAX_POINTS} points")
    low = outer.start - shift - length
    if outer.count == 1:
        return Grid(low, step, per + 1)
    if outer.some is None and outer.step % step == 0 and outer.step <= per * step + step:
        return Grid(low, step, (outer.end - outer.start) // step + per + 1)
    # points of the finest common grid, of which the windows use some
    fine = math.gcd(outer.step, step)
    starts = outer.frame(spark).select(F.explode(F.sequence(F.col("step_ts") - shift - length, F.col("step_ts") - shift - length + per * step, F.lit(step))).alias("step_ts"))
    return Grid(low, fine, (outer.end - outer.start + per * step) // fine + 1, starts.distinct())
