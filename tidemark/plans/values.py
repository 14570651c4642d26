"""What a compiled expression is: a scalar or a vector over all evaluation times."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


@dataclass
class Scalar:
    """A column over step_ts and the columns of ``needs``, tables (step_ts, name) with a row per time."""

    column: Column
    needs: list[DataFrame] = field(default_factory=list)
    constant: float | None = None

    def beside(self, df: DataFrame) -> DataFrame:
        """``df`` (step_ts, ...) with what the column needs; at most one row per evaluation time is sent."""
        for table in self.needs:
            df = df.join(F.broadcast(table), "step_ts")
        return df


@dataclass
class Vector:
    """``data`` (step_ts, sid, t, v [, ord]) and ``dim`` (sid, labels, okey).

    Labels change in ``dim`` alone, one row per series, until samples must meet by them. ``okey``
    orders series as the scan does; ``ord``, where present, orders the elements of each step.
    """

    data: DataFrame
    dim: DataFrame

    def relabelled(self, labels: Column) -> Vector:
        return Vector(self.data, self.dim.withColumn("labels", labels))

    def unnamed(self) -> Vector:
        return self.relabelled(L.drop_name(F.col("labels")))

    def valued(self, v: Column, scalars: tuple[Scalar, ...] = (), keep: Column | None = None, now: bool = False) -> Vector:
        """New values (null ones and those where ``keep`` fails are left out); ``now``: stamped with the step."""
        data = self.data
        for s in scalars:
            data = s.beside(data)
        if keep is not None:
            data = data.filter(keep)
        columns = [c for c in self.data.columns if c not in ("v", "t")]
        t = F.col("step_ts") if now else F.col("t")
        return Vector(data.select(*columns, t.alias("t"), v.alias("v")), self.dim)

    def ordered(self) -> DataFrame:
        """``data`` with ord; by default the order of the scan, which is that of the series' texts."""
        if "ord" in self.data.columns:
            return self.data
        return self.data.join(self.dim.select("sid", F.col("okey").alias("ord")), "sid")

    def rekeyed(self, labels: Column, ordered: bool) -> tuple[DataFrame, DataFrame]:
        """Data with gid by the given labels (and ord), and the dimension of those."""
        dim = self.dim.select("sid", "okey", labels.alias("glabels")).withColumn("gid", F.xxhash64(L.text_of(F.col("glabels"))))
        brought = ["sid", "gid"]
        if ordered and "ord" not in self.data.columns:
            dim = dim.withColumn("ord", F.col("okey"))
            brought.append("ord")
        return self.data.join(dim.select(*brought), "sid"), dim.groupBy("gid").agg(F.first("glabels").alias("labels"), F.min("okey").alias("okey"))
