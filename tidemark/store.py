"""Series and samples: a small dimension and a large fact table.

``series``  (sid BIGINT, labels MAP<STRING,STRING>, key STRING): one row per label set.
``samples`` (sid BIGINT, t BIGINT milliseconds, v DOUBLE [, day DATE]): one row per sample.

``sid`` is the 64-bit hash of the canonical label text; the text is the identity.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import labels as L

DAY_MS = 86_400_000
EPOCH = datetime(1970, 1, 1)
#: The end of the year 9999, beyond which there are no timestamps.
LAST_MS = 253_402_300_799_999


def series_id(key: Column) -> Column:
    return F.xxhash64(key)


@dataclass
class Store:
    series: DataFrame
    samples: DataFrame
    #: Usual time between a series' samples, where known: lets range functions sum tiles first.
    interval_ms: int | None = None
    #: Whether samples are partitioned by day.
    by_day: bool = False
    #: The source's own time, a timestamp without zone, by which its files can be pruned; samples hold it under this name.
    raw: str | None = None

    @classmethod
    def of_rows(cls, rows: DataFrame, distinct: bool = False) -> Store:
        """From rows (labels, t, v); ``distinct`` says that no series has two samples at one time."""
        keyed = rows.withColumn("key", L.text_of(F.col("labels"))).withColumn("sid", series_id(F.col("key")))
        samples = keyed.select("sid", "t", "v")
        return cls(keyed.select("sid", "labels", "key").dropDuplicates(["sid"]), samples if distinct else samples.dropDuplicates(["sid", "t"]))

    @classmethod
    def of_columns(cls, rows: DataFrame, metric: str, names: list[str], t: Column, v: Column, raw: str | None = None) -> Store:
        """From a wide table: label values in columns. The label text is built once per series, not per sample.

        ``raw`` names the column of times from which ``t`` is derived by rounding down.
        """
        marked = rows.withColumn("sid", F.xxhash64(F.lit(metric), *[F.col(n).cast("string") for n in names]))
        pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))]
        labels = F.create_map(F.lit(L.NAME), F.lit(metric), *pairs)
        dim = marked.select("sid", *names).dropDuplicates(["sid"])
        return cls(dim.select("sid", labels.alias("labels"), L.text_of(labels).alias("key")), marked.select("sid", t.alias("t"), v.alias("v"), *([raw] if raw else [])), raw=raw)

    @classmethod
    def read(cls, spark: SparkSession, path: str, from_ms: int | None = None) -> Store:
        """A written store, from ``from_ms`` on if that is given."""
        samples, notes = spark.read.parquet(f"{path}/samples"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/interval")
        if from_ms is not None:
            samples = samples.filter((F.col("t") >= from_ms) & (F.col("day") >= F.to_date(F.timestamp_millis(F.lit(from_ms)))))
        files = notes.getFileSystem(spark._jsc.hadoopConfiguration())
        interval = spark.read.parquet(f"{path}/interval").agg(F.min("interval_ms")).first()[0] if files.exists(notes) else None
        return cls(spark.read.parquet(f"{path}/series"), samples, interval, by_day=True)

    def write(self, path: str, mode: str = "append") -> None:
        """Writes both tables; samples by day, sorted so that row groups prune by series and time.

        Series come first: a write that is cut off leaves series without samples, which no query shows, never the
        other way round. The usual time between samples is measured and kept beside them; of several writes the
        least counts, as tiles are only worth while where samples are dense.
        """
        self.series.write.mode(mode).parquet(f"{path}/series")
        interval = self.interval_ms or usual_interval(self.samples)
        if interval:
            self.series.sparkSession.createDataFrame([(interval,)], "interval_ms long").coalesce(1).write.mode(mode).parquet(f"{path}/interval")
        day = F.to_date(F.timestamp_millis("t"))
        dealt = self.samples.select("sid", "t", "v", day.alias("day")).repartition("day", F.pmod("sid", F.lit(16)))
        dealt.sortWithinPartitions("day", "sid", "t").write.mode(mode).partitionBy("day").parquet(f"{path}/samples")

    def between(self, low: int, high: int) -> DataFrame:
        """Samples with low <= t <= high; with day partitions those outside are not read."""
        out = self.samples.filter(F.col("t").between(low, high))
        if self.raw and 0 <= low and high < LAST_MS:
            # a derived time says nothing about the files' own columns: the same bounds on those reach the scan
            stamp = lambda ms: F.lit(str(EPOCH + timedelta(milliseconds=ms))).cast("timestamp_ntz")
            out = out.filter((F.col(self.raw) >= stamp(low)) & (F.col(self.raw) < stamp(high + 1)))
        if self.by_day:
            day = lambda ms: F.to_date(F.timestamp_millis(F.lit(ms)))
            out = out.filter(F.col("day").between(day(low), day(high)))
        return out.select("sid", "t", "v")

    def union(self, other: Store) -> Store:
        series = self.series.unionByName(other.series).dropDuplicates(["sid"])
        columns = ["sid", "t", "v"] + (["day"] if self.by_day and other.by_day else []) + ([self.raw] if self.raw and self.raw == other.raw else [])
        interval = self.interval_ms if self.interval_ms == other.interval_ms else None
        samples = self.samples.select(*columns).unionByName(other.samples.select(*columns))
        return Store(series, samples, interval, "day" in columns, self.raw if self.raw in columns else None)


def estimated_bytes(frame: DataFrame) -> int | None:
    """What the optimizer takes ``frame`` to have, of its inputs at most (joins multiply); None where it knows nothing."""
    plan = frame._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(x.stats().sizeInBytes()) for x in (leaves.apply(i) for i in range(leaves.size()))]
    unknown = frame.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    return None if any(s >= unknown for s in sizes) else min(sum(sizes), int(plan.stats().sizeInBytes()))


def usual_interval(samples: DataFrame) -> int | None:
    """The mean time between the samples of a series, over all series; None if none has two."""
    by_series = samples.groupBy("sid").agg((F.max("t") - F.min("t")).alias("span"), (F.count(F.lit(1)) - 1).alias("gaps"))
    span, gaps = by_series.agg(F.sum("span"), F.sum("gaps")).first()
    return max(1, int(span // gaps)) if gaps and span else None


def keep_first(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Of samples (sid, t, v, arrival) with one series and time, the one that came first."""
    nth = F.row_number().over(Window.partitionBy("sid", "t").orderBy(arrival))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def retain(store: Store, from_ms: int) -> Store:
    """Samples from ``from_ms`` on, and the series that still have one."""
    samples = store.samples.filter(F.col("t") >= from_ms)
    return replace(store, series=store.series.join(samples.select("sid").distinct(), "sid", "left_semi"), samples=samples)


def cap_series(known: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (sid, ...) if their new series fit under ``limit`` beside ``known`` (sid); else no row: all or none."""
    fresh = rows.select("sid").distinct().join(known.select("sid"), "sid", "left_anti")
    total = known.select("sid").distinct().agg(F.count(F.lit(1)).alias("a")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("b")))
    fits = total.select((F.col("a") + F.col("b") <= limit).alias("fits"))
    return rows.crossJoin(F.broadcast(fits)).filter("fits").drop("fits")
