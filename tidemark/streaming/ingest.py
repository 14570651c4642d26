"""Continuous ingestion: a stream of samples appended to a store, first value kept for each time.

Within the watermark Spark drops repeats by itself; what it no longer remembers is checked against
the store, so a repeat that comes late, or in another batch, is left out as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import labels as L
from ..store import Store, cap_series, keep_first, series_id

#: No more rows than about so many are sorted by one task when a batch is appended.
TASK_ROWS = 1 << 20


def _existing(spark, path: str) -> Store | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/samples")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return Store.read(spark, path) if files.exists(where) else None


def told_apart(keyed: DataFrame, series: DataFrame | None) -> None:
    """Raises ValueError if two label texts have one id: the text is the identity of a series, the hash only stands for it."""
    texts = keyed.select("sid", "key") if series is None else keyed.unionByName(series.select("sid", "key"))
    clash = texts.groupBy("sid").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a <> b").first()
    if clash is not None:
        raise ValueError(f"series {clash.a} and {clash.b} have one id")


def append(rows: DataFrame, path: str, max_series: int = 1_000_000) -> bool:
    """Appends a batch (labels, t, v, arrival) as a whole, or nothing if its new series exceed the cap.

    The batch is kept while it is checked and written: of a stream, each pass would work out its state again. What is
    kept stays in its partitions, so there are no more of them than its rows or the cores need.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    keyed = rows.withColumn("key", L.text_of(F.col("labels"))).withColumn("sid", series_id(F.col("key"))).coalesce(2 * cores).persist()
    try:
        low, high, n = keyed.agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
        parts = max(2 * cores, -(-n // TASK_ROWS))
        first = keep_first(keyed.select("sid", "t", "v", "arrival").repartition(parts, "sid", "t")).drop("arrival")
        return _append(keyed, first, low, high, path, max_series)
    finally:
        keyed.unpersist()


def _append(keyed: DataFrame, first: DataFrame, low: int | None, high: int | None, path: str, max_series: int) -> bool:
    spark, known = keyed.sparkSession, _existing(keyed.sparkSession, path)
    if known is not None:
        if low is None:
            return True
        first = first.join(known.between(low, high).select("sid", "t"), ["sid", "t"], "left_anti")
    told_apart(keyed.select("sid", "key"), known.series if known is not None else None)
    held = known.series.select("sid") if known is not None else spark.createDataFrame([], "sid long")
    # a series that the store does not know has no sample there: all of its samples are new
    series = keyed.select("sid", "labels", "key").dropDuplicates(["sid"]).join(held, "sid", "left_anti")
    first = first.persist()
    try:
        if not first.isEmpty() and not cap_series(held, first, max_series).limit(1).count():
            return False
        Store(series, first).write(path)
        return True
    finally:
        first.unpersist()


def start(stream: DataFrame, path: str, checkpoint: str, delay: str = "6 hours", max_series: int = 1_000_000, once: bool = False) -> StreamingQuery:
    """Feeds a stream (labels, t, v) into the store at ``path``; rejected batches are left out whole.

    ``delay`` is how late a sample may be: as long as the store keeps samples, so that none is late before it is too old.
    """
    timed = stream.withColumn("key", L.text_of(F.col("labels"))).withColumn("ts", F.timestamp_millis("t"))
    fresh = timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["key", "t"]).select("labels", "t", "v")

    adaptive = stream.sparkSession.conf.get("spark.sql.adaptive.enabled")

    def batch(df: DataFrame, number: int) -> None:
        # a stream's session plans for as many partitions as its state has; the batch is out of it and can have fewer
        conf = df.sparkSession.conf
        before = conf.get("spark.sql.adaptive.enabled")
        conf.set("spark.sql.adaptive.enabled", adaptive)
        try:
            append(df.withColumn("arrival", F.monotonically_increasing_id()), path, max_series)
        finally:
            conf.set("spark.sql.adaptive.enabled", before)

    writer = fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="15 seconds")).start()
