"""Retention: what is older than a bound leaves the disk, a day at a time."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..store import DAY_MS, EPOCH


def enforce(spark: SparkSession, path: str, from_ms: int) -> int:
    """Deletes the days of a written store that end before ``from_ms``, and series without samples; how many days went.

    Whole partitions go, so nothing is rewritten but the dimension of series. Older samples of the first day
    left are hidden by ``Store.read(spark, path, from_ms)``. Not to be run beside a reader of those days.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{path}/samples")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    gone = []
    for entry in files.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("day=") and name[4:] != "__HIVE_DEFAULT_PARTITION__" and ((date.fromisoformat(name[4:]) - EPOCH.date()).days + 1) * DAY_MS <= from_ms:
            gone.append(entry.getPath())
    for day in gone:
        files.delete(day, True)
    if gone:
        series, following = hadoop.Path(f"{path}/series"), hadoop.Path(f"{path}/_series")
        days_left = any(e.getPath().getName().startswith("day=") for e in files.listStatus(root))
        held = spark.read.parquet(f"{path}/series")
        alive = spark.read.parquet(f"{path}/samples").select("sid").distinct() if days_left else held.select("sid").limit(0)
        held.join(alive, "sid", "left_semi").write.mode("overwrite").parquet(f"{path}/_series")
        files.delete(series, True)
        files.rename(following, series)
        if not days_left:
            files.delete(root, True)
            spark.createDataFrame([], "sid long, t long, v double, day date").write.parquet(f"{path}/samples")
    return len(gone)


class Retention:
    """Enforces a store's retention again and again."""

    def __init__(self, spark: SparkSession, path: str, keep_s: float, every_s: float = 60.0, now: Callable[[], float] = time.time):
        self.spark, self.path, self.keep_s, self.every_s, self.now = spark, path, keep_s, every_s, now
        self._ended, self._thread = threading.Event(), threading.Thread(target=self._loop, daemon=True)

    def bound(self) -> int:
        return int((self.now() - self.keep_s) * 1000)

    def _loop(self) -> None:
        while not self._ended.wait(self.every_s):
            enforce(self.spark, self.path, self.bound())

    def start(self) -> None:
        self._thread.start()

    def stop(self) -> None:
        self._ended.set()
        self._thread.join()
