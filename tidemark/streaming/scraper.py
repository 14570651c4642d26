"""Continuous scraping: targets are fetched at their intervals, and what they say goes into a store."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..lang.tree import NAME
from ..sources.scrape import COUNT, DURATION, UP, Target, fetch, scrape_all
from . import ingest


class Scraper:
    """Fetches on the executors, one round of all targets of an interval at a time."""

    def __init__(self, spark: SparkSession, path: str, targets: list[tuple[Target, float]], get: Callable[[Target], str] = fetch, max_series: int = 1_000_000, now: Callable[[], float] = time.time):
        self.spark, self.path, self.get, self.max_series, self.now = spark, path, get, max_series, now
        self._rounds: dict[float, list[Target]] = {}
        for target, interval_s in targets:
            self._rounds.setdefault(interval_s, []).append(target)
        self._health: dict[tuple[str, str], dict] = {}
        self._turn, self._ended, self._threads = threading.Lock(), threading.Event(), []

    def once(self, targets: list[Target]) -> None:
        """One round: fetched once, written aside, and appended; a target whose new series do not fit is down."""
        at = int(self.now() * 1000)
        aside = f"{self.path}/_scraped/{uuid.uuid4().hex}"
        scrape_all(self.spark, targets, self.get, at).write.parquet(aside)
        rows = self.spark.read.parquet(aside)
        own = F.element_at("labels", F.lit(NAME)).isin(UP, DURATION, COUNT)
        told = {r.target: r for r in rows.groupBy("target").agg(
            F.max("error").alias("error"),
            *[F.max(F.when(F.element_at("labels", F.lit(NAME)) == name, F.col("v"))).alias(name) for name in (UP, DURATION, COUNT)],
        ).collect()}
        with self._turn:
            errors = {}
            if not self._append(rows.filter("labels is not null")):
                # the round as a whole does not fit: each target by itself
                for i in range(len(targets)):
                    mine = rows.filter((F.col("target") == i) & F.col("labels").isNotNull())
                    if not self._append(mine):
                        errors[i] = "too many series"
                        down = F.when(F.element_at("labels", F.lit(NAME)) == UP, F.lit(0.0)).otherwise(F.col("v"))
                        self._append(mine.filter(own).withColumn("v", down))
        for i, target in enumerate(targets):
            r = told[i]
            self._health[target.job, target.instance] = {
                "job": target.job, "instance": target.instance, "scrapeUrl": target.url, "up": r[UP] == 1.0 and i not in errors, "lastScrape": at / 1000,
                "lastError": errors.get(i) or r.error or "", "lastScrapeDuration": r[DURATION], "samplesScraped": int(r[COUNT]),
            }
        where = self.spark._jvm.org.apache.hadoop.fs.Path(aside)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def _append(self, rows: DataFrame) -> bool:
        return ingest.append(rows.select("labels", "t", "v", F.xxhash64(L.text_of(F.col("labels")), "v").alias("arrival")), self.path, self.max_series)

    def _loop(self, interval_s: float, targets: list[Target]) -> None:
        while not self._ended.is_set():
            began = time.monotonic()
            try:
                self.once(targets)
            except Exception as error:  # a failed round is told in the targets' health, the next one may succeed
                for t in targets:
                    self._health.setdefault((t.job, t.instance), {"job": t.job, "instance": t.instance, "scrapeUrl": t.url})
                    self._health[t.job, t.instance] |= {"up": False, "lastError": str(error)}
            self._ended.wait(max(0.0, interval_s - (time.monotonic() - began)))

    def start(self) -> None:
        for interval_s, targets in self._rounds.items():
            thread = threading.Thread(target=self._loop, args=(interval_s, targets), daemon=True)
            self._threads.append(thread)
            thread.start()

    def stop(self) -> None:
        self._ended.set()
        for thread in self._threads:
            thread.join()

    def targets(self) -> list[dict]:
        """How the last scrape of each target went, by job and instance."""
        return [self._health[k] for k in sorted(self._health)]
