"""Pushed requests, one by one: checked, appended whole or not at all, and counted by source."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import push
from . import ingest


class Rejected(Exception):
    """A request that was not taken: the HTTP status that says why, and the reason."""

    def __init__(self, status: int, reason: str):
        super().__init__(reason)
        self.status = status


class PushGate:
    """Requests of the push route; for bulk loads use the plans in ``sources.push`` over a table of bodies."""

    def __init__(self, spark: SparkSession, path: str, token: str = "", sample_limit: int = 0, max_body: int = push.MAX_BODY, max_series: int = 1_000_000, now: Callable[[], float] = time.time):
        self.spark, self.path, self.token = spark, path, token
        self.sample_limit, self.max_body, self.max_series, self.now = sample_limit, max_body, max_series, now
        self.counts: Counter = Counter()
        self._sources: dict[tuple[str, str], dict] = {}
        self._turn = threading.Lock()  # one append at a time

    def _noted(self, job: str, instance: str, at: float, error: str, taken: int = 0) -> None:
        source = self._sources.setdefault((job, instance), {"job": job, "instance": instance, "pushesTotal": 0, "samplesTotal": 0, "lastSamples": 0})
        source |= {"lastPush": at, "lastError": error, "pushesTotal": source["pushesTotal"] + 1}
        if not error:
            source |= {"samplesTotal": source["samplesTotal"] + taken, "lastSamples": taken}

    def _refuse(self, status: int, reason: str) -> Rejected:
        self.counts['push_requests_total{status="error"}'] += 1
        return Rejected(status, reason)

    def take(self, body: str, remote_host: str) -> dict[str, int]:
        """How many samples and series were taken; raises Rejected."""
        if len(body.encode()) > self.max_body:
            raise self._refuse(413, "request body too large")
        at = self.now()
        requests = self.spark.createDataFrame([(0, body, remote_host, int(at * 1000))], "request_id long, body string, remote_host string, received_ms long")
        rows = push.samples(requests, self.sample_limit)
        job = F.col("r.job")
        instance = F.coalesce(F.nullif(F.col("r.instance"), F.lit("")), F.col("remote_host"))
        seen = push.parsed(requests, self.sample_limit).select("error", job.alias("job"), instance.alias("instance"), F.size("r.series").alias("series")).first()
        if seen.error:
            # other malformed requests may name any job: they would fill the table of sources
            if seen.error == push.TOO_MANY:
                self._noted(seen.job, seen.instance, at, seen.error)
            raise self._refuse(400, seen.error)
        with self._turn:
            taken = rows.count()
            if not ingest.append(rows.select("labels", "t", "v", F.col("nth").alias("arrival")), self.path, self.max_series):
                self.counts["push_series_rejected_total"] += 1
                self._noted(seen.job, seen.instance, at, "too many series")
                raise self._refuse(503, "too many series")
            self._noted(seen.job, seen.instance, at, "", taken)
        self.counts['push_requests_total{status="success"}'] += 1
        self.counts["push_samples_appended_total"] += taken
        return {"samplesAppended": taken, "seriesTouched": seen.series}

    def sources(self) -> list[dict]:
        """Who has pushed, by job and instance."""
        return [self._sources[k] for k in sorted(self._sources)]
