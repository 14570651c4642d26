"""Scraping: targets are fetched on executors, their samples labelled, and their health added as series."""

from __future__ import annotations

import base64
import ssl
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..lang.tree import NAME
from . import exposition

MAX_BODY = 16 << 20
UP, DURATION, COUNT = "up", "scrape_duration_seconds", "scrape_samples_scraped"
SCHEMA = "labels map<string,string>, t long, v double"


@dataclass(frozen=True)
class Auth:
    """Credentials and certificates of a target."""

    bearer: str = ""
    user: str = ""
    password: str = ""
    ca_file: str = ""
    cert_file: str = ""
    key_file: str = ""
    insecure: bool = False


@dataclass(frozen=True)
class Target:
    job: str
    url: str
    instance: str = ""
    labels: dict[str, str] = field(default_factory=dict, hash=False)
    timeout_s: float = 10.0
    sample_limit: int = 0
    auth: Auth = Auth()

    @classmethod
    def of(cls, job: str, address: str, scheme: str = "http", path: str = "/metrics", **more) -> Target:
        """A bare host and port gets a scheme and a path; the instance is the authority."""
        url = address if "://" in address else f"{scheme}://{address}"
        parts = urllib.parse.urlsplit(url)
        return cls(job, urllib.parse.urlunsplit((parts.scheme, parts.netloc, parts.path if parts.path not in ("", "/") else path, parts.query, "")), parts.netloc, **more)


@dataclass
class Health:
    """How the last scrape of a target went."""

    job: str
    instance: str
    up: bool
    error: str = ""
    samples: int = 0
    duration_s: float = 0.0


def fetch(target: Target) -> str:
    """The body of a target; raises OSError or ValueError."""
    headers, auth = {"Accept": "text/plain"}, target.auth
    if auth.bearer:
        headers["Authorization"] = f"Bearer {auth.bearer}"
    elif auth.user:
        headers["Authorization"] = "Basic " + base64.b64encode(f"{auth.user}:{auth.password}".encode()).decode()
    context = None
    if target.url.startswith("https"):
        context = ssl._create_unverified_context() if auth.insecure else ssl.create_default_context(cafile=auth.ca_file or None)
        if auth.cert_file:
            context.load_cert_chain(auth.cert_file, auth.key_file or None)
    with urllib.request.urlopen(urllib.request.Request(target.url, headers=headers), timeout=target.timeout_s, context=context) as reply:
        if reply.status != 200:
            raise ValueError(f"status {reply.status}")
        body = reply.read(MAX_BODY + 1)
    if len(body) > MAX_BODY:
        raise ValueError("body too large")
    return body.decode("utf-8", "replace")


def scrape_once(target: Target, get: Callable[[Target], str] = fetch, now_ms: int | None = None) -> tuple[list[tuple[dict[str, str], int, float]], Health]:
    """Rows (labels, t, v) and health. Times in the body are passed over: all rows have the start's.

    Bad lines are passed over and told of; too many samples, or no reply, leave only the health series.
    """
    began = time.monotonic()
    at = int(time.time() * 1000) if now_ms is None else now_ms
    own = {**target.labels, "job": target.job, "instance": target.instance}
    rows, error, up, count = [], "", True, 0
    try:
        got = exposition.parse(get(target))
        count, error = len(got.samples), got.error or ""
        if target.sample_limit and count > target.sample_limit:
            raise ValueError(f"{count} samples, more than {target.sample_limit}")
        rows = [({**labels, **own}, at, v) for labels, v, _ in got.samples]
    except (OSError, ValueError) as failed:
        rows, up, error = [], False, str(failed)
    took = time.monotonic() - began
    for name, v in ((UP, float(up)), (DURATION, took), (COUNT, float(count))):
        rows.append(({NAME: name, **own}, at, v))
    return rows, Health(target.job, target.instance, up, error, count, took)


def scrape_all(spark: SparkSession, targets: list[Target], get: Callable[[Target], str] = fetch, now_ms: int | None = None) -> DataFrame:
    """(target, labels, t, v, error) of all targets, fetched where the partitions of the target list are.

    One row of each target has no labels: it tells the first error, if there was one. Reading the result
    twice fetches twice; write it first.
    """
    numbered = spark.range(len(targets), numPartitions=max(1, min(len(targets), 64)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in frame["id"]:
                rows, health = scrape_once(targets[i], get, now_ms)
                said = [(i, labels, t, v, None) for labels, t, v in rows] + [(i, None, rows[-1][1], 0.0, health.error)]
                yield pd.DataFrame(said, columns=["target", "labels", "t", "v", "error"])

    return numbered.mapInPandas(run, f"target long, {SCHEMA}, error string")


def scrape(spark: SparkSession, targets: list[Target], get: Callable[[Target], str] = fetch, now_ms: int | None = None) -> DataFrame:
    """(labels, t, v) of all targets."""
    return scrape_all(spark, targets, get, now_ms).filter("labels is not null").select("labels", "t", "v")
