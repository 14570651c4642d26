"""A server from a configuration: scraping, push, retention, alerts and the query API over one written store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from .alerts.datasources import CONFIG, Datasource
from .alerts.notify import Dispatcher, post
from .alerts.service import AlertService
from .alerts.store import AlertStore
from .api.http import Api, serve
from .config import Config, Remote
from .engine import Engine
from .sources.scrape import Auth, Target
from .store import Store
from .streaming.gate import PushGate
from .streaming.retention import Retention
from .streaming.scraper import Scraper


class LiveEngine(Engine):
    """An engine over a written store that grows: every query sees the files that are there when it begins."""

    def __init__(self, spark: SparkSession, path: str, retention: Retention | None = None):
        self.path, self.retention = path, retention
        super().__init__(_read(spark, path, None))

    def instant(self, query: str, ts: int):
        return self._now().instant(query, ts)

    def range_frame(self, query: str, start: int, end: int, step: int):
        return self._now().range_frame(query, start, end, step)

    def series(self, selectors: list[str], start: int, end: int):
        return self._now().series(selectors, start, end)

    def label_names(self, selectors: list[str] | None = None):
        return self._now().label_names(selectors)

    def label_values(self, name: str, selectors: list[str] | None = None):
        return self._now().label_values(name, selectors)

    def _now(self) -> Engine:
        self.store = _read(self.spark, self.path, self.retention.bound() if self.retention else None)
        return Engine(self.store, self.lookback_ms)


def _read(spark: SparkSession, path: str, from_ms: int | None) -> Store:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/samples")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return Store.read(spark, path, from_ms)
    return Store.of_rows(spark.createDataFrame([], "labels map<string,string>, t long, v double"))


@dataclass
class Server:
    api: Api
    retention: Retention
    listen: str

    def start(self) -> None:
        self.retention.start()
        for part in (self.api.scraper, self.api.alerts):
            if part is not None:
                part.start()

    def serve_forever(self) -> None:
        host, _, port = self.listen.rpartition(":")
        serve(self.api, host or "0.0.0.0", int(port)).serve_forever()  # noqa: S104  an empty host is said on purpose

    def stop(self) -> None:
        for part in (self.api.scraper, self.api.alerts, self.retention):
            if part is not None:
                part.stop()


def _targets(config: Config) -> list[tuple[Target, float]]:
    out = []
    for job in config.scrape_configs:
        tls, a, b = job.tls_config, job.authorization, job.basic_auth
        auth = Auth(
            bearer=a.credentials if a else "", user=b.username if b else "", password=b.password if b else "",
            ca_file=tls.ca_file if tls else "", cert_file=tls.cert_file if tls else "", key_file=tls.key_file if tls else "", insecure=bool(tls and tls.insecure_skip_verify),
        )
        out += [(Target.of(job.job_name, t, job.scheme or "http", timeout_s=float(job.scrape_timeout), auth=auth), float(job.scrape_interval)) for t in job.targets()]
    return out


def _datasource(remote: Remote) -> Datasource:
    a, b = remote.authorization, remote.basic_auth
    return Datasource(
        f"config-{remote.name}", remote.name, remote.url, remote.type, "bearer" if a else "basic" if b else "none", a.credentials if a else "", b.username if b else "", b.password if b else "",
        remote.headers, int(remote.timeout * 1000), remote.enabled, CONFIG,
    )


def assemble(spark: SparkSession, config: Config, version: str = "2.0.0") -> Server:
    """The parts that a configuration names, not started."""
    path = config.storage.path
    if not path:
        raise ValueError("storage.path is needed: samples are kept in files that all executors reach")
    retention = Retention(spark, path, float(config.storage.retention))
    engine = LiveEngine(spark, path, retention)
    push, alerting = config.push, config.alerting
    gate = PushGate(spark, path, push.auth_token, push.sample_limit, push.max_body_bytes) if push.enabled else None
    alerts = None
    if alerting.enabled:
        notify = alerting.notify
        sender = Dispatcher(post(notify.url, float(notify.timeout), notify.token), notify.queue_size, notify.max_retries) if notify.enabled else None
        alerts = AlertService(engine, AlertStore(alerting.storage_path or ":memory:"), sender, notify.min_severity or "debug")
        for remote in alerting.datasources:
            alerts.store.save_datasource(_datasource(remote))
    scraper = Scraper(spark, path, _targets(config))
    return Server(Api(engine, version, gate=gate, scraper=scraper, alerts=alerts), retention, config.web.listen)
