"""A query API over HTTP: JSON envelopes, times in seconds, values as text."""

from __future__ import annotations

import hmac
import json
import math
import re
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from ..alerts.routes import AlertRoutes, Refused
from ..alerts.service import AlertService
from ..engine import Engine
from ..functions.numfmt import format_float
from ..lang.parser import duration_ms
from ..lang.tree import QueryError
from ..streaming.gate import PushGate, Rejected
from ..streaming.scraper import Scraper


#: Answers are built on the driver: a larger one is refused.
MAX_ROWS = 1_000_000
#: No route takes a larger body.
MAX_BODY = 16 << 20
#: Metric, type, and what it tells; names of several series share one entry.
METRICS = {
    "build_info": ("gauge", "The version that runs."),
    "http_requests_total": ("counter", "Requests by handler."),
    "queries_total": ("counter", "Queries evaluated."),
    "query_errors_total": ("counter", "Queries that failed."),
    "push_requests_total": ("counter", "Push requests by status."),
    "push_samples_appended_total": ("counter", "Samples taken from push requests."),
    "push_series_rejected_total": ("counter", "Push requests refused for too many series."),
    "head_series": ("gauge", "Series in the store."),
    "start_time_seconds": ("gauge", "When the process began."),
    "alert_rules_total": ("gauge", "Rules."),
    "alerts_active": ("gauge", "Firing instances."),
    "alerts_pending": ("gauge", "Pending instances."),
    "alert_evaluations_total": ("counter", "Evaluations by result."),
    "alert_evaluation_failures_total": ("counter", "Failed evaluations by reason."),
    "alert_state_transitions_total": ("counter", "State transitions."),
    "alert_evaluation_duration_seconds_sum": ("counter", "Seconds spent in evaluations."),
    "alert_evaluation_duration_seconds_count": ("counter", "Evaluations timed."),
    "alert_scheduler_duration_seconds": ("gauge", "Seconds of the latest evaluation."),
    "alerts_notify_sent_total": ("counter", "Notifications delivered."),
    "alerts_notify_failed_total": ("counter", "Notifications that failed, by reason."),
    "alerts_notify_dropped_total": ("counter", "Notifications dropped unsent, by reason."),
    "alerts_notify_filtered_total": ("counter", "Notifications below the least severity."),
    "alerts_notify_retries_total": ("counter", "Deliveries tried again."),
    "alerts_notify_queue_depth": ("gauge", "Notifications that wait."),
}


class BadRequest(ValueError):
    pass


def _handler(path: str) -> str:
    """The route under which a request is counted: ids and unknown paths make no series of their own."""
    known = re.match(r"/(?:metrics|-/healthy|-/ready|healthz|api/v1/(?:query_range|query|series|labels|label|targets|status|metadata|push/sources|push|alerts|datasources))(?=/|$)", path)
    return known[0] if known else "other"


def _millis(text: str, name: str) -> int:
    try:
        seconds = float(text)
    except ValueError:
        raise BadRequest(f"{name} must be a time in seconds") from None
    if not math.isfinite(seconds):
        raise BadRequest(f"{name} must be finite")
    return int(seconds * 1000)


def _step(text: str) -> int:
    if re.fullmatch(r"(\d+[smhdw])+", text):
        return duration_ms(text)
    return _millis(text, "step")


def _point(t: int, v: float) -> list:
    return [t / 1000, format_float(v)]


class Api:
    """The routes, without the server: ``handle`` gives status, content type and body.

    Push, scrape and alert routes are there if their parts are given.
    """

    def __init__(self, engine: Engine, version: str = "2.0.0", now=time.time, gate: PushGate | None = None, scraper: Scraper | None = None, alerts: AlertService | None = None, max_rows: int = MAX_ROWS):
        self.engine, self.version, self.now, self.max_rows = engine, version, now, max_rows
        self.gate, self.scraper, self.alerts = gate, scraper, alerts
        self.alert_routes = AlertRoutes(alerts) if alerts is not None else None
        self.counts: Counter = Counter()
        self.started = now()

    def handle(self, method: str, path: str, query: str = "", body: str = "", authorization: str = "", remote_host: str = "") -> tuple[int, str, str]:
        self.counts[f'http_requests_total{{handler="{_handler(path)}"}}'] += 1
        if path == "/metrics":
            return (200, "text/plain; version=0.0.4", self.exposition()) if method == "GET" else (405, "text/plain", "method not allowed\n")
        if path in ("/-/healthy", "/-/ready", "/healthz"):
            return (200, "text/plain", "ok\n") if method == "GET" else (405, "text/plain", "method not allowed\n")
        url = parse_qs(query, keep_blank_values=True)
        args = {k: v[0] for k, v in url.items()}
        try:
            if path == "/api/v1/push" and self.gate is not None and method == "POST":
                return self._pushed(body, authorization, remote_host)
            if path == "/api/v1/push/sources" and self.gate is not None and method == "GET":
                return self._json(200, {"status": "success", "data": self.gate.sources()})
            if self.alert_routes is not None:
                told = self.alert_routes.handle(method, path, args, body)
                if told is not None:
                    return self._json(told[0], {"status": "success", "data": told[1]})
            if method in ("GET", "POST"):
                found = self._route(path, args | {k: v[0] for k, v in parse_qs(body).items()} if method == "POST" else args, url.get("match[]", []))
                if found is not None:
                    return self._json(200, {"status": "success", "data": found})
        except (BadRequest, QueryError) as error:
            self.counts["query_errors_total"] += 1
            return self._json(400, {"status": "error", "errorType": "bad_data", "error": str(error)})
        except Refused as error:
            return self._json(error.status, {"status": "error", "errorType": error.kind, "error": str(error)})
        return self._json(404, {"status": "error", "errorType": "not_found", "error": "no such route"})

    def _pushed(self, body: str, authorization: str, remote_host: str) -> tuple[int, str, str]:
        if self.gate.token and not hmac.compare_digest(authorization.encode(), f"Bearer {self.gate.token}".encode()):
            self.gate.counts['push_requests_total{status="error"}'] += 1
            return self._json(401, {"status": "error", "errorType": "unauthorized", "error": "missing or invalid bearer token"})
        try:
            return self._json(200, {"status": "success", "data": self.gate.take(body, remote_host)})
        except Rejected as error:
            return self._json(error.status, {"status": "error", "errorType": "internal" if error.status == 503 else "bad_data", "error": str(error)})

    def _rows(self, frame) -> list:
        rows = frame.limit(self.max_rows + 1).collect()
        if len(rows) > self.max_rows:
            raise BadRequest(f"the answer has more than {self.max_rows} values")
        return rows

    @staticmethod
    def _json(status: int, body: dict) -> tuple[int, str, str]:
        return status, "application/json", json.dumps(body)

    def _route(self, path: str, args: dict[str, str], match: list[str]):
        if path == "/api/v1/query":
            return self._instant(args)
        if path == "/api/v1/query_range":
            return self._range(args)
        if path == "/api/v1/series":
            if not match:
                raise BadRequest("match[] is needed")
            start = _millis(args["start"], "start") if "start" in args else 0
            end = _millis(args["end"], "end") if "end" in args else int((self.now() + 3600) * 1000)
            return [r.labels for r in self._rows(self.engine.series(match, start, end))]
        if path == "/api/v1/labels":
            return [r[0] for r in self._rows(self.engine.label_names(match))]
        values = re.fullmatch(r"/api/v1/label/([^/]+)/values", path)
        if values:
            return [r[0] for r in self._rows(self.engine.label_values(values[1], match))]
        if path == "/api/v1/status/buildinfo":
            return {"version": self.version}
        if path == "/api/v1/metadata":
            return {}
        if path == "/api/v1/targets":
            return self.scraper.targets() if self.scraper is not None else []
        return None

    def _need(self, args: dict[str, str], name: str) -> str:
        if not args.get(name):
            raise BadRequest(f"{name} is needed")
        return args[name]

    def _instant(self, args: dict[str, str]) -> dict:
        self.counts["queries_total"] += 1
        at = _millis(args["time"], "time") if args.get("time") else int(self.now() * 1000)
        got = self.engine.instant(self._need(args, "query"), at)
        if got.kind == "string":
            return {"resultType": "string", "result": got.text}
        rows = self._rows(got.frame)
        if got.kind == "scalar":
            return {"resultType": "scalar", "result": _point(at, rows[0].v)}
        if got.kind == "vector":
            return {"resultType": "vector", "result": [{"metric": r.labels, "value": _point(at, r.v)} for r in rows]}
        return self._matrix(rows)

    def _range(self, args: dict[str, str]) -> dict:
        self.counts["queries_total"] += 1
        start, end = (_millis(self._need(args, n), n) for n in ("start", "end"))
        got = self.engine.range(self._need(args, "query"), start, end, _step(self._need(args, "step")))
        return self._matrix(self._rows(got.frame))

    @staticmethod
    def _matrix(rows) -> dict:
        series: dict[str, dict] = {}
        for r in rows:
            series.setdefault(r.key, {"metric": r.labels, "values": []})["values"].append(_point(r.t, r.v))
        return {"resultType": "matrix", "result": list(series.values())}

    def exposition(self) -> str:
        """Metrics of this process in the text format, each family under its type."""
        values: dict[str, float] = {f'build_info{{version="{self.version}"}}': 1, "queries_total": 0, "query_errors_total": 0, **self.counts, "start_time_seconds": int(self.started)}
        if self.gate is not None:
            values |= {'push_requests_total{status="success"}': 0, 'push_requests_total{status="error"}': 0, "push_samples_appended_total": 0, "push_series_rejected_total": 0, **self.gate.counts}
        values["head_series"] = self.engine.store.series.count()
        if self.alerts is not None:
            values |= self.alerts.exposition()
        lines = []
        for name, (kind, note) in METRICS.items():
            own = sorted((k, v) for k, v in values.items() if k.partition("{")[0] == name)
            lines += [f"# HELP tidemark_{name} {note}", f"# TYPE tidemark_{name} {kind}"] if own else []
            lines += [f"tidemark_{k} {format_float(float(v))}" for k, v in own]
        return "\n".join(lines) + "\n"


def serve(api: Api, host: str = "127.0.0.1", port: int = 9090) -> ThreadingHTTPServer:
    """A server; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            url, length = urlsplit(self.path), int(self.headers.get("Content-Length") or 0)
            if length > MAX_BODY:
                status, kind, body = Api._json(413, {"status": "error", "errorType": "bad_data", "error": "request body too large"})
                self.close_connection = True
            else:
                said = self.rfile.read(length).decode("utf-8", "replace") if length else ""
                status, kind, body = api.handle(self.command, url.path, url.query, said, self.headers.get("Authorization") or "", self.client_address[0])
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_DELETE = _answer  # noqa: N815

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
