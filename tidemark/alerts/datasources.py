"""Data sources of alert rules: this engine, or a remote one that speaks the query API."""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.exposition import parse_float

BUILTIN, CONFIG, API = "builtin", "config", "api"
AUTH_TYPES = ("none", "bearer", "basic")
MAX_BODY = 8 << 20
TIMEOUT_MS = 30_000
#: A query that every healthy source answers.
PROBE = "vector(1)"


@dataclass
class Datasource:
    id: str
    name: str
    base_url: str = ""
    type: str = "prometheus"
    auth_type: str = "none"
    credentials: str = ""
    basic_user: str = ""
    basic_pass: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    timeout_ms: int = 0
    enabled: bool = True
    source: str = API
    created_ms: int = 0
    updated_ms: int = 0

    @property
    def editable(self) -> bool:
        """Those of the configuration and of the process itself are not changed through the API."""
        return self.source == API

    def shown(self) -> dict:
        """Without secrets, which are only ever written."""
        return {k: v for k, v in asdict(self).items() if k not in ("credentials", "basic_pass")}

    def problem(self) -> str | None:
        """What keeps it from being saved."""
        if not self.name.strip():
            return "name is needed"
        if not self.base_url.strip():
            return "base_url is needed"
        try:
            parts = urllib.parse.urlsplit(self.base_url.strip())
        except ValueError:
            return "base_url is not a URL"
        if parts.scheme not in ("http", "https"):
            return "base_url must be an http or https URL"
        if parts.username is not None or parts.password is not None:
            return "base_url must not hold credentials"
        if self.auth_type not in AUTH_TYPES:
            return f"auth_type must be one of {', '.join(AUTH_TYPES)}"
        return None


class RemoteError(OSError):
    """A remote source did not answer as it should."""


def _value(v: object) -> float:
    return parse_float(v) if isinstance(v, str) else float(v)


def decoded(answer: dict) -> list[tuple[dict[str, str], float]]:
    """(labels, value) of an answer's vector or scalar; raises ValueError for other kinds."""
    if answer.get("status") != "success":
        raise ValueError(f"query error: {answer.get('error') or 'the source reports an error'}")
    data = answer.get("data") or {}
    kind, result = data.get("resultType"), data.get("result")
    if kind == "vector":
        return [(dict(e.get("metric") or {}), _value(e["value"][1])) for e in result or []]
    if kind == "scalar":
        return [({}, _value(result[1]))]
    raise ValueError(f"a rule needs a scalar or an instant vector, not {kind!r}")


@dataclass
class Remote:
    """A source over HTTP: instant queries, posted as a form."""

    spark: SparkSession
    datasource: Datasource

    def fetch(self, query: str, now_ms: int) -> list[tuple[dict[str, str], float]]:
        ds = self.datasource
        headers = {"Content-Type": "application/x-www-form-urlencoded", "Accept": "application/json", **ds.headers}
        if ds.auth_type == "bearer" and ds.credentials:
            headers["Authorization"] = f"Bearer {ds.credentials}"
        elif ds.auth_type == "basic":
            headers["Authorization"] = "Basic " + base64.b64encode(f"{ds.basic_user}:{ds.basic_pass}".encode()).decode()
        form = urllib.parse.urlencode({"query": query, "time": repr(now_ms / 1000)}).encode()
        request = urllib.request.Request(ds.base_url.rstrip("/") + "/api/v1/query", form, headers)
        try:
            with urllib.request.urlopen(request, timeout=(ds.timeout_ms if ds.timeout_ms > 0 else TIMEOUT_MS) / 1000) as reply:
                body = reply.read(MAX_BODY + 1)
        except urllib.error.HTTPError as error:
            reason = {401: "unauthorized", 403: "forbidden"}.get(error.code, "status")
            raise RemoteError(f"{reason} {error.code}: {error.read(200).decode('utf-8', 'replace')}") from None
        if len(body) > MAX_BODY:
            raise RemoteError("the answer is too large")
        try:
            return decoded(json.loads(body))
        except (KeyError, IndexError, TypeError, AttributeError, json.JSONDecodeError) as error:
            raise ValueError(f"malformed answer: {error}") from None

    def rows(self, query: str, now_ms: int) -> DataFrame:
        return self.spark.createDataFrame(self.fetch(query, now_ms), "labels map<string,string>, v double")
