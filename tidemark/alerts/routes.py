"""Routes of rules, alerts and data sources: JSON in, JSON out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, replace

from .datasources import API, Datasource
from .evaluate import Rule
from .service import AlertService, Failed
from .store import PAGE, Missing

MAX_BODY = 1 << 20
_RULE = {"name": str, "description": str, "datasource_id": str, "promql": str, "evaluation_interval_seconds": (int, float), "for_duration_seconds": (int, float), "severity": str, "labels": dict, "annotations": dict, "enabled": bool}
_SOURCE = {"name": str, "type": str, "base_url": str, "auth_type": str, "credentials": str, "basic_user": str, "basic_pass": str, "headers": dict, "timeout_ms": int, "enabled": bool}


class Refused(Exception):
    """An answer other than success: status, kind of error, text."""

    def __init__(self, status: int, kind: str, text: str):
        super().__init__(text)
        self.status, self.kind = status, kind


def _body(text: str, fields: dict) -> dict:
    """A JSON object with known fields of the right types; null is as good as absent."""
    if len(text.encode()) > MAX_BODY:
        raise Refused(400, "bad_data", "the body is too large")
    try:
        got = json.loads(text)
    except json.JSONDecodeError as error:
        raise Refused(400, "bad_data", f"invalid JSON body: {error}") from None
    if not isinstance(got, dict):
        raise Refused(400, "bad_data", "invalid JSON body: not an object")
    for name, value in got.items():
        if name not in fields:
            raise Refused(400, "bad_data", f"invalid JSON body: unknown field {name!r}")
        if value is not None and (not isinstance(value, fields[name]) or isinstance(value, bool) != (fields[name] is bool)):
            raise Refused(400, "bad_data", f"invalid JSON body: wrong type of {name!r}")
    return {k: v for k, v in got.items() if v is not None}


def _whole(text: str, least: int) -> int:
    return int(text) if re.fullmatch(r"\d{1,18}", text) and int(text) >= least else least


def shown_rule(rule: Rule) -> dict:
    out = asdict(rule)
    return {"datasource_id": out.pop("datasource"), "promql": out.pop("query"), "evaluation_interval_seconds": out.pop("interval_s"), "for_duration_seconds": out.pop("for_s"), **out}


def _shown_history(row: tuple) -> dict:
    names = ("id", "rule_id", "fingerprint", "labels", "previous_state", "new_state", "value", "timestamp_ms")
    return {**dict(zip(names, row, strict=True)), "labels": json.loads(row[3])}


class AlertRoutes:
    """``handle`` gives status and data, None for a path of others; raises Refused."""

    def __init__(self, service: AlertService):
        self.service, self.store = service, service.store
        one = r"([^/]+)"
        self._routes: list[tuple[str, str, Callable]] = [
            ("GET", r"/api/v1/alerts", self._rules),
            ("POST", r"/api/v1/alerts", self._create_rule),
            ("GET", r"/api/v1/alerts/active", lambda args, body: (200, self.store.active())),
            ("GET", r"/api/v1/alerts/history", self._history),
            ("GET", r"/api/v1/alerts/events", lambda args, body: self._history({**args, "rule_id": ""}, body)),
            ("POST", r"/api/v1/alerts/evaluate", lambda args, body: (200, {"evaluated": self.service.evaluate_all()})),
            ("GET", rf"/api/v1/alerts/{one}", self._rule),
            ("PUT", rf"/api/v1/alerts/{one}", self._update_rule),
            ("DELETE", rf"/api/v1/alerts/{one}", self._delete_rule),
            ("POST", rf"/api/v1/alerts/{one}/enable", lambda args, body, i: self._enable(i, True)),
            ("POST", rf"/api/v1/alerts/{one}/disable", lambda args, body, i: self._enable(i, False)),
            ("POST", rf"/api/v1/alerts/{one}/evaluate", self._evaluate),
            ("GET", r"/api/v1/datasources", lambda args, body: (200, [d.shown() for d in self.store.datasources()])),
            ("POST", r"/api/v1/datasources", self._create_source),
            ("GET", rf"/api/v1/datasources/{one}", lambda args, body, i: (200, self.store.datasource(i).shown())),
            ("PUT", rf"/api/v1/datasources/{one}", self._update_source),
            ("DELETE", rf"/api/v1/datasources/{one}", self._delete_source),
            ("POST", rf"/api/v1/datasources/{one}/test", self._test_source),
        ]

    def handle(self, method: str, path: str, args: dict[str, str], body: str) -> tuple[int, object] | None:
        for verb, pattern, run in self._routes:
            found = re.fullmatch(pattern, path) if verb == method else None
            if found:
                try:
                    return run(args, body, *found.groups())
                except Missing as error:
                    raise Refused(404, "not_found", str(error)) from None
        return None

    # ---- rules ----

    def _rules(self, args: dict[str, str], body: str) -> tuple[int, object]:
        return 200, [shown_rule(r) for r in self.store.rules()]

    def _rule(self, args: dict[str, str], body: str, rule_id: str) -> tuple[int, object]:
        return 200, {"rule": shown_rule(self.store.rule(rule_id)), "instances": self.store.active(rule_id)}

    def _said(self, body: str) -> dict:
        """The fields of a rule that a body names or implies, checked."""
        got = _body(body, _RULE)
        said = {
            "name": got.get("name", "").strip(), "query": got.get("promql", "").strip(), "severity": got.get("severity", "").strip(),
            "interval_s": got.get("evaluation_interval_seconds", 0), "for_s": got.get("for_duration_seconds", 0),
            "datasource": got.get("datasource_id") or "builtin", "description": got.get("description", ""),
            "labels": got.get("labels", {}), "annotations": got.get("annotations", {}),
        }
        problems = Rule("", **said).problems({d.id for d in self.store.datasources()})
        if problems:
            raise Refused(400, "bad_data", problems[0])
        return said | ({"enabled": got["enabled"]} if "enabled" in got else {})

    def _saved(self, rule: Rule, status: int = 200) -> tuple[int, object]:
        self.store.save_rule(rule)
        self.service.changed()
        return status, shown_rule(rule)

    def _create_rule(self, args: dict[str, str], body: str) -> tuple[int, object]:
        said, now = self._said(body), self.service.now_ms()
        return self._saved(Rule(self.service.new_id(), **said, created_ms=now, updated_ms=now), 201)

    def _update_rule(self, args: dict[str, str], body: str, rule_id: str) -> tuple[int, object]:
        before = self.store.rule(rule_id)
        return self._saved(replace(before, **self._said(body), updated_ms=self.service.now_ms()))

    def _delete_rule(self, args: dict[str, str], body: str, rule_id: str) -> tuple[int, object]:
        self.store.rule(rule_id)
        self.store.delete_rule(rule_id)
        self.service.changed()
        return 200, {"status": "deleted"}

    def _enable(self, rule_id: str, enabled: bool) -> tuple[int, object]:
        return self._saved(replace(self.store.rule(rule_id), enabled=enabled, updated_ms=self.service.now_ms()))

    def _evaluate(self, args: dict[str, str], body: str, rule_id: str) -> tuple[int, object]:
        try:
            return 200, self.service.evaluate(rule_id)
        except Failed as error:
            raise Refused(502, "evaluation_failed", str(error)) from None

    def _history(self, args: dict[str, str], body: str) -> tuple[int, object]:
        rows = self.store.history(_whole(args.get("since", ""), 0), args.get("rule_id") or None, _whole(args.get("limit", ""), 1) if args.get("limit") else PAGE)
        return 200, [_shown_history(r) for r in rows]

    # ---- data sources ----

    def _create_source(self, args: dict[str, str], body: str) -> tuple[int, object]:
        now = self.service.now_ms()
        return self._save_source(Datasource(self.service.new_id(), **{"name": "", **_body(body, _SOURCE)}, source=API, created_ms=now, updated_ms=now), 201)

    def _save_source(self, source: Datasource, status: int) -> tuple[int, object]:
        source = replace(source, name=source.name.strip(), base_url=source.base_url.strip(), type=source.type.strip() or "prometheus", auth_type=source.auth_type or "none")
        problem = source.problem()
        if problem:
            raise Refused(400, "bad_data", problem)
        try:
            self.store.save_datasource(source)
        except ValueError as error:
            raise Refused(409, "conflict", str(error)) from None
        return status, source.shown()

    def _editable(self, source_id: str) -> Datasource:
        found = self.store.datasource(source_id)
        if not found.editable:
            raise Refused(409, "read_only", "the datasource belongs to the configuration")
        return found

    def _update_source(self, args: dict[str, str], body: str, source_id: str) -> tuple[int, object]:
        before, got = self._editable(source_id), _body(body, _SOURCE)
        # a secret that is not given stays; everything else is replaced
        blank = {"name": "", "type": "", "base_url": "", "auth_type": "", "basic_user": "", "headers": {}, "timeout_ms": 0}
        secrets = {k: got.pop(k) for k in ("credentials", "basic_pass") if k in got}
        return self._save_source(replace(before, **{**blank, **got}, **{k: v for k, v in secrets.items() if v}, updated_ms=self.service.now_ms()), 200)

    def _delete_source(self, args: dict[str, str], body: str, source_id: str) -> tuple[int, object]:
        self.store.delete_datasource(self._editable(source_id).id)
        return 200, {"status": "deleted"}

    def _test_source(self, args: dict[str, str], body: str, source_id: str) -> tuple[int, object]:
        try:
            self.service.probe(self.store.datasource(source_id))
        except (OSError, ValueError) as error:
            raise Refused(502, "datasource_unreachable", str(error)) from None
        return 200, {"status": "ok"}
