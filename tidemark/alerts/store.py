"""Rules, data sources, instances and history in a small relational store on the driver."""

from __future__ import annotations

import json
import sqlite3
import threading
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from .datasources import Datasource
from .evaluate import INSTANCES, Rule

VERSION = 2
_TABLES = """
CREATE TABLE IF NOT EXISTS rules (id TEXT PRIMARY KEY, body TEXT NOT NULL);
CREATE TABLE IF NOT EXISTS datasources (id TEXT PRIMARY KEY, name TEXT NOT NULL UNIQUE, body TEXT NOT NULL);
CREATE TABLE IF NOT EXISTS instances (rule_id TEXT, fingerprint TEXT, labels TEXT, state TEXT, value REAL, active_ms INTEGER, started_ms INTEGER, updated_ms INTEGER, PRIMARY KEY (rule_id, fingerprint));
CREATE TABLE IF NOT EXISTS history (id INTEGER PRIMARY KEY AUTOINCREMENT, rule_id TEXT, fingerprint TEXT, labels TEXT, before TEXT, state TEXT, value REAL, at_ms INTEGER);
"""
PAGE = 200


class Missing(LookupError):
    """There is no row of that id."""


class AlertStore:
    def __init__(self, path: str = ":memory:"):
        self._db = sqlite3.connect(path, check_same_thread=False)
        self._lock = threading.Lock()
        (found,) = self._db.execute("PRAGMA user_version").fetchone()
        if found not in (0, VERSION):
            raise ValueError(f"{path} has version {found}, not {VERSION}")
        self._db.executescript(_TABLES)
        self._db.execute(f"PRAGMA user_version = {VERSION}")

    def _run(self, sql: str, *args) -> list[tuple]:
        with self._lock, self._db:
            return self._db.execute(sql, args).fetchall()

    # ---- rules ----

    def save_rule(self, rule: Rule) -> None:
        self._run("INSERT INTO rules VALUES (?, ?) ON CONFLICT (id) DO UPDATE SET body = excluded.body", rule.id, json.dumps(asdict(rule)))

    def rules(self) -> list[Rule]:
        return [Rule(**json.loads(body)) for (body,) in self._run("SELECT body FROM rules ORDER BY id")]

    def rule(self, rule_id: str) -> Rule:
        found = self._run("SELECT body FROM rules WHERE id = ?", rule_id)
        if not found:
            raise Missing(f"no rule {rule_id!r}")
        return Rule(**json.loads(found[0][0]))

    def delete_rule(self, rule_id: str) -> None:
        """Its instances go with it; its history stays."""
        with self._lock, self._db:
            self._db.execute("DELETE FROM instances WHERE rule_id = ?", (rule_id,))
            self._db.execute("DELETE FROM rules WHERE id = ?", (rule_id,))

    # ---- data sources ----

    def save_datasource(self, source: Datasource) -> None:
        try:
            self._run("INSERT INTO datasources VALUES (?, ?, ?) ON CONFLICT (id) DO UPDATE SET name = excluded.name, body = excluded.body", source.id, source.name, json.dumps(asdict(source)))
        except sqlite3.IntegrityError:
            raise ValueError(f"a datasource named {source.name!r} exists") from None

    def datasources(self) -> list[Datasource]:
        return [Datasource(**json.loads(b)) for (b,) in self._run("SELECT body FROM datasources ORDER BY name")]

    def datasource(self, source_id: str) -> Datasource:
        found = self._run("SELECT body FROM datasources WHERE id = ?", source_id)
        if not found:
            raise Missing(f"no datasource {source_id!r}")
        return Datasource(**json.loads(found[0][0]))

    def delete_datasource(self, source_id: str) -> None:
        self._run("DELETE FROM datasources WHERE id = ?", source_id)

    # ---- instances and history ----

    def instances(self, spark: SparkSession) -> DataFrame:
        rows = self._run("SELECT rule_id, fingerprint, labels, state, value, active_ms, started_ms FROM instances")
        return spark.createDataFrame([(r, f, json.loads(x), *rest) for r, f, x, *rest in rows], INSTANCES)

    def active(self, rule_id: str | None = None) -> list[dict]:
        """Pending and firing instances by the time they began."""
        where, args = ("WHERE rule_id = ?", (rule_id,)) if rule_id is not None else ("", ())
        names = ("rule_id", "fingerprint", "labels", "status", "current_value", "active_ms", "started_ms", "updated_ms")
        rows = self._run(f"SELECT rule_id, fingerprint, labels, state, value, active_ms, started_ms, updated_ms FROM instances {where} ORDER BY started_ms, rule_id, fingerprint", *args)
        return [dict(zip(names, (r, f, json.loads(x), *rest), strict=True)) for r, f, x, *rest in rows]

    def apply(self, rule_id: str, instances: DataFrame, history: DataFrame, now_ms: int = 0) -> None:
        """Replaces a rule's instances and adds history, in one transaction. Both are bounded by the instance cap."""
        kept = [(r.rule_id, r.fingerprint, json.dumps(r.labels), r.state, r.value, r.active_ms, r.started_ms, now_ms) for r in instances.filter(instances["rule_id"] == rule_id).collect()]
        told = [(r.rule_id, r.fingerprint, json.dumps(r.labels), r.before, r.state, r.value, r.at_ms) for r in history.collect()]
        with self._lock, self._db:
            self._db.execute("DELETE FROM instances WHERE rule_id = ?", (rule_id,))
            self._db.executemany("INSERT INTO instances VALUES (?, ?, ?, ?, ?, ?, ?, ?)", kept)
            self._db.executemany("INSERT INTO history (rule_id, fingerprint, labels, before, state, value, at_ms) VALUES (?, ?, ?, ?, ?, ?, ?)", told)

    def history(self, since: int = 0, rule_id: str | None = None, limit: int = PAGE) -> list[tuple]:
        where = "id > ?" + (" AND rule_id = ?" if rule_id is not None else "")
        args = (since, *([rule_id] if rule_id is not None else []), limit)
        return self._run(f"SELECT id, rule_id, fingerprint, labels, before, state, value, at_ms FROM history WHERE {where} ORDER BY id LIMIT ?", *args)
