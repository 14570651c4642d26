"""Evaluating alert rules: the query's result meets the tracked instances in one full outer join."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import labels as L
from . import state as S

INSTANCE_CAP = 1000
INSTANCES = "rule_id string, fingerprint string, labels map<string,string>, state string, value double, active_ms long, started_ms long"


@dataclass
class Rule:
    id: str
    name: str
    query: str
    severity: str
    interval_s: float = 60.0
    for_s: float = 0.0
    labels: dict[str, str] = field(default_factory=dict)
    datasource: str = ""
    enabled: bool = True
    description: str = ""
    annotations: dict[str, str] = field(default_factory=dict)
    created_ms: int = 0
    updated_ms: int = 0

    def problems(self, datasources: set[str] | None = None) -> list[str]:
        """What keeps the rule from being saved; the query itself is not parsed then."""
        found = [f"{n} is needed" for n in ("name", "query", "severity") if not getattr(self, n)]
        if self.interval_s <= 0:
            found.append("the interval must be positive")
        if self.for_s < 0:
            found.append("for must not be negative")
        if datasources is not None and self.datasource not in datasources:
            found.append("unknown datasource")
        return found


def classify(error: Exception) -> str:
    """The reason under which a failed evaluation is counted."""
    text = str(error).lower()
    if isinstance(error, TimeoutError) or "timed out" in text or "timeout" in text:
        return "timeout"
    for word, reason in (("unauthorized", "auth"), ("forbidden", "auth"), ("status", "http")):
        if word in text:
            return reason
    return "query" if isinstance(error, ValueError) else "invalid"


class Source(Protocol):
    """Where a rule's query is evaluated."""

    def rows(self, query: str, now_ms: int) -> DataFrame:
        """(labels, v) of an instant vector or a scalar; raises ValueError, OSError or a Spark error."""


@dataclass
class Local:
    """The engine of this process."""

    engine: Engine

    def rows(self, query: str, now_ms: int) -> DataFrame:
        result = self.engine.instant(query, now_ms)
        if result.kind == "scalar":
            return result.frame.select(L.empty().alias("labels"), "v")
        if result.kind == "vector":
            return result.frame.select("labels", "v")
        raise ValueError(f"a rule needs a scalar or an instant vector, not a {result.kind}")


def observed(source: Source | Engine, rule: Rule, now_ms: int) -> DataFrame:
    """(fingerprint, labels, value) of the rule's query; of equal label sets the last one counts."""
    rows = (Local(source) if isinstance(source, Engine) else source).rows(rule.query, now_ms)
    labels = L.overlay(F.col("labels"), L.literal(rule.labels)) if rule.labels else F.col("labels")
    keyed = rows.select(labels.alias("labels"), F.col("v").alias("value"), L.text_of(F.col("labels")).alias("okey")).withColumn("fingerprint", F.sha2(L.text_of(F.col("labels")), 256))
    return keyed.groupBy("fingerprint").agg(F.max_by("labels", "okey").alias("labels"), F.max_by("value", "okey").alias("value"))


def transitions(known: DataFrame, seen: DataFrame, rule: Rule, now_ms: int, cap: int | None = INSTANCE_CAP) -> DataFrame:
    """Known instances of a rule and what its query shows, as the instances after it, with ``before`` and ``changed``.

    New instances are taken in order of fingerprint until the known ones, resolved or not, fill the cap;
    the rest have the state null. No cap: all are taken.
    """
    own = known.filter(F.col("rule_id") == rule.id).select("fingerprint", F.col("labels").alias("l0"), F.col("state").alias("before"), F.col("value").alias("v0"), "active_ms", "started_ms")
    both = own.join(seen.withColumn("holds", F.lit(True)), "fingerprint", "full_outer").withColumn("taken", F.lit(True))
    if cap is not None:
        fresh = seen.select("fingerprint").join(own.select("fingerprint"), "fingerprint", "left_anti")
        first = fresh.orderBy("fingerprint").limit(max(0, cap - own.count())).withColumn("taken", F.lit(True))
        both = both.drop("taken").join(F.broadcast(first), "fingerprint", "left")  # no more rows than the cap
    holds, now, for_ms = F.coalesce("holds", F.lit(False)), F.lit(now_ms).cast("long"), F.lit(int(rule.for_s * 1000)).cast("long")
    new = F.col("before").isNull()
    before = F.when(new | (F.col("before") == S.RESOLVED), S.OK).otherwise(F.col("before"))
    active = F.when(before == S.OK, F.when(holds, now)).otherwise(F.col("active_ms"))
    after = S.following(before, holds, active, now, for_ms)
    out = both.select(
        F.lit(rule.id).alias("rule_id"),
        "fingerprint",
        F.coalesce("labels", "l0").alias("labels"),
        F.when(new & F.col("taken").isNull(), F.lit(None)).otherwise(after).alias("state"),
        F.coalesce("value", "v0").alias("value"),
        active.alias("active_ms"),
        F.when(before == S.OK, now).otherwise(F.col("started_ms")).alias("started_ms"),
        before.alias("before"),
    )
    return out.withColumn("changed", F.col("state").isNotNull() & (F.col("state") != F.col("before"))).filter("state is null or not (before = 'ok' and state = 'ok')")


HISTORY = "rule_id string, fingerprint string, labels map<string,string>, before string, state string, value double, at_ms long"
_NAMES = ("rule_id", "fingerprint", "labels", "state", "value", "active_ms", "started_ms")


@dataclass
class Outcome:
    instances: DataFrame
    history: DataFrame
    refused: int = 0
    failure: str | None = None
    error: str = ""


def evaluate(source: Source | Engine, rule: Rule, known: DataFrame, now_ms: int, cap: int = INSTANCE_CAP) -> Outcome:
    """Instances to keep and history rows (see HISTORY); a query that fails, before it runs or in it, changes nothing."""
    spark = known.sparkSession
    try:
        after = transitions(known, observed(source, rule, now_ms), rule, now_ms, cap)
        rows = after.filter("state is not null").collect()  # at most the cap and the known ones
        refused = after.filter("state is null").count() if len(rows) >= cap else 0
    except (ValueError, OSError, PySparkException) as error:
        return Outcome(known, known.limit(0), failure=classify(error), error=str(error))
    kept = spark.createDataFrame([tuple(r[n] for n in _NAMES) for r in rows if r.state in (S.PENDING, S.FIRING)], INSTANCES)
    told = [(r.rule_id, r.fingerprint, r.labels, r.before, r.state, r.value, now_ms) for r in sorted(rows, key=lambda r: r.fingerprint) if r.changed]
    rest = known.filter(F.col("rule_id") != rule.id).select(*_NAMES)
    return Outcome(rest.unionByName(kept), spark.createDataFrame(told, HISTORY), refused)


def active(instances: DataFrame, rule_id: str | None = None) -> DataFrame:
    rows = instances if rule_id is None else instances.filter(F.col("rule_id") == rule_id)
    return rows.filter(F.col("state").isin(S.PENDING, S.FIRING)).orderBy("started_ms", "rule_id", "fingerprint")


def gauges(instances: DataFrame) -> DataFrame:
    """How many instances are pending and firing."""
    return instances.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
