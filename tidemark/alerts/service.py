"""The alert loop: a rule's turn is evaluated, stored and told."""

from __future__ import annotations

import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable

from ..engine import Engine
from ..functions.numfmt import format_float
from . import state as S
from .datasources import BUILTIN, PROBE, Datasource, Remote
from .evaluate import INSTANCE_CAP, Local, Rule, Source, evaluate
from .notify import Dispatcher, severity_of, wanted
from .scheduler import Scheduler
from .store import AlertStore, Missing


class Failed(RuntimeError):
    """An evaluation did not succeed; the states of the rule's instances are as before."""


class AlertService:
    def __init__(self, engine: Engine, store: AlertStore | None = None, notifier: Dispatcher | None = None, least: str = "debug", cap: int = INSTANCE_CAP, now: Callable[[], float] = time.time):
        self.engine, self.store, self.notifier = engine, store or AlertStore(), notifier
        self.least, self.cap, self.now = least, cap, now
        self.counts: Counter = Counter()
        self.seconds, self.evaluations, self.last_s = 0.0, 0, 0.0
        self.scheduler = Scheduler(self.evaluate)
        self._turn = threading.Lock()  # instances are read, changed and written by one evaluation at a time
        if not any(d.source == BUILTIN for d in self.store.datasources()):
            self.store.save_datasource(Datasource("builtin", "builtin", source=BUILTIN))

    def now_ms(self) -> int:
        return int(self.now() * 1000)

    @staticmethod
    def new_id() -> str:
        return str(uuid.uuid4())

    # ---- evaluation ----

    def source(self, datasource: Datasource) -> Source:
        return Local(self.engine) if datasource.source == BUILTIN else Remote(self.engine.spark, datasource)

    def _failed(self, reason: str, text: str) -> Failed:
        self.counts['alert_evaluations_total{result="error"}'] += 1
        self.counts[f'alert_evaluation_failures_total{{reason="{reason}"}}'] += 1
        return Failed(text)

    def evaluate(self, rule_id: str) -> dict[str, int]:
        """Active and pending instances and transitions after one evaluation; raises Missing or Failed."""
        began, rule = self.now(), self.store.rule(rule_id)
        try:
            datasource = self.store.datasource(rule.datasource or "builtin")
        except Missing:
            raise self._failed("datasource", f"rule {rule.name!r} names an unknown datasource") from None
        if not datasource.enabled:
            raise self._failed("datasource_disabled", f"datasource {datasource.name!r} is disabled")
        with self._turn:
            at = self.now_ms()
            out = evaluate(self.source(datasource), rule, self.store.instances(self.engine.spark), at, self.cap)
            self.last_s = self.now() - began
            self.seconds, self.evaluations = self.seconds + self.last_s, self.evaluations + 1
            if out.failure:
                raise self._failed(out.failure, out.error)
            told = out.history.collect()
            self.store.apply(rule.id, out.instances, out.history, at)
        self.counts['alert_evaluations_total{result="success"}'] += 1
        if out.refused:
            self.counts['alert_evaluation_failures_total{reason="instance_cap"}'] += 1
        self.counts["alert_state_transitions_total"] += len(told)
        for change in told:
            self._tell(rule, change)
        states = Counter(i["status"] for i in self.store.active(rule.id))
        return {"active": states[S.FIRING], "pending": states[S.PENDING], "transitions": len(told)}

    def evaluate_all(self) -> int:
        """Evaluates every enabled rule; how many there were. One that fails does not keep the others."""
        rules = [r for r in self.store.rules() if r.enabled]
        for rule in rules:
            try:
                self.evaluate(rule.id)
            except (Failed, Missing):
                continue
        return len(rules)

    def _tell(self, rule: Rule, change) -> None:
        if self.notifier is None or change.state not in (S.FIRING, S.RESOLVED):
            return
        if not wanted(change.state, rule.severity, self.least):
            self.notifier.counts["filtered"] += 1
            return
        self.notifier.offer({
            "rule_id": rule.id, "rule_name": rule.name, "fingerprint": change.fingerprint, "status": change.state, "severity": severity_of(rule.severity),
            "value": format_float(change.value), "labels": change.labels, "annotations": rule.annotations, "time_ms": change.at_ms,
        })

    def probe(self, datasource: Datasource) -> None:
        """Raises OSError or ValueError if the source does not answer."""
        self.source(datasource).rows(PROBE, self.now_ms()).count()

    # ---- life ----

    def changed(self) -> None:
        """Rules were saved or deleted."""
        self.scheduler.reconcile(self.store.rules())

    def start(self) -> None:
        self.changed()

    def stop(self) -> None:
        self.scheduler.stop()
        if self.notifier is not None:
            self.notifier.close()

    def exposition(self) -> dict[str, float]:
        """Names and values of the service's own metrics."""
        states = Counter(i["status"] for i in self.store.active())
        out: dict[str, float] = {"alert_rules_total": len(self.store.rules()), "alerts_active": states[S.FIRING], "alerts_pending": states[S.PENDING]}
        out |= self.counts
        out |= {"alert_evaluation_duration_seconds_sum": self.seconds, "alert_evaluation_duration_seconds_count": self.evaluations, "alert_scheduler_duration_seconds": self.last_s}
        if self.notifier is not None:
            out |= self.notifier.exposition()
        return out
