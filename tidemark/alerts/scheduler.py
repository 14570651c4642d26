"""When rules are evaluated: a thread for each enabled rule, first after one interval."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from .evaluate import Rule


@dataclass
class _Running:
    interval_s: float
    ended: threading.Event = field(default_factory=threading.Event)
    thread: threading.Thread | None = None


class Scheduler:
    """Calls ``run(rule_id)`` for every enabled rule, each at its own interval; slow calls delay only their rule."""

    def __init__(self, run: Callable[[str], object]):
        self._run, self._running, self._lock = run, {}, threading.Lock()

    def reconcile(self, rules: Iterable[Rule]) -> None:
        """Ends what is gone, disabled or has another interval, and begins what is new."""
        wanted = {r.id: r.interval_s for r in rules if r.enabled and r.interval_s > 0}
        with self._lock:
            for rule_id in [k for k, r in self._running.items() if wanted.get(k) != r.interval_s]:
                self._running.pop(rule_id).ended.set()
            for rule_id in wanted.keys() - self._running.keys():
                self._running[rule_id] = running = _Running(wanted[rule_id])
                running.thread = threading.Thread(target=self._loop, args=(rule_id, running), daemon=True)
                running.thread.start()

    def _loop(self, rule_id: str, running: _Running) -> None:
        while not running.ended.wait(running.interval_s):
            try:
                self._run(rule_id)
            except Exception:  # one failed evaluation does not end a rule; the service has counted it
                continue

    def stop(self) -> None:
        """Ends all and waits for evaluations under way."""
        with self._lock:
            ending, self._running = list(self._running.values()), {}
        for running in ending:
            running.ended.set()
        for running in ending:
            running.thread.join()
