"""Notifications of alerts: which are sent, and a queue that sends them with retries."""

from __future__ import annotations

import json
import queue
import threading
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable

SEVERITIES = ("debug", "info", "warning", "error", "critical")
QUEUE_SIZE, RETRIES, FIRST_WAIT_S, LONGEST_WAIT_S = 1024, 3, 0.2, 5.0


def severity_of(text: str) -> str:
    """The canonical severity; an unknown one is a warning."""
    word = text.strip().lower()
    return word if word in SEVERITIES else "warning"


def wanted(state: str, severity: str, least: str = "debug") -> bool:
    """Only what fires or is resolved is told, from ``least`` on."""
    return state in ("firing", "resolved") and SEVERITIES.index(severity_of(severity)) >= SEVERITIES.index(severity_of(least))


class Permanent(Exception):
    """A refusal that trying again will not change."""


def post(url: str, timeout_s: float = 5.0, token: str = "") -> Callable[[dict], None]:
    """A sender that posts JSON; 4xx is permanent, 5xx and transport errors may pass."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def send(message: dict) -> None:
        request = urllib.request.Request(url, json.dumps(message).encode(), headers)
        try:
            urllib.request.urlopen(request, timeout=timeout_s).close()
        except urllib.error.HTTPError as error:
            raise Permanent(str(error)) if 400 <= error.code < 500 else error from None

    return send


class Dispatcher:
    """Sends from a bounded queue in a thread of its own; a full queue drops, never blocks."""

    def __init__(self, send: Callable[[dict], None], size: int = QUEUE_SIZE, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep):
        self._send, self._retries, self._sleep = send, retries, sleep
        self._queue: queue.Queue = queue.Queue(size)
        self.counts: Counter = Counter()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def offer(self, message: dict) -> bool:
        try:
            self._queue.put_nowait(message)
        except queue.Full:
            self.counts["dropped_queue_full"] += 1
            return False
        return True

    def _run(self) -> None:
        while (message := self._queue.get()) is not None:
            self._deliver(message)
            self._queue.task_done()
        self._queue.task_done()

    def _deliver(self, message: dict) -> None:
        for attempt in range(self._retries + 1):
            try:
                self._send(message)
                self.counts["sent"] += 1
                return
            except Permanent:
                self.counts["failed_permanent"] += 1
                return
            except Exception:  # a sender of any kind may fail in any way; what counts is that it did
                if attempt < self._retries:
                    self.counts["retries"] += 1
                    self._sleep(min(LONGEST_WAIT_S, FIRST_WAIT_S * 2**attempt))
        self.counts["failed_exhausted"] += 1

    def exposition(self) -> dict[str, int]:
        """Names and values of the sender's own metrics."""
        c = self.counts
        return {
            "alerts_notify_sent_total": c["sent"],
            'alerts_notify_failed_total{reason="permanent"}': c["failed_permanent"],
            'alerts_notify_failed_total{reason="exhausted"}': c["failed_exhausted"],
            'alerts_notify_dropped_total{reason="queue_full"}': c["dropped_queue_full"],
            "alerts_notify_filtered_total": c["filtered"],
            "alerts_notify_retries_total": c["retries"],
            "alerts_notify_queue_depth": self._queue.qsize(),
        }

    def close(self) -> None:
        self._queue.put(None)
        self._thread.join()
