"""Log lines sent to a collector: batches of JSON lines over HTTP, never in the way of what logs."""

from __future__ import annotations

import json
import logging
import queue
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable

BATCH, EVERY_S, BUFFER, TIMEOUT_S, ATTEMPTS, WAIT_S = 100, 2.0, 2048, 5.0, 3, 0.2


def post_lines(url: str, key: str, timeout_s: float = TIMEOUT_S) -> Callable[[bytes], None]:
    """A sender of JSON lines; raises OSError for any answer but success."""

    def send(body: bytes) -> None:
        headers = {"Content-Type": "application/x-ndjson", "X-Api-Key": key}
        urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout_s).close()

    return send


class Shipper(logging.Handler):
    """A logging handler. A full buffer drops lines, and so does a batch that fails three times; both are counted."""

    def __init__(self, send: Callable[[bytes], None], service: str = "tidemark", batch: int = BATCH, every_s: float = EVERY_S, buffer: int = BUFFER, sleep: Callable[[float], None] = time.sleep):
        super().__init__()
        self._send, self._service, self._batch, self._every, self._sleep = send, service, batch, every_s, sleep
        self._queue: queue.Queue = queue.Queue(buffer)
        self.dropped = 0
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def emit(self, record: logging.LogRecord) -> None:
        for line in record.getMessage().splitlines():
            if not line.strip():
                continue
            stamp = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(record.created)) + f".{int(record.msecs):03d}Z"
            try:
                self._queue.put_nowait({"time": stamp, "service": self._service, "level": record.levelname.lower(), "message": line})
            except queue.Full:
                self.dropped += 1

    def _run(self) -> None:
        waiting, due, ended = [], time.monotonic() + self._every, False
        while not ended:
            try:
                got = self._queue.get(timeout=max(0.0, due - time.monotonic()))
                ended = got is None
                if got is not None:
                    waiting.append(got)
            except queue.Empty:
                pass
            if len(waiting) >= self._batch or waiting and (ended or time.monotonic() >= due):
                self._deliver(waiting)
                waiting = []
            if time.monotonic() >= due:
                due = time.monotonic() + self._every

    def _deliver(self, lines: list[dict]) -> None:
        body = "".join(json.dumps(line) + "\n" for line in lines).encode()
        for attempt in range(ATTEMPTS):
            try:
                return self._send(body)
            except OSError:
                self._sleep(WAIT_S * (attempt + 1))
        self.dropped += len(lines)

    def close(self) -> None:
        """Sends what is left."""
        if self._thread.is_alive():
            self._queue.put(None)
            self._thread.join()
        super().close()
