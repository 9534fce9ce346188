"""Searches that run beside each other: their progress as events, and a registry by which any of them can be stopped."""

from __future__ import annotations

import queue
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark import InheritableThread
from pyspark.sql import SparkSession

#: What a search does: it gets a function that tells a step and whether it has been stopped, and returns its result.
Work = Callable[[Callable[[str, object], None]], object]


class Cancelled(Exception):
    """The search was stopped."""


class Running:
    """One search: its events in order, ending with one of done, failed or cancelled."""

    def __init__(self, key: str) -> None:
        self.key, self.stopped = key, threading.Event()
        self._events: queue.SimpleQueue = queue.SimpleQueue()

    def tell(self, kind: str, value: object = None) -> None:
        """Tell a step; a search that has been stopped ends here at the latest."""
        if self.stopped.is_set():
            raise Cancelled(self.key)
        self._events.put((kind, value))

    def events(self) -> Iterator[tuple[str, object]]:
        while True:
            event = self._events.get()
            yield event
            if event[0] in ("done", "failed", "cancelled"):
                return


class Searches:
    """The searches of a session. Each runs in a thread of its own whose Spark jobs form a group."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._running, self._lock = spark, {}, threading.Lock()

    def start(self, work: Work, key: str | None = None) -> Running:
        """Start a search; a key that is running already is an error."""
        own = Running(key or str(uuid.uuid4()))
        with self._lock:
            if own.key in self._running:
                raise ValueError(f"{own.key} is running")
            self._running[own.key] = own

        def run() -> None:
            self.spark.sparkContext.setJobGroup(own.key, "search", interruptOnCancel=True)
            try:
                result = work(own.tell)
                end = ("cancelled", None) if own.stopped.is_set() else ("done", result)
            except Exception as e:  # jobs of a stopped search fail, whatever with
                end = ("cancelled", None) if own.stopped.is_set() else ("failed", f"{type(e).__name__}: {e}")
            with self._lock:
                del self._running[own.key]
            own._events.put(end)

        InheritableThread(target=run, daemon=True).start()
        return own

    def running(self) -> list[str]:
        with self._lock:
            return sorted(self._running)

    def cancel(self, key: str) -> bool:
        """Stop a search: its jobs end, and it tells no further step. False if it isn't running."""
        with self._lock:
            own = self._running.get(key)
        if own is None:
            return False
        own.stopped.set()
        self.spark.sparkContext.cancelJobGroup(key)
        return True
