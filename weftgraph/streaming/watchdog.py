"""Stopping streams that no longer move."""

from __future__ import annotations

import threading
import time

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Watchdog(StreamingQueryListener):
    """Stops each query of a session that has taken in no row for so many seconds, since its start or its last rows.

    Use it as a context: it listens and looks every poll seconds while inside. stopped lists the ids of queries that it ended.
    """

    def __init__(self, spark: SparkSession, seconds: float = 600, poll: float = 60) -> None:
        self.spark, self.seconds, self.poll = spark, seconds, poll
        self.moved: dict[str, float] = {}
        self.stopped: list[str] = []
        self._end = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def onQueryStarted(self, event) -> None:
        self.moved.setdefault(str(event.id), time.monotonic())

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows > 0:
            self.moved[str(event.progress.id)] = time.monotonic()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.moved.pop(str(event.id), None)

    def _watch(self) -> None:
        while not self._end.wait(self.poll):
            for q in self.spark.streams.active:
                if time.monotonic() - self.moved.setdefault(str(q.id), time.monotonic()) > self.seconds:
                    self.stopped.append(str(q.id))
                    q.stop()

    def __enter__(self) -> Watchdog:
        self.spark.streams.addListener(self)
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self._end.set()
        self._thread.join()
        self.spark.streams.removeListener(self)
