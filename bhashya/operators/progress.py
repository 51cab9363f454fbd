"""A progress callback: how many tasks of the jobs that run inside a block are done."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import SparkSession


class Progress:
    """Calls ``on_progress(done, all)`` now and then while its block runs, and at its end.

    A driver-side thread asks the status tracker; executors are not involved. Given a
    stream instead of a function, it keeps one line there up to date.
    """

    def __init__(self, spark: SparkSession, to, every: float = 0.5):
        self.tracker, self.every, self.end = spark.sparkContext.statusTracker(), every, threading.Event()
        self.call: Callable[[int, int], None] = to if callable(to) else lambda i, n: (to.write(f"\rtasks {i}/{n} "), to.flush())
        self.close = (lambda: None) if callable(to) else lambda: (to.write("\r" + " " * 40 + "\r"), to.flush())
        self.thread = threading.Thread(target=self._watch, daemon=True)
        self.done = self.all = 0

    def _look(self) -> None:
        stages = [self.tracker.getStageInfo(s) for s in self.tracker.getActiveStageIds()]
        stages = [s for s in stages if s is not None]
        if stages:
            self.done, self.all = sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)
            self.call(self.done, self.all)

    def _watch(self) -> None:
        while not self.end.wait(self.every):
            self._look()

    def __enter__(self) -> Progress:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.end.set()
        self.thread.join()
        self.call(self.all, self.all)
        self.close()
