"""How far Spark's running jobs have come, told to a callback."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def tasks(spark: SparkSession) -> tuple[int, int]:
    """(finished, all) tasks of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)


@contextmanager
def watched(spark: SparkSession, tell: Callable[[int, int], None], every: float = 0.5) -> Iterator[None]:
    """While the block runs, tell(finished, all) is called whenever these numbers have changed."""
    over = threading.Event()

    def look() -> None:
        last = (0, 0)
        while not over.wait(every):
            now = tasks(spark)
            if now[1] and now != last:
                tell(*now)
                last = now

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def line_on_stderr(label: str) -> Callable[[int, int], None]:
    """Writes one line that renews itself; nothing where no one looks."""

    def tell(done: int, total: int) -> None:
        if sys.stderr.isatty():
            sys.stderr.write(f"\r{label}: {done}/{total} tasks\x1b[K" + ("\r\x1b[K" if done == total else ""))
            sys.stderr.flush()

    return tell
