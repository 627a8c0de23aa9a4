"""Spark jobs side by side and under a time limit.

Each task runs in a driver thread whose Spark jobs carry a tag; cancelling the
tag ends them on the executors.  Threads inherit the tags of the one that starts
them, so cancelling a trial ends the jobs of its folds too.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

POLL_SECONDS = 0.1


class OutOfTime(Exception):
    """The time limit was reached and the jobs were cancelled."""


def _tagged(spark: SparkSession, tag: str, task: Callable, stopped: threading.Event) -> Callable:
    sc = spark.sparkContext

    def run():
        sc.addJobTag(tag)
        try:
            if stopped.is_set():
                raise OutOfTime(tag)
            return task()
        finally:
            sc.removeJobTag(tag)

    return inheritable_thread_target(spark)(run)


def _cancel_until(spark: SparkSession, tag: str, done: Callable[[float], bool]) -> None:
    """Cancel jobs of ``tag`` until ``done`` (a job may start between two cancellations)."""
    while not done(POLL_SECONDS):
        spark.sparkContext.cancelJobsWithTag(tag)


def side_by_side(spark: SparkSession, tasks: list[Callable], at_once: int) -> Iterator:
    """Results of ``tasks`` in their order, up to ``at_once`` running together.

    Closing the iterator early cancels what still runs and starts nothing more.
    """
    tag, stopped = f"together-{uuid.uuid4().hex}", threading.Event()
    pool = ThreadPoolExecutor(max(1, at_once))
    futures = [pool.submit(_tagged(spark, tag, task, stopped)) for task in tasks]
    try:
        for future in futures:
            yield future.result()
    finally:
        stopped.set()
        for future in futures:
            future.cancel()
        finished = threading.Event()
        ender = threading.Thread(target=lambda: (pool.shutdown(wait=True), finished.set()))
        ender.start()
        _cancel_until(spark, tag, finished.wait)
        ender.join()


def within(spark: SparkSession, seconds: float, task: Callable):
    """``task()``'s result, or :class:`OutOfTime` once its jobs are cancelled after ``seconds``."""
    tag, stopped, outcome = f"within-{uuid.uuid4().hex}", threading.Event(), {}

    def run():
        try:
            outcome["value"] = task()
        except BaseException as error:      # handed to the caller's thread below
            outcome["error"] = error

    worker = threading.Thread(target=_tagged(spark, tag, run, stopped), daemon=True)
    worker.start()
    worker.join(max(seconds, 0.0))
    late = worker.is_alive()
    if late:
        stopped.set()
        _cancel_until(spark, tag, lambda wait: worker.join(wait) or not worker.is_alive())
    if "value" in outcome:
        return outcome["value"]
    if late:
        raise OutOfTime(f"no result within {seconds:.1f} s") from outcome.get("error")
    raise outcome["error"]
