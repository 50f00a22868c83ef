"""Where user code plugs in: translation, synthesis, per-clip logic.  Live callbacks are in ``streaming.tables``.

Hooks work on distinct pending work only, keep one bad row from failing the rest, and
return an error column instead of raising.  Limits (deadline, spacing, retries, calls in
flight) hold in each partition; with one partition they hold for the whole job.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.operators.joins import fan_out_results, pending_work


@dataclass(frozen=True)
class Limits:
    """How a service may be called: attempts, seconds until one counts as failed, seconds between
    starts of calls and before another attempt, and calls in flight."""

    attempts: int = 3
    timeout_s: float | None = None
    spacing_s: float = 0.0
    retry_s: float = 0.0
    slots: int = 1


# The limits of a translation and of a synthesis, and partitions (concurrent calls) of the latter.
TRANSLATION = Limits(3, 8.0, 0.15, 1.5)
SYNTHESIS = Limits(3, 22.0, 0.2, 1.5)
CONCURRENT = 6
#: Calls of a partition that may hang behind their deadlines; beyond, its rows fail without a call.
HANGING = 256


class _Thread:
    """A thread that makes one call after the other.  One that hangs is left to itself and ends with its call."""

    def __init__(self, fn: Callable):
        self.tasks, self.results = queue.SimpleQueue(), queue.SimpleQueue()
        threading.Thread(target=self._run, args=(fn,), daemon=True).start()

    def _run(self, fn: Callable) -> None:
        while (args := self.tasks.get()) is not None:
            try:
                self.results.put((fn(*args), None))
            except Exception as e:  # noqa: BLE001 - whatever the user's code raises belongs to its row
                self.results.put((None, f"{type(e).__name__}: {e}"))


class _Service:
    """Calls of one partition under its limits."""

    def __init__(self, fn: Callable, limits: Limits):
        self.fn, self.limits, self.own = fn, limits, threading.local()
        self.lock, self.next, self.hanging = threading.Lock(), 0.0, []

    def _turn(self) -> None:
        """Waits until the next call may start."""
        with self.lock:
            now = time.monotonic()
            start = max(now, self.next)
            self.next = start + self.limits.spacing_s
        if start > now:
            time.sleep(start - now)

    def _once(self, args: tuple) -> tuple:
        if len(self.hanging) >= HANGING:
            with self.lock:
                self.hanging = [t for t in self.hanging if t.results.empty()]
            if len(self.hanging) >= HANGING:
                return None, f"TimeoutError: {HANGING} calls hang"
        self._turn()
        thread = getattr(self.own, "thread", None)
        if thread is None:
            thread = self.own.thread = _Thread(self.fn)
        thread.tasks.put(args)
        try:
            return thread.results.get(timeout=self.limits.timeout_s)
        except queue.Empty:
            thread.tasks.put(None)
            self.own.thread = None
            with self.lock:
                self.hanging.append(thread)
            return None, f"TimeoutError: no result within {self.limits.timeout_s} s"

    def call(self, args: tuple) -> tuple:
        """(result, error) of the first attempt that gives one; an empty result is a failure."""
        result, error = None, None
        for attempt in range(self.limits.attempts):
            if attempt:
                time.sleep(self.limits.retry_s)
            result, error = self._once(args)
            if error is None and (result is None or not str(result).strip()):
                result, error = None, "ValueError: empty result"
            if error is None:
                break
        return result, error

    def end(self) -> None:
        thread = getattr(self.own, "thread", None)
        if thread is not None:
            thread.tasks.put(None)
            self.own.thread = None


def _mapped(fn: Callable, key: list[str], limits: Limits):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = _Service(fn, limits)
        with ThreadPoolExecutor(limits.slots) as pool:
            for frame in frames:
                made = list(pool.map(service.call, frame[key].itertuples(index=False, name=None)))
                yield frame.assign(result=[r for r, _ in made], error=[e for _, e in made])
            for done in [pool.submit(service.end) for _ in range(limits.slots)]:
                done.result()

    return run


def _computed(items: DataFrame, fn: Callable, key: tuple[str, ...], cache: DataFrame | None, limits: Limits, partitions: int | None) -> DataFrame:
    if cache is None:
        cache = items.sparkSession.createDataFrame([], ", ".join(f"{k} string" for k in (*key, "result", "error")))
    work = pending_work(items, cache, key)
    if partitions:
        work = work.repartition(partitions)
    schema = ", ".join(f"{k} string" for k in (*key, "result", "error"))
    new = work.mapInPandas(_mapped(fn, list(key), limits), schema)
    return fan_out_results(items, new.unionByName(cache.select(*key, "result", "error")), key)


def translate_with(items: DataFrame, fn: Callable[[str], str], cache: DataFrame | None = None, partitions: int | None = None, limits: Limits = TRANSLATION) -> DataFrame:
    """items(text) with ``translated`` and ``error``; a text that fails in all attempts stays as it is."""
    done = _computed(items, fn, ("text",), cache, limits, partitions)
    return done.withColumn("translated", F.coalesce("result", "text")).drop("result")


def synthesize_with(items: DataFrame, fn: Callable[[str, str, str], str], cache: DataFrame | None = None, partitions: int = CONCURRENT, limits: Limits = SYNTHESIS) -> DataFrame:
    """items(text, voice, pitch) with ``result`` (null on failure) and ``error``."""
    return _computed(items, fn, ("text", "voice", "pitch"), cache, limits, partitions)


def per_clip(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over each clip's rows: video_id, clip_index, the columns of ``schema``, and ``error``.

    The ids are the clip's, whether ``schema`` has them or not.  A clip that fails gives one
    row, with its ids and what it raised.
    """
    columns = [part.strip() for part in schema.split(",")]
    names = [c.split()[0] for c in columns if c.split()[0] not in ("video_id", "clip_index")]
    kinds = [c for c in columns if c.split()[0] in names]
    ids = [f"{k} {df.schema[k].dataType.simpleString()}" for k in ("video_id", "clip_index")]

    def safe(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            made = fn(frame)[names].assign(error=None)
        except Exception as e:  # noqa: BLE001 - whatever the user's code raises belongs to its clip
            made = pd.DataFrame([{**{c: None for c in names}, "error": f"{type(e).__name__}: {e}"}])
        made.insert(0, "video_id", key[0])
        made.insert(1, "clip_index", key[1])
        return made

    return df.groupBy("video_id", "clip_index").applyInPandas(safe, ", ".join([*ids, *kinds, "error string"]))
