"""Live status, progress, debounce, throttle, cooldown, speech and window streams.

Built-in aggregations work on streams and tables alike.  The custom ones keep a small state
per key in ``transformWithStateInPandas``; their batch twins cut each key's rows at pauses that
reset the state and stream the parts through a fold that jumps from one admitted row to the next.
Event time columns are TIMESTAMP; rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cueflow.operators.sequences import FRAME_MS, MAX_CUES, MAX_GAP_MS, MAX_WORDS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed values.
DEBOUNCE_MS, THROTTLE_MS, COOLDOWN_MS, SESSION_MS = 400, 24 * 3_600_000, 300_000, 330


def use_state_store(spark: SparkSession) -> None:
    """State with timers and TTL needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def latest_status(events: DataFrame) -> DataFrame:
    """Last status per run and clip; on a stream use update or complete mode."""
    return events.groupBy("run_id", "clip_index").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts"))


def progress(events: DataFrame) -> DataFrame:
    """Finished and all status events per run."""
    return events.groupBy("run_id").agg(F.count_if(F.col("status").isin("Done", "Failed")).alias("completed"), F.count("*").alias("events"))


def debounce(edits: DataFrame, quiet_ms: int = DEBOUNCE_MS, delay: str = "10 seconds") -> DataFrame:
    """edits(ts, key, value): the last value of every burst, when nothing follows for quiet_ms."""
    if edits.isStreaming:
        edits = edits.withWatermark("ts", delay)
    burst = edits.groupBy("key", F.session_window("ts", f"{quiet_ms} milliseconds")).agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.count("*").alias("edits"), F.max("ts").alias("last_ts"))
    return burst.select("key", F.col("session_window.start").alias("first_ts"), "last_ts", "value", "edits")


def speech_sessions(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """frames(ts, key, voiced): speech intervals of a live feed; pauses of up to 300 ms are bridged."""
    voiced = frames.where("voiced")
    if voiced.isStreaming:
        voiced = voiced.withWatermark("ts", delay)
    spans = voiced.groupBy("key", F.session_window("ts", f"{SESSION_MS} milliseconds")).agg(F.max("ts").alias("last"), F.count("*").alias("frames"))
    start = F.col("session_window.start")
    ended = spans.select("key", start.alias("start_ts"), (F.col("last") + F.expr(f"INTERVAL {FRAME_MS} MILLISECOND")).alias("end_ts"), "frames")
    return ended.where(F.unix_millis("end_ts") - F.unix_millis("start_ts") >= 350)


def once_per_key(requests: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first request of each key (on a stream: within the watermark)."""
    if requests.isStreaming:
        return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    first = Window.partitionBy(*keys).orderBy("ts", *[c for c in requests.columns if c not in (*keys, "ts")])
    return requests.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def _admitted(times: np.ndarray, flagged: np.ndarray, last: int | None, gap: int) -> tuple[np.ndarray, int | None]:
    """Throttle: which of the ordered times (ms) are admitted; the last admitted.

    From one admitted time the search goes on at the first that is ``gap`` later.
    """
    out, i = np.zeros(len(times), dtype=bool), 0 if last is None else int(np.searchsorted(times, last + gap))
    while i < len(times):
        out[i], last = True, int(times[i])
        i = max(i + 1, int(np.searchsorted(times, last + gap)))
    return out, last


def _outside_cooldown(times: np.ndarray, limited: np.ndarray, until: int | None, gap: int) -> tuple[np.ndarray, int | None]:
    """Cooldown: attempts that go ahead; an admitted one that is rate limited suppresses the next ones."""
    out, bad = np.zeros(len(times), dtype=bool), np.flatnonzero(limited)
    i = 0 if until is None else int(np.searchsorted(times, until))
    while i < len(times):
        at = int(np.searchsorted(bad, i))
        j = int(bad[at]) if at < len(bad) else len(times) - 1
        out[i : j + 1] = True
        if at == len(bad):
            break
        until = int(times[j]) + gap
        i = max(j + 1, int(np.searchsorted(times, until)))
    return out, until


def _fold(rule, gap: int):
    """Over Arrow batches of (key, part, ts_ms, event_id, flag) in this order: the rows that ``rule`` lets through.

    Only the state of the part at hand is kept, so a part of any length passes in bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, parts, times, _, flags = batch.columns
            same = pc.and_(pc.equal(keys[1:], keys[:-1]), pc.equal(parts[1:], parts[:-1]))
            cuts = [0, *(np.flatnonzero(~np.asarray(pc.fill_null(same, False), dtype=bool)) + 1).tolist(), batch.num_rows]
            times, flags = np.asarray(times), np.asarray(flags, dtype=bool)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for a, z in zip(cuts, cuts[1:], strict=False):
                name = (keys[a].as_py(), parts[a].as_py())
                if name != current:
                    current, state = name, None
                keep[a:z], state = rule(times[a:z], flags[a:z], state, gap)
            yield batch.filter(pa.array(keep)).select(["key", "event_id", "ts_ms"])

    return run


def _parts(rows: DataFrame, gap: int) -> DataFrame:
    """rows with ``part``: the number of pauses of at least ``gap`` behind which an event of its key is sure to pass.

    Such a pause ends at the first event of a stretch of ``gap``, so the stretches' first and
    last times tell; a key's rows never come together for it.
    """
    width = max(gap, 1)
    marked = rows.withColumn("stretch", F.floor(F.col("ts_ms") / width))
    spans = marked.groupBy("key", "stretch").agg(F.min("ts_ms").alias("first"), F.max("ts_ms").alias("last"))
    order = Window.partitionBy("key").orderBy("stretch")
    pause = F.coalesce(F.col("first") - F.lag("last").over(order) >= gap, F.lit(False)).cast("int")
    numbered = spans.withColumn("pause", pause).select(F.col("key").alias("_key"), F.col("stretch").alias("_stretch"), F.sum("pause").over(order).alias("part"))
    return marked.join(numbered, marked["key"].eqNullSafe(numbered["_key"]) & (marked["stretch"] == numbered["_stretch"])).drop("stretch", "_key", "_stretch")


class _Gate(StatefulProcessor):
    """Keeps one time per key and lets rows through by a rule."""

    def __init__(self, rule, gap: int, flag: str | None):
        self.rule, self.gap, self.flag = rule, gap, flag

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("at", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ts_ms", "event_id"])
        at = self.state.get()[0] if self.state.exists() else None
        keep, at = self.rule(frame["ts_ms"].to_numpy(), frame[self.flag].to_numpy(dtype=bool) if self.flag else np.zeros(len(frame), dtype=bool), at, self.gap)
        if at is not None:
            self.state.update((int(at),))
        yield frame.loc[keep, ["key", "event_id", "ts_ms"]]

    def close(self) -> None:
        pass


def _gated(rows: DataFrame, rule, gap: int, flag: str | None) -> DataFrame:
    columns = ["key", "event_id", F.unix_millis("ts").alias("ts_ms")]
    kind = f"key {rows.schema['key'].dataType.simpleString()}, event_id {rows.schema['event_id'].dataType.simpleString()}, ts_ms long"
    if rows.isStreaming:
        return rows.select(*columns, *([flag] if flag else [])).groupBy("key").transformWithStateInPandas(_Gate(rule, gap, flag), kind, "Append", "None")
    flagged = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    parts = _parts(rows.where("ts is not null").select(*columns, flagged.alias("flag")), gap)
    ordered = parts.select("key", "part", "ts_ms", "event_id", "flag").repartition("key", "part").sortWithinPartitions("key", "part", "ts_ms", "event_id")
    return ordered.mapInArrow(_fold(rule, gap), kind)


def throttle(rows: DataFrame, interval_ms: int = THROTTLE_MS) -> DataFrame:
    """rows(ts, key, event_id): those at least interval_ms after the last admitted of their key.

    Of equal times the smaller event_id comes first; a null key is a key; a table's rows without a time don't pass.
    """
    return _gated(rows, _admitted, interval_ms, None)


def cooldown(rows: DataFrame, pause_ms: int = COOLDOWN_MS) -> DataFrame:
    """rows(ts, key, event_id, limited): attempts not within pause_ms after a rate-limited one.

    Ties and nulls as in ``throttle``; a null ``limited`` is false.
    """
    return _gated(rows, _outside_cooldown, pause_ms, "limited")


class _OpenWindow(StatefulProcessor):
    """Translation windows of a cue stream: the open window is the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "first_ord long, last_ord long, start_ms long, end_ms long, n int, w int, text string")

    def _closed(self, key, s) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "first_ord": [s[0]], "last_ord": [s[1]], "start_ms": [s[2]], "end_ms": [s[3]], "n_cues": [s[4]], "text": [s[6]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("cue_ord").itertuples():
            if s is not None and r.start_ms - s[3] > MAX_GAP_MS:
                out.append(self._closed(key, s))
                s = None
            n_words = len(r.text.split())
            s = (r.cue_ord, r.cue_ord, r.start_ms, r.end_ms, 1, n_words, r.text) if s is None else (s[0], r.cue_ord, s[2], r.end_ms, s[4] + 1, s[5] + n_words, f"{s[6]} {r.text}")
            if s[6].rstrip().endswith((".", "!", "?")) or s[4] >= MAX_CUES or s[5] >= MAX_WORDS:
                out.append(self._closed(key, s))
                s = None
        if s is None:
            self.state.clear()
        else:
            self.state.update(tuple(x if isinstance(x, str) else int(x) for x in s))
            self.handle.registerTimer(int(s[3]) + MAX_GAP_MS)
        yield pd.concat(out) if out else pd.DataFrame(columns=["key", "first_ord", "last_ord", "start_ms", "end_ms", "n_cues", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The watermark is past the open window's end and gap: nothing can join it any more."""
        s = tuple(self.state.get()) if self.state.exists() else None
        if s is not None and s[3] + MAX_GAP_MS <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self._closed(key, s)

    def close(self) -> None:
        pass


def stream_windows(cues: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """cues(ts: event time of start_ms, key, cue_ord, start_ms, end_ms, text) to closed windows.

    A window closes as in ``translation_windows``, the last one when the watermark passes its
    end by the gap.  Times are milliseconds since 1970 here, as event time is.
    """
    rows = cues.withWatermark("ts", delay)
    schema = "key string, first_ord long, last_ord long, start_ms long, end_ms long, n_cues int, text string"
    return rows.groupBy("key").transformWithStateInPandas(_OpenWindow(), schema, "Append", "EventTime")
