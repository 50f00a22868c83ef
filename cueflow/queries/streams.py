"""Queries that run Structured Streaming jobs to their end over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.plans.model import Model, sql
from cueflow.queries.registry import query
from cueflow.queries.sequential import _W3_CUT, _sparse, _windows
from cueflow.sources.folders import new_folder
from cueflow.sources.readers import read_status_stream
from cueflow.streaming import jobs as X
from cueflow.streaming import tables as T

EPOCH_MS = 1_704_067_200_000
EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def _folder(m: Model) -> str:
    """A new folder for a stream's files."""
    return new_folder(m.spark, "stream")


def _events(m: Model) -> DataFrame:
    return m.spark.readStream.schema(EVENTS).parquet(f"{m.sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(m: Model, stream: DataFrame, mode: str) -> DataFrame:
    """What the stream has written when all present input is read."""
    folder = _folder(m)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return m.spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _statuses(m: Model) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "purchase", "Done").otherwise("Cutting")
    return _events(m).select("ts", "event_id", F.col("user_id").cast("string").alias("run_id"), (F.col("event_id") % 5).cast("int").alias("clip_index"), status.alias("status"))


@query("x1_latest_status", sql("statuses", body="SELECT run_id, clip_index, arg_max(status, struct_pack(t := ts, s := status)) AS status FROM statuses GROUP BY 1, 2"))
def x1(m: Model) -> DataFrame:
    return finished(m, X.latest_status(_statuses(m)), "complete").select("run_id", "clip_index", "status")


@query("x2_progress", sql("statuses", body="SELECT run_id, count(*) FILTER (status IN ('Done', 'Failed')) AS completed, count(*) AS events FROM statuses GROUP BY 1"))
def x2(m: Model) -> DataFrame:
    return finished(m, X.progress(_statuses(m)), "complete")


_BURSTS = """bursts AS (SELECT user_id, ts, event_type, event_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL {0})::INT, 0) AS c FROM events {1}))"""


def _closing(m: Model, rows: DataFrame) -> DataFrame:
    """A stream of the rows, with a last row far behind them that closes every window."""
    folder = _folder(m)
    rows.write.parquet(f"{folder}/in/a")
    last = rows.agg(*[(F.max(c) + F.expr("INTERVAL 30 DAY") if c == "ts" else F.max(c)).alias(c) for c in rows.columns])
    last.withColumn("key", F.lit(-1).cast(rows.schema["key"].dataType)).select(*rows.columns).write.parquet(f"{folder}/in/b")
    return m.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000).parquet(f"{folder}/in/*")


@query("x3_debounce", sql(_BURSTS.format("30 MINUTE", ""), body="SELECT user_id AS key, count(*) AS edits, arg_max(event_type, struct_pack(t := ts, v := event_type)) AS value FROM bursts GROUP BY user_id, g"))
def x3(m: Model) -> DataFrame:
    rows = m.events().select("ts", F.col("user_id").alias("key"), F.col("event_type").alias("value"))
    return finished(m, X.debounce(_closing(m, rows), 1_800_000), "append").where("key >= 0").select("key", "edits", "value")


@query("x3_debounce_default", sql(_BURSTS.format("400 MILLISECOND", "").replace("user_id, ts, event_type, event_id", "event_type, ts, event_id").replace("user_id", "event_type"), body="SELECT event_type AS key, count(*) AS edits, arg_max(event_id, struct_pack(t := ts, v := event_id)) AS value FROM bursts GROUP BY event_type, g"))
def x3_default(m: Model) -> DataFrame:
    """The default quiet time, 400 ms, over a table."""
    return X.debounce(m.events().select("ts", F.col("event_type").alias("key"), F.col("event_id").alias("value"))).select("key", "edits", "value")


#: ``epoch_ms`` rounds half milliseconds up, so that times are cut to milliseconds first.  A null key is a key; rows without a time don't pass.
_ADMIT = """timed AS (SELECT user_id, event_id, event_type, epoch_ms(date_trunc('milliseconds', ts)) AS t FROM events),
    ordered AS (SELECT user_id, event_id, t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM timed WHERE t IS NOT NULL),
    walked AS (SELECT user_id, event_id, t, i, {first} AS at, true AS ok FROM ordered WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.t, o.i, {step} FROM walked w JOIN ordered o ON o.user_id IS NOT DISTINCT FROM w.user_id AND o.i = w.i + 1)"""


@query("x4_throttle", sql(_ADMIT.format(first="t", step="CASE WHEN o.t - w.at >= 7200000 THEN o.t ELSE w.at END, o.t - w.at >= 7200000"), recursive=True, body="SELECT user_id AS key, event_id FROM walked WHERE ok"))
def x4(m: Model) -> DataFrame:
    X.use_state_store(m.spark)
    return finished(m, X.throttle(_events(m).select("ts", F.col("user_id").alias("key"), "event_id"), 7_200_000), "append").select("key", "event_id")


@query("x4_throttle_batch", sql(_ADMIT.format(first="t", step="CASE WHEN o.t - w.at >= 7200000 THEN o.t ELSE w.at END, o.t - w.at >= 7200000"), recursive=True, body="SELECT user_id AS key, event_id FROM walked WHERE ok"))
def x4_batch(m: Model) -> DataFrame:
    return X.throttle(m.events().select("ts", F.col("user_id").alias("key"), "event_id"), 7_200_000).select("key", "event_id")


def _throttled(interval: int) -> str:
    return _ADMIT.format(first="t", step=f"CASE WHEN o.t - w.at >= {interval} THEN o.t ELSE w.at END, o.t - w.at >= {interval}")


@query("x4_throttle_daily", sql(_throttled(X.THROTTLE_MS), recursive=True, body="SELECT user_id AS key, event_id FROM walked WHERE ok"))
def x4_daily(m: Model) -> DataFrame:
    """The default interval, a day."""
    return X.throttle(m.events().select("ts", F.col("user_id").alias("key"), "event_id")).select("key", "event_id")


@query("x4_throttle_hot_key", sql("hot AS (SELECT CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, event_id, ts, event_type FROM events)", _throttled(600_000).replace("FROM events)", "FROM hot)"), recursive=True, body="SELECT user_id AS key, event_id FROM walked WHERE ok"))
def x4_hot(m: Model) -> DataFrame:
    """One key with a third of all rows."""
    key = F.when(F.col("user_id") % 3 == 0, -1).otherwise(F.col("user_id"))
    return X.throttle(m.events().select("ts", key.alias("key"), "event_id"), 600_000).select("key", "event_id")


_COOL = _ADMIT.format(first="CASE WHEN bad THEN t + 14400000 ELSE -1 END", step="CASE WHEN o.t >= w.at AND o.bad THEN o.t + 14400000 ELSE w.at END, o.t >= w.at")


@query("x5_cooldown", sql(_COOL, recursive=True, body="SELECT user_id AS key, event_id FROM walked WHERE ok"))
def x5(m: Model) -> DataFrame:
    X.use_state_store(m.spark)
    rows = _events(m).select("ts", F.col("user_id").alias("key"), "event_id", (F.col("event_type") == "error").alias("limited"))
    return finished(m, X.cooldown(rows, 14_400_000), "append").select("key", "event_id")


def _limited(m: Model) -> DataFrame:
    return m.events().select("ts", F.col("user_id").alias("key"), "event_id", (F.col("event_type") == "error").alias("limited"))


@query("x5_cooldown_batch", sql(_COOL, recursive=True, body="SELECT user_id AS key, event_id FROM walked WHERE ok"))
def x5_batch(m: Model) -> DataFrame:
    return X.cooldown(_limited(m), 14_400_000).select("key", "event_id")


@query("x5_cooldown_default", sql(_COOL.replace("14400000", str(X.COOLDOWN_MS)), recursive=True, body="SELECT user_id AS key, event_id FROM walked WHERE ok"))
def x5_default(m: Model) -> DataFrame:
    """The default pause, five minutes."""
    return X.cooldown(_limited(m)).select("key", "event_id")


def _frames(m: Model) -> DataFrame:
    """Frames of the model at 30 ms steps of event time."""
    ts = F.timestamp_millis(F.lit(EPOCH_MS) + F.col("frame_no") * 30)
    return _sparse(m).select(ts.alias("ts"), F.col("video_id").cast("long").alias("key"), "voiced")


@query("x6_speech_sessions", sql("frames AS (SELECT user_id AS video_id, n * 3 + n // 7 * 9 AS frame_no, event_type <> 'error' AS voiced FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events))",
    """islands AS (SELECT video_id, min(frame_no) * 30 AS s, (max(frame_no) + 1) * 30 AS e, count(*) AS frames FROM (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY frame_no) AS g FROM
    (SELECT *, coalesce((frame_no - lag(frame_no) OVER (PARTITION BY video_id ORDER BY frame_no) > 11)::INT, 0) AS c FROM frames WHERE voiced)) GROUP BY video_id, g)""",
    body="SELECT video_id AS key, s AS start_ms, e AS end_ms, frames FROM islands WHERE e - s >= 350"))
def x6(m: Model) -> DataFrame:
    out = finished(m, X.speech_sessions(_closing(m, _frames(m))), "append").where("key >= 0")
    at = lambda c: F.unix_millis(c) - EPOCH_MS
    return out.select("key", at("start_ts").alias("start_ms"), at("end_ts").alias("end_ms"), "frames")


@query("x7_stream_windows", sql("cues", *_windows("cues", _W3_CUT), recursive=True, body="SELECT video_id AS key, min(cue_ord)::BIGINT AS first_ord, max(cue_ord)::BIGINT AS last_ord, count(*) AS n_cues, string_agg(q.text, ' ' ORDER BY cue_ord) AS text FROM win JOIN seq q USING (video_id, cue_ord) GROUP BY video_id, window_id"))
def x7(m: Model) -> DataFrame:
    X.use_state_store(m.spark)
    # Event time starts well after 1970: rows at the first watermark would count as late.
    start, end = F.col("start_ms") + EPOCH_MS, F.col("end_ms") + EPOCH_MS
    rows = m.cues().where(F.col("text").rlike(r"\S")).select(F.timestamp_millis(start).alias("ts"), F.col("video_id").alias("key"), F.col("cue_ord").cast("long").alias("cue_ord"), start.alias("start_ms"), end.alias("end_ms"), "text")
    return finished(m, X.stream_windows(_closing(m, rows)), "append").where("key <> '-1'").select("key", "first_ord", "last_ord", "n_cues", "text")


@query("x8_once_per_key", "SELECT DISTINCT user_id, event_type FROM events")
def x8(m: Model) -> DataFrame:
    requests = _events(m).select("ts", "user_id", "event_type")
    return finished(m, X.once_per_key(requests, ["user_id", "event_type"], "3650 days"), "append").select("user_id", "event_type")


@query("s7_manifest", sql("results", body="SELECT video_id, clip_index, status, file_size_bytes FROM results"))
def s7(m: Model) -> DataFrame:
    from cueflow.sources.writers import write_manifest

    folder = _folder(m)
    write_manifest(m.results(), folder)
    return m.spark.read.parquet(folder).select("video_id", "clip_index", "status", "file_size_bytes")


@query("s8_status_stream", sql("statuses", body="SELECT run_id, clip_index, status, count(*) AS n FROM statuses GROUP BY ALL"))
def s8(m: Model) -> DataFrame:
    folder = _folder(m)
    m.statuses().select("ts", "run_id", "clip_index", "status").write.parquet(folder)
    counts = read_status_stream(m.spark, folder).groupBy("run_id", "clip_index", "status").agg(F.count("*").alias("n"))
    return finished(m, counts, "complete")


def _updates(m: Model, files: int = 6) -> DataFrame:
    """Status updates as a stream of several batches, two files each."""
    folder = _folder(m)
    rows = m.statuses().select("ts", "event_id", F.col("run_id").alias("video_id"), "clip_index", "status")
    rows.repartition(files, "event_id").write.parquet(folder)
    return m.spark.readStream.schema(m.spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 2).parquet(folder)


def _table(m: Model, updates: DataFrame) -> T.KeyedTable:
    return T.KeyedTable(m.spark, _folder(m), updates.schema, ["video_id", "clip_index"], ["ts", "event_id"])


@query("h4_clip_updates", sql("statuses", body="SELECT run_id AS video_id, clip_index, max(event_id) FILTER (ts = last) AS event_id, arg_max(status, struct_pack(t := ts, e := event_id)) AS status FROM (SELECT *, max(ts) OVER (PARTITION BY run_id, clip_index) AS last FROM statuses) GROUP BY 1, 2"))
def h4(m: Model) -> DataFrame:
    updates = _updates(m)
    table = _table(m, updates)
    total = m.statuses().select(F.col("run_id").alias("video_id"), "clip_index").distinct()
    T.run_with_callbacks(updates, table, total, _folder(m))
    return table.read(m.spark).select("video_id", "clip_index", "event_id", "status")


@query("h4_metrics_table", "SELECT count(*) AS input_rows, 0::BIGINT AS state_rows FROM events")
def h4_metrics(m: Model) -> DataFrame:
    updates = _updates(m)
    metrics = T.MetricsTable(m.spark, _folder(m))
    m.spark.streams.addListener(metrics)
    try:
        run = updates.writeStream.trigger(availableNow=True).option("checkpointLocation", _folder(m)).foreachBatch(_table(m, updates).upsert).start()
        run.awaitTermination()
        metrics.wait(str(run.runId))
    finally:
        m.spark.streams.removeListener(metrics)
    return metrics.read().groupBy("run").agg(F.sum("input_rows").alias("input_rows"), F.max("state_rows").alias("state_rows")).select("input_rows", "state_rows")
