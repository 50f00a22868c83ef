"""Keyed tables, metrics and callbacks of running streams."""

import pytest
from pyspark.sql import functions as F

from cueflow.streaming import tables as T

ROW = "video_id string, clip_index int, ts long, status string"


def table_of(spark, tmp_path, **more):
    return T.KeyedTable(spark, f"{tmp_path}/table", spark.createDataFrame([], ROW).schema, ["video_id", "clip_index"], ["ts"], **more)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def rows_of(spark, table):
    return sorted(((r.video_id or "", r.clip_index, r.ts, r.status) for r in table.read(spark).collect()), key=repr)


def test_latest_rows_stay_whatever_the_batches(spark, tmp_path):
    table = table_of(spark, tmp_path, buckets=4)
    assert rows_of(spark, table) == []
    table.upsert(batch(spark, ("a", 1, 5, "Done"), ("a", 1, 3, "Cutting"), (None, 1, 1, "x")), 0)
    table.upsert(batch(spark, ("a", 1, 4, "late"), ("a", 2, 1, "Cutting"), ("b", 1, None, "x"), ("b", 1, None, "y")), 1)
    table.upsert(batch(spark), 2)
    assert rows_of(spark, table) == sorted([("a", 1, 5, "Done"), ("", 1, 1, "x"), ("a", 2, 1, "Cutting"), ("b", 1, None, "y")], key=repr)
    assert table.commit()[0] == 2


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = table_of(spark, tmp_path)
    first = batch(spark, ("a", 1, 1, "Cutting"), ("b", 1, 1, "Cutting"))
    table.upsert(first, 0)
    table.upsert(batch(spark, ("a", 1, 2, "Done")), 1)
    before, files = rows_of(spark, table), sorted(p.name for p in tmp_path.rglob("part-*.parquet"))
    table.upsert(first, 0)
    table.upsert(batch(spark, ("a", 1, 9, "not again")), 1)
    assert rows_of(spark, table) == before and sorted(p.name for p in tmp_path.rglob("part-*.parquet")) == files


def test_a_batch_that_fails_midway_is_not_seen_and_is_done_again(spark, tmp_path, monkeypatch):
    table = table_of(spark, tmp_path)
    table.upsert(batch(spark, ("a", 1, 1, "Cutting"), ("b", 1, 1, "Cutting")), 0)
    second = batch(spark, ("a", 1, 2, "Done"), ("c", 1, 2, "Done"))
    with monkeypatch.context() as broken:
        broken.setattr(T.Files, "write", lambda *_: (_ for _ in ()).throw(OSError("disk full")))
        with pytest.raises(OSError, match="disk full"):
            table.upsert(second, 1)
    assert rows_of(spark, table) == [("a", 1, 1, "Cutting"), ("b", 1, 1, "Cutting")]
    table.upsert(second, 1)
    assert rows_of(spark, table) == [("a", 1, 2, "Done"), ("b", 1, 1, "Cutting"), ("c", 1, 2, "Done")]


def test_only_touched_buckets_are_written_and_old_versions_go(spark, tmp_path):
    table = table_of(spark, tmp_path, buckets=16)
    table.upsert(spark.range(200).select(F.col("id").cast("string").alias("video_id"), F.lit(1).alias("clip_index"), F.lit(0).cast("long").alias("ts"), F.lit("Cutting").alias("status")), 0)
    for n in range(1, 6):
        table.upsert(batch(spark, ("7", 1, n, f"s{n}")), n)
    assert table.read(spark).count() == 200
    versions = {p.name: len([b for b in p.iterdir() if b.name.startswith("bucket=")]) for p in (tmp_path / "table/data").iterdir()}
    assert versions == {"v=0": 15, "v=4": 1, "v=5": 1}
    assert sorted(p.name for p in (tmp_path / "table/commits").iterdir() if p.name.isdigit()) == ["4", "5"]
    assert [r.status for r in table.read(spark).where("video_id = '7'").collect()] == ["s5"]


@pytest.fixture
def updates(spark, tmp_path):
    for i in range(4):
        batch(spark, *[("v", c, i, "Done" if c <= i else "Cutting") for c in range(4)], ("w", 9, i, "Failed")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_callbacks_are_told(spark, tmp_path, updates):
    table, total = table_of(spark, tmp_path), batch(spark, *[("v", c, 0, "") for c in range(4)], ("w", 9, 0, ""), ("x", 1, 0, ""))
    seen, lines, counts = [], [], []

    def updated(rows):
        counts.append(rows.count())
        if len(counts) == 2:
            raise ValueError("user code")

    assert T.run_with_callbacks(updates, table, total, f"{tmp_path}/check", on_progress=lambda p, text: seen.append((p, text)), on_log=lines.append, on_clips_updated=updated)
    assert seen[-1] == (98, "5/6 clips") and [p for p, _ in seen] == sorted(p for p, _ in seen) and len(seen) == 4
    assert counts == [5] * 4 and lines[-1] == "batch 3: 5 of 6 clips, 1 failed" and "a callback failed: ValueError: user code" in lines
    assert rows_of(spark, table) == sorted([("v", c, 3, "Done") for c in range(4)] + [("w", 9, 3, "Failed")], key=repr)


def test_a_cancelled_run_goes_on_later(spark, tmp_path, updates):
    table, total, asked, lines = table_of(spark, tmp_path), batch(spark, ("v", 0, 0, "")), [], []
    assert not T.run_with_callbacks(updates, table, total, f"{tmp_path}/check", is_cancelled=lambda: len(asked) == 2 or asked.append(1), on_log=lines.append)
    assert table.commit()[0] == 1 and lines[-1].startswith("cancelled")
    assert T.run_with_callbacks(updates, table, total, f"{tmp_path}/check")
    assert table.commit()[0] == 3 and len(rows_of(spark, table)) == 5


def test_metrics_of_every_batch(spark, tmp_path, updates):
    metrics = T.MetricsTable(spark, f"{tmp_path}/metrics")
    spark.streams.addListener(metrics)
    try:
        run = updates.groupBy("video_id").count().writeStream.outputMode("complete").format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
        assert metrics.wait(str(run.runId))
    finally:
        spark.streams.removeListener(metrics)
    rows = metrics.read().orderBy("batch").collect()
    assert [r.input_rows for r in rows] == [5] * 4 and rows[-1].state_rows == 2 and {r.run for r in rows} == {str(run.runId)}
