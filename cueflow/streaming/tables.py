"""Live tables and callbacks: a keyed table that batches are merged into, a table of a query's
metrics, and a run that tells its caller how it goes.

A keyed table lies in BUCKETS buckets of its keys.  A batch rewrites the buckets that it
touches, under its own number, and then puts a commit in place: a small file that says which
version of each bucket counts.  Before the commit readers see nothing of the batch, and a
batch that failed midway is written again; a batch whose number is committed is left alone, so
a replay changes nothing.  Versions that neither the last commit nor the one before it needs
are deleted.  One writer at a time.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from cueflow.operators.aggregates import overall_progress

BUCKETS = 64


class Files:
    """Small files and folders of whatever file system a path is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        if not self._fs.exists(self._at(name)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The file as a whole, or not at all: it is renamed into place."""
        folder, _, last = name.rpartition("/")
        part = f"{folder}/.{last}.part"
        stream = self._fs.create(self._at(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._fs.delete(self._at(name), False)
        if not self._fs.rename(self._at(part), self._at(name)):
            raise OSError(f"{part} could not be renamed to {name} in {self.path}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class KeyedTable:
    """The latest row of each key, in Parquet; ``upsert`` is a foreachBatch function.

    ``order``: the columns that say which of two rows of a key is later; among rows that are
    equal in them the greatest of the other columns stays, so a result doesn't depend on how
    rows fall into batches.  Null keys are keys.  Columns must be comparable (no maps).
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.files, self.schema, self.keys, self.order, self.buckets = Files(spark, path), schema, keys, order, buckets

    def commit(self) -> tuple[int, dict[str, int]]:
        """The number of the last committed batch (-1 before the first) and the version of each bucket."""
        numbers = self._numbers()
        return (numbers[-1], json.loads(self.files.read(f"commits/{numbers[-1]}"))) if numbers else (-1, {})

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self.files.names("commits") if n.isdigit())

    def _versions(self, spark: SparkSession, versions: dict[str, int]) -> DataFrame:
        paths = [f"{self.files.path}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """The table as of the last commit."""
        return self._versions(spark, self.commit()[1])

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Combined before it shuffles: a key of many rows is no burden."""
        others = [c for c in self.schema.names if c not in (*self.keys, *self.order)]
        last = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *others)).alias("_last"))
        return last.select(*[F.col(k) for k in self.keys], "_last.*").select(*self.schema.names)

    def upsert(self, batch: DataFrame, number: int) -> None:
        spark, bucket = batch.sparkSession, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        done, versions = self.commit()
        if number <= done:
            return
        # Read twice, so it is kept: the source is read once.
        batch = self._latest(batch.select(*self.schema.names)).persist()
        try:
            # At most one row per bucket comes to the driver.
            touched = [str(r.b) for r in batch.select(bucket.alias("b")).distinct().collect()]
            if touched:
                old = self._versions(spark, {b: versions[b] for b in touched if b in versions})
                merged = self._latest(old.unionByName(batch)).withColumn("bucket", bucket)
                merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.files.path}/data/v={number}")
        finally:
            batch.unpersist()
        self.files.write(f"commits/{number}", json.dumps(versions | {b: number for b in touched}))
        self._clean()

    def _clean(self) -> None:
        """Deletes what the last two commits don't need."""
        numbers = self._numbers()
        needed = {(b, v) for n in numbers[-2:] for b, v in json.loads(self.files.read(f"commits/{n}")).items()}
        for v in self.files.names("data"):
            buckets = [b for b in self.files.names(f"data/{v}") if b.startswith("bucket=")]
            kept = [b for b in buckets if (b.removeprefix("bucket="), int(v.removeprefix("v="))) in needed]
            for b in buckets if kept else []:
                if b not in kept:
                    self.files.delete(f"data/{v}/{b}")
            if not kept:
                self.files.delete(f"data/{v}")
        for n in numbers[:-2]:
            self.files.delete(f"commits/{n}")


class MetricsTable(StreamingQueryListener):
    """Writes a row of metrics for every batch of every query: a file each, named by run and batch, so a repeated event changes nothing."""

    SCHEMA = "id string, run string, batch long, at timestamp, input_rows long, rows_per_second double, duration_ms long, state_rows long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files, self.ended = spark, Files(spark, path), threading.Condition()
        self._runs: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        row = {
            "id": str(p.id), "run": str(p.runId), "batch": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond,
            "duration_ms": p.batchDuration, "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
        }
        if p.numInputRows:
            self.files.write(f"{p.runId}-{p.batchId}.json", json.dumps(row))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.ended:
            self._runs[str(event.runId)] = event.exception
            self.ended.notify_all()

    def wait(self, run: str, seconds: float = 60) -> bool:
        """Whether the run's last event has come; events follow a query with a delay."""
        with self.ended:
            return self.ended.wait_for(lambda: run in self._runs, seconds)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).json(self.files.path)


class Cancelled(Exception):
    """Ends a run whose caller wants no more; the batch that it meets stays uncommitted."""


def run_with_callbacks(
    updates: DataFrame, table: KeyedTable, total: DataFrame, checkpoint: str, *,
    on_progress: Callable[[int, str], None] | None = None, on_log: Callable[[str], None] | None = None,
    on_clips_updated: Callable[[DataFrame], None] | None = None, is_cancelled: Callable[[], bool] | None = None,
) -> bool:
    """Merges a stream of updates(video_id, clip_index, status, ...) into ``table`` until no input is left; False if it was cancelled.

    Before each batch ``is_cancelled`` is asked: a cancelled run stops without that batch, a
    later run with the same checkpoint takes it up.  After each batch ``on_clips_updated`` gets the
    batch's rows as a DataFrame, ``on_progress`` the percent of ``total`` (video_id, clip_index)
    that has an outcome, from 90 on as downloads are behind, and ``on_log`` a line of counts.  A callback
    that fails is logged and doesn't stop the run.
    """
    log = on_log or (lambda line: None)

    def told(call: Callable | None, *args) -> None:
        try:
            if call:
                call(*args)
        except Exception as e:  # noqa: BLE001 - the caller's code must not end the run
            log(f"a callback failed: {type(e).__name__}: {e}")

    def each(batch: DataFrame, number: int) -> None:
        if is_cancelled and is_cancelled():
            raise Cancelled
        table.upsert(batch, number)
        told(on_clips_updated, batch)
        if on_progress or on_log:
            known = table.read(batch.sparkSession).select("video_id", "clip_index", "status")
            state = total.select("video_id", "clip_index").join(known, ["video_id", "clip_index"], "left")
            counts = state.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("Done", "Failed")).alias("done"), F.count_if(F.col("status") == "Failed").alias("failed"))
            now = overall_progress(counts.withColumn("fraction", F.lit(1.0))).first()
            told(on_progress, now.progress, f"{now.done}/{now.total} clips")
            log(f"batch {number}: {now.done} of {now.total} clips, {now.failed} failed")

    query = updates.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    try:
        query.awaitTermination()
    except Exception as e:  # noqa: BLE001 - Spark wraps what foreachBatch raises
        if "Cancelled" not in str(e):
            raise
        log("cancelled; the remaining updates are skipped")
        return False
    return True
