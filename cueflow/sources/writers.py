"""Subtitle files and result manifests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.functions.times import format_srt
from cueflow.operators.sequences import CLIP, srt_numbering
from cueflow.sources.folders import emptied_mounted_folder


def srt_texts(clip_cues: DataFrame) -> DataFrame:
    """One SRT text per clip with cues(rel_start_ms, rel_end_ms, translated)."""
    block = F.concat(F.col("srt_no").cast("string"), F.lit("\n"), format_srt(F.col("rel_start_ms")), F.lit(" --> "), format_srt(F.col("rel_end_ms")), F.lit("\n"), F.col("translated"), F.lit("\n"))
    blocks = srt_numbering(clip_cues).withColumn("block", block).groupBy(*CLIP).agg(F.sort_array(F.collect_list(F.struct("srt_no", "block"))).alias("blocks"))
    return blocks.select(*CLIP, F.array_join(F.transform("blocks", lambda b: b["block"]), "\n").alias("srt"))


def write_srt(clip_cues: DataFrame, path: str) -> None:
    """A text file in ``path/video_id=/clip_index=`` per clip; clips without cues have none."""
    write_texts(srt_texts(clip_cues), path, *CLIP)


def write_texts(texts: DataFrame, path: str, *keys: str) -> None:
    """A text file in ``path/key=/...`` per row of texts(keys..., text); rows of equal keys share one.

    A file costs far more than its bytes, so the number of tasks is set: by bytes, adaptive
    execution would leave one task for thousands of files.  Below a path that is mounted,
    tasks write the files themselves, as Hadoop's local file system starts processes for each
    (``chmod``, of the file and of its checksum).  Elsewhere Spark writes them, and each task
    moves its files into place as it ends; by Hadoop's older rule the driver would move all of
    them, one after the other, behind the last task.  A run that fails leaves files, but no
    ``_SUCCESS``.
    """
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(tasks, *keys)
    folder = emptied_mounted_folder(texts.sparkSession, path)
    if folder is None:
        files = dealt.write.partitionBy(*keys).option("lineSep", "\n")
        files.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("overwrite").text(path)
        return
    value = next(c for c in texts.columns if c not in keys)
    named = dealt.select(*[F.col(k).cast("string") for k in keys], F.col(value).alias("value")).sortWithinPartitions(*keys)
    named.mapInArrow(_written(folder, keys), "files long").write.format("noop").mode("overwrite").save()
    Path(folder, "_SUCCESS").touch()


def _written(folder: str, keys: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes rows (keys..., value), sorted by keys, below ``folder``; a file appears when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        files = 0
        for names, same in groupby(rows, lambda row: row[:-1]):
            place = Path(folder, *(f"{k}={_folder_name(v)}" for k, v in zip(keys, names, strict=True)))
            place.mkdir(parents=True, exist_ok=True)
            begun = place / f".part-{task.partitionId():05d}-{task.taskAttemptId()}"
            with begun.open("wb") as out:
                for *_, text in same:
                    out.write((text or "").encode() + b"\n")
            begun.replace(place / f"part-{task.partitionId():05d}.txt")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return run


def _folder_name(value: str | None) -> str:
    """A key's value in a path, as Spark writes and reads it."""
    return re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def write_manifest(results: DataFrame, path: str) -> None:
    """Result rows as Parquet, by status."""
    results.write.partitionBy("status").mode("overwrite").parquet(path)


def write_captions(files: DataFrame, path: str) -> None:
    """files(file_name, value) as a text in ``path/file_name=`` each, which ``read_captions`` reads."""
    write_texts(files, path, "file_name")
