"""Sources of timed text and its metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.functions.text import strip_tags
from cueflow.functions.times import VTT_STAMP, stamp_ms, strip
from cueflow.operators.ranking import first_per
from cueflow.sources.folders import few_listing_tasks

VIDEO_INFO = (
    "id STRING, language STRING, height INT, subtitles MAP<STRING,ARRAY<STRUCT<ext:STRING,url:STRING>>>, "
    "automatic_captions MAP<STRING,ARRAY<STRUCT<ext:STRING,url:STRING>>>, requested_downloads ARRAY<STRUCT<filepath:STRING,_filename:STRING>>"
)
STATUS_EVENT = "ts TIMESTAMP, run_id STRING, clip_index INT, status STRING"
_TIME_LINE = rf"{VTT_STAMP}\s*-->\s*{VTT_STAMP}"


def parse_captions(files: DataFrame) -> DataFrame:
    """files(file_name, value: the whole text) to file_name, cue_ord, start_ms, end_ms, text.

    Blocks stand between blank lines.  A block without a time line is no cue; lines with an
    arrow or of digits only are no text; tags go, white space is single; blank cues go.
    """
    text = F.regexp_replace("value", "\r\n?", "\n")
    blocks = files.select("file_name", F.posexplode(F.split(text, "\n\n")).alias("cue_ord", "block")).where(F.col("block").rlike(_TIME_LINE))
    part = lambda i: F.regexp_extract("block", _TIME_LINE, i)
    kept = F.filter(F.split("block", "\n"), lambda line: ~F.contains(line, F.lit("-->")) & ~strip(line).rlike(r"(?U)^\d+$"))
    cues = blocks.select(
        "file_name", "cue_ord", stamp_ms(part(1), part(2), part(3), part(4)).alias("start_ms"), stamp_ms(part(5), part(6), part(7), part(8)).alias("end_ms"),
        strip_tags(strip(F.array_join(kept, " "))).alias("text"),
    )
    return cues.where(F.col("text") != "")


def whole_texts(spark: SparkSession, glob: str) -> DataFrame:
    """``value`` of whole text files, and the keys that their folders name."""
    with few_listing_tasks(spark):
        return spark.read.text(glob, wholetext=True)


def caption_texts(spark: SparkSession, glob: str) -> DataFrame:
    """file_name and value of whole caption files, named by themselves or by a folder ``file_name=``."""
    files = whole_texts(spark, glob)
    name = F.col("file_name" if "file_name" in files.columns else "_metadata.file_name")
    return files.select(name.cast("string").alias("file_name"), "value")


def caption_file_keys(files: DataFrame) -> DataFrame:
    """``video_id``, ``is_auto`` and ``language`` from ``transcript_<id>.<kind>.<lang>.vtt``."""
    part = lambda i: F.regexp_extract("file_name", r"^transcript_(.+)\.(manual|auto)\.([^.]+)\.vtt$", i)
    keyed = files.withColumns({"video_id": part(1), "is_auto": part(2) == "auto", "language": part(3)})
    return keyed.where("video_id <> ''")


def first_caption_files(cues: DataFrame) -> DataFrame:
    """One file per video of those that hold cues: the first of each kind, manual before automatic."""
    files = caption_file_keys(cues.select("file_name").distinct())
    return first_per(files, ["video_id"], F.col("is_auto"), F.col("file_name"))


def read_captions(spark: SparkSession, glob: str) -> DataFrame:
    """video_id, language, is_auto, cue_ord, start_ms, end_ms, text of each video's caption file."""
    cues = caption_file_keys(parse_captions(caption_texts(spark, glob)))
    # Files are read once: the cues of a video say which of its files comes first.
    file = F.struct("is_auto", "file_name")
    first = F.min(file).over(Window.partitionBy("video_id"))
    return cues.withColumn("first", first).where(file == F.col("first")).drop("first", "file_name")


def read_video_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIDEO_INFO).json(path)


def info_tracks(info: DataFrame) -> DataFrame:
    """video_id, ord, language, entries, is_auto, original_language of every caption track."""
    listed = []
    for column, auto in (("subtitles", False), ("automatic_captions", True)):
        track = info.select(F.col("id").alias("video_id"), F.col("language").alias("original_language"), F.posexplode(F.map_entries(column)).alias("ord", "e"))
        listed.append(track.select("video_id", "ord", F.col("e.key").alias("language"), F.col("e.value").alias("entries"), F.lit(auto).alias("is_auto"), "original_language"))
    return listed[0].unionByName(listed[1])


def read_clip_notes(boxes: DataFrame) -> DataFrame:
    """boxes(video_id, box_ord, text) to one text per video: stripped, blank ones skipped, in order."""
    kept = boxes.withColumn("text", strip(F.col("text"))).where(F.col("text") != "")
    ordered = F.sort_array(F.collect_list(F.struct("box_ord", "text")))
    return kept.groupBy("video_id").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("text"))


def media_keys(files: DataFrame) -> DataFrame:
    """``video_id`` and ``resolution`` from ``source_<id>_<resolution>.<ext>``; other names go."""
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    part = lambda i: F.regexp_extract(stem, r"^source_(.+)_(best|\d+)$", i)
    return files.withColumns({"video_id": part(1), "resolution": part(2)}).where("video_id <> ''")


def read_media_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime, video_id, resolution; contents aren't read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "source_*").load(folder)
    return media_keys(listed.select("path", "length", "modificationTime"))


def read_status_stream(spark: SparkSession, path: str, schema: str = STATUS_EVENT) -> DataFrame:
    """Status events that arrive as Parquet files (Kafka takes their place in production)."""
    return spark.readStream.schema(schema).parquet(path)
