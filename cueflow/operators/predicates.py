"""Projections, filters and classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.functions.display import TEMPORARY_SUFFIXES, format_filesize, output_filename, transcript_preview
from cueflow.functions.text import clean_log_message
from cueflow.functions.times import format_duration, strip

# Limits and message markers.
MIN_SPEECH_MS, MIN_ARTIFACT_MS, MIN_SLOT_MS = 350, 1000, 50
SLOWEST, FASTEST = 0.90, 1.15
COOKIE_MARKERS = (
    "could not copy", "cookie database", "could not find", "failed to load cookies", "could not decrypt",
    "cookies file", "no such file", "does not exist", "unsupported cookies file",
)


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Half-open intervals with a common part."""
    return (end_a > start_b) & (start_a < end_b)


def valid_clip_range(clips: DataFrame) -> DataFrame:
    """Clips that end after they start; unparsable (null) stamps go."""
    return clips.where("end_ms > start_ms")


def drop_blank_cues(cues: DataFrame, column: str = "text") -> DataFrame:
    return cues.where(F.length(strip(F.col(column))) > 0)


def completed_media(files: DataFrame) -> DataFrame:
    """Files with content whose suffix isn't a temporary one."""
    suffix = F.lower(F.regexp_extract("path", r"(?<=[^/])(\.[^./]+)$", 1))
    return files.where((F.col("length") > 0) & ~suffix.isin(*TEMPORARY_SUFFIXES))


def min_duration(segments: DataFrame, least_ms: int = MIN_SPEECH_MS) -> DataFrame:
    return segments.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def validate_artifacts(artifacts: DataFrame, least_ms: int = MIN_ARTIFACT_MS) -> DataFrame:
    """``valid`` and ``reason`` for artifacts(exists, length, duration_ms)."""
    reason = (
        F.when(~F.coalesce("exists", F.lit(False)), "missing").when(F.coalesce("length", F.lit(0)) <= 0, "empty")
        .when(F.col("duration_ms").isNull(), "unknown_duration").when(F.col("duration_ms") < least_ms, "too_short")
    )
    return artifacts.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def needs_reencode(plans: DataFrame) -> DataFrame:
    """Whether a clip plan (watermark, audio_mode, music, dub, subtitles) needs more than a copy."""
    audio = (F.coalesce("audio_mode", F.lit("none")) != "none") | F.coalesce("music", F.lit(False)) | F.coalesce("dub", F.lit(False))
    return plans.withColumn("reencode", F.coalesce("watermark", F.lit(False)) | audio | F.coalesce("subtitles", F.lit(False)))


def rebase_to_clip(clip_cues: DataFrame) -> DataFrame:
    """Times relative to the clip's start."""
    return clip_cues.withColumns({"rel_start_ms": F.col("start_ms") - F.col("clip_start_ms"), "rel_end_ms": F.col("end_ms") - F.col("clip_start_ms")})


def clamp_to_clip(clip_cues: DataFrame) -> DataFrame:
    """Times cut to the clip; cues with nothing left or no text go."""
    cut = clip_cues.withColumns({"start_ms": F.greatest("start_ms", "clip_start_ms"), "end_ms": F.least("end_ms", "clip_end_ms")})
    return drop_blank_cues(cut.where("end_ms > start_ms"))


def fit_to_slot(windows: DataFrame) -> DataFrame:
    """``ratio`` that fits speech of raw_ms into its window, and the ``delay_ms`` of its placement."""
    slot = F.greatest(F.lit(MIN_SLOT_MS), F.col("end_ms") - F.col("start_ms"))
    ratio = F.greatest(F.lit(SLOWEST), F.least(F.lit(FASTEST), F.col("raw_ms") / slot))
    return windows.withColumns({"ratio": F.when(F.col("raw_ms") > 0, ratio).otherwise(1.0), "delay_ms": F.greatest(F.lit(0), F.col("start_ms"))})


def classify_attempt_error(message: Column) -> Column:
    """Kind of failure that a log message tells of, by ordered rules."""
    text = F.lower(clean_log_message(message))
    has = lambda *marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))
    return (
        F.when(text.isNull(), None).when(has("cookie") & has(*COOKIE_MARKERS), "cookie").when(has("403", "forbidden"), "forbidden")
        .when(has("format is not available", "format not available"), "format_unavailable").when(has("private", "unavailable", "removed"), "video_unavailable")
        .when(has("network", "urlopen", "timed out"), "network").otherwise("other")
    )


def diagnose_height(downloads: DataFrame) -> DataFrame:
    """Why a download (height, requested, drm, tv_drm) is no taller than it is."""
    height, requested = F.col("height"), F.col("requested")
    diagnosis = (
        F.when(F.coalesce("drm", F.lit(False)), "drm").when(F.coalesce("tv_drm", F.lit(False)), "tv_false_positive")
        .when((height <= 360) & (requested.isNull() | (requested > 360)), "cap_360").when(height < requested, "lower_than_requested").otherwise("ok")
    )
    return downloads.withColumn("diagnosis", F.when(height.isNull(), None).otherwise(diagnosis))


def translation_fallback(translated: Column, cleaned: Column) -> Column:
    """The translation, or the cleaned source text where that is blank."""
    return F.coalesce(F.nullif(strip(translated), F.lit("")), cleaned)


def summary_row(results: DataFrame) -> DataFrame:
    """The display row of every result: file, duration, size, status and transcript preview."""
    return results.select(
        "video_id", "clip_index", output_filename(F.col("output_filename"), F.col("clip_index")).alias("file"),
        F.coalesce(format_duration(F.col("actual_duration_ms")), F.lit("-")).alias("duration"),
        format_filesize(F.col("file_size_bytes")).alias("size"),
        F.when(F.col("status") == "Done", "✓ Done").otherwise("✗ Failed").alias("status_label"),
        transcript_preview(F.col("transcript"), F.col("language"), F.col("is_auto")).alias("transcript"),
    )
