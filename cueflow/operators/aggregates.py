"""Roll-ups per clip, video, run and service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLIP = ("video_id", "clip_index")
#: Mean pitch below which a voice counts as male, and clients that are fallbacks.
MALE_BELOW_HZ = 165.0
FALLBACK_CLIENTS = ("tv", "ios", "android")


def outcome_counts(results: DataFrame) -> DataFrame:
    """Succeeded and failed clips per video."""
    return results.groupBy("video_id").agg(F.count_if(F.col("status") == "Done").alias("succeeded"), F.count_if(F.col("status") == "Failed").alias("failed"))


def cleaning_totals(clip_cues: DataFrame) -> DataFrame:
    """Removed fillers and repetitions per clip, from ``cleaned`` structs."""
    return clip_cues.groupBy(*CLIP).agg(F.sum("cleaned.filler_removed").alias("filler_removed"), F.sum("cleaned.repetitions_removed").alias("repetitions_removed"))


def speaker_count(cues: DataFrame) -> DataFrame:
    """Distinct speakers per clip, one at least."""
    return cues.groupBy(*CLIP).agg(F.greatest(F.lit(1), F.count_distinct("speaker_label")).alias("speakers"))


def first_seen(utterances: DataFrame) -> DataFrame:
    """Earliest start per clip and cluster."""
    return utterances.groupBy(*CLIP, "cluster_id").agg(F.min("start_ms").alias("first_ms"))


def gender_from_pitch(pitch: DataFrame) -> DataFrame:
    """Gender per cluster by its mean voiced pitch; female without any."""
    heard = F.when(F.col("voiced") & ~F.isnan("f0"), F.col("f0"))
    return pitch.groupBy(*CLIP, "cluster_id").agg(F.avg(heard).alias("mean_f0")).withColumn("gender", F.when(F.col("mean_f0") < MALE_BELOW_HZ, "male").otherwise("female"))


def drm_flags(attempts: DataFrame) -> DataFrame:
    """Whether failed fallback attempts before a video's first success spoke of DRM.

    ``drm``: another client than tv did; ``tv_drm``: tv did.
    """
    first_ok = attempts.where("ok").groupBy("video_id").agg(F.min("attempt_no").alias("first_ok"))
    counted = attempts.join(first_ok, "video_id", "left").where((F.col("first_ok").isNull() | (F.col("attempt_no") < F.col("first_ok"))) & ~F.col("ok") & F.col("client").isin(*FALLBACK_CLIENTS))
    drm = F.coalesce(F.contains(F.lower("message"), F.lit("drm protected")), F.lit(False))
    flags = counted.groupBy("video_id").agg(F.bool_or(drm & (F.col("client") != "tv")).alias("drm"), F.bool_or(drm & (F.col("client") == "tv")).alias("tv_drm"))
    return attempts.select("video_id").distinct().join(flags, "video_id", "left").fillna(False, ["drm", "tv_drm"])


def service_health(calls: DataFrame) -> DataFrame:
    """Calls that worked and failed per service, with a note on failures."""
    totals = calls.groupBy("service").agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    return totals.withColumn("note", F.when(F.col("failed") > 0, F.format_string("%d of %d calls failed", "failed", F.col("failed") + F.col("succeeded"))))


def merged_summary(results: DataFrame, file: str = "merged.mp4") -> DataFrame:
    """One row per video with at least two finished clips: what merging them gives."""
    done = results.where("status = 'Done' and output_path is not null")
    totals = done.groupBy("video_id").agg(F.count("*").alias("n_clips"), F.sum("file_size_bytes").alias("file_size_bytes"), F.sum("actual_duration_ms").alias("actual_duration_ms"))
    return totals.where("n_clips >= 2").select("video_id", F.lit(0).alias("clip_index"), F.lit(file).alias("output_filename"), F.lit("Done").alias("status"), "n_clips", "file_size_bytes", "actual_duration_ms")


def overall_progress(runs: DataFrame) -> DataFrame:
    """Percent done of runs(fraction, done, total): 90 for the download, 10 for the clips."""
    clips = 90 + F.floor(F.col("done") / F.greatest(F.col("total"), F.lit(1)) * 10)
    return runs.withColumn("progress", F.when(F.col("fraction") < 1, F.floor(F.col("fraction") * 90)).otherwise(clips).cast("int"))


def windows_per_clip(windowed: DataFrame) -> DataFrame:
    """Cues, windows and cues per window of each clip: how many calls windowing saves."""
    out = windowed.groupBy(*CLIP).agg(F.count("*").alias("cues"), F.count_distinct("window_id").alias("windows"))
    return out.withColumn("cues_per_window", F.col("cues") / F.col("windows"))


def window_rollup(windowed: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """A row per window: joined text, first start, last end, cue list; ``extra`` from its first cue."""
    cue = F.struct("cue_ord", "text", "start_ms", "end_ms", *extra)
    rows = windowed.groupBy(*CLIP, "window_id").agg(F.sort_array(F.collect_list(cue)).alias("cues"))
    first, last = F.element_at("cues", 1), F.element_at("cues", -1)
    return rows.select(
        *CLIP, "window_id", F.transform("cues", lambda c: c["cue_ord"]).alias("cue_ords"), F.array_join(F.transform("cues", lambda c: c["text"]), " ").alias("text"),
        first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"), *[first[c].alias(c) for c in extra],
    )
