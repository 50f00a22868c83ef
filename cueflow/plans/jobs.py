"""The jobs that users run, composed of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.functions.text import apply_opener, clean_cue
from cueflow.hooks import SYNTHESIS, TRANSLATION, Limits, synthesize_with, translate_with
from cueflow.operators.aggregates import CLIP, cleaning_totals, drm_flags, first_seen, gender_from_pitch, merged_summary, outcome_counts, window_rollup
from cueflow.operators.joins import assign_speaker, attach_artifacts, attach_excerpt, attach_voice, clip_cue_join, interval_join, opener_lookup, reuse_cached_source
from cueflow.operators.predicates import clamp_to_clip, diagnose_height, drop_blank_cues, fit_to_slot, rebase_to_clip, summary_row, translation_fallback
from cueflow.operators.ranking import pick_format, pick_track, pick_track_url
from cueflow.operators.sequences import (
    assign_voices, dedupe_rolling, dub_windows, merge_rolling_text, merge_short_cues, number_speakers, speech_islands, split_by_word_ratio, translation_windows,
)
from cueflow.operators.sets import merge_only, with_merged_row
from cueflow.operators.vectors import speaker_clusters
from cueflow.sources.folders import new_folder
from cueflow.sources.readers import info_tracks


def _cleaned(cues: DataFrame) -> DataFrame:
    """cues with the struct ``cleaned``; generated, so that a filter on it doesn't evaluate the chain again."""
    return cues.select("*", F.explode(F.array(clean_cue(F.col("text")))).alias("cleaned"))


def _kept(cleaned: DataFrame) -> DataFrame:
    return cleaned.where("not cleaned.dropped").withColumn("text", F.col("cleaned.text")).drop("cleaned")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what reads it several times doesn't make it again."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def clean_corpus(cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned cues (blank ones dropped) and the totals of what went, per clip.

    The chain runs once: its result is stored, and both read it.  It costs far more than
    moving a cue, so cues are spread evenly first, whatever files or clips they come from.
    """
    cleaned = stored(_cleaned(cues.repartition(*CLIP, "cue_ord")), "cleaned")
    return _kept(cleaned), cleaning_totals(cleaned)


def clip_cues(cues: DataFrame, clips: DataFrame, bin_ms: int | None = None) -> DataFrame:
    """The cues of each clip: rolling text and short cues merged, times cut to the clip."""
    joined = clip_cue_join(cues, clips, bin_ms)
    return clamp_to_clip(merge_short_cues(dedupe_rolling(joined)))


def clip_excerpts(cues: DataFrame, clips: DataFrame, bin_ms: int | None = None) -> DataFrame:
    """video_id, clip_index, excerpt, n_words: the de-duplicated text of each clip."""
    return merge_rolling_text(clip_cue_join(cues, clips, bin_ms))


def subtitle_windows(cues: DataFrame, clips: DataFrame, bin_ms: int | None = None) -> DataFrame:
    """A row per translation window of each clip, with its cleaned cues (times included) and their joined text."""
    windowed = translation_windows(_kept(_cleaned(clip_cues(cues, clips, bin_ms))))
    cue = F.struct("cue_ord", "text", "start_ms", "end_ms", "clip_start_ms")
    rows = windowed.groupBy(*CLIP, "window_id").agg(F.sort_array(F.collect_list(cue)).alias("cues"))
    return rows.withColumn("text", F.array_join(F.transform("cues", lambda c: c["text"]), " "))


def subtitles(cues: DataFrame, clips: DataFrame, translate_fn: Callable[[str], str], limits: Limits = TRANSLATION, bin_ms: int | None = None) -> DataFrame:
    """Translated cues of each clip, times relative to it: window by window, text given back by word ratio.

    Cues travel with their windows, so nothing is joined back to them.  The windows are stored
    once: the distinct texts to translate and the rows that take the results read that table.
    """
    windows = opener_lookup(stored(subtitle_windows(cues, clips, bin_ms), "windows"))
    spoken = translate_with(windows.select(*CLIP, "window_id", "cues", "opener", F.col("remainder").alias("text")), translate_fn, limits=limits)
    whole = spoken.withColumn("translated", apply_opener(F.col("opener"), F.coalesce("translated", F.lit(""))))
    timed = rebase_to_clip(split_by_word_ratio(whole))
    return timed.select(*CLIP, "cue_ord", "rel_start_ms", "rel_end_ms", translation_fallback(F.col("part"), F.col("text")).alias("translated"), F.col("text").alias("original"))


def dub_plan(clip_cues: DataFrame, segments: DataFrame, synthesize_fn: Callable[[str, str, str], str], raw_ms: DataFrame | None = None, limits: Limits = SYNTHESIS) -> DataFrame:
    """Dub windows with voice, pitch, result of the synthesis, fit ratio and delay.

    ``raw_ms``: lengths by result, where they are known.
    """
    spoken = assign_speaker(drop_blank_cues(clip_cues), segments)
    windows = window_rollup(dub_windows(spoken, segments), ("speaker_label",))
    voiced = attach_voice(windows, assign_voices(segments))
    made = synthesize_with(voiced, synthesize_fn, limits=limits)
    timed = made.join(raw_ms, "result", "left") if raw_ms is not None else made.withColumn("raw_ms", F.lit(None).cast("long"))
    return fit_to_slot(timed)


def speaker_segments(frames: DataFrame, embeddings: DataFrame, pitch: DataFrame) -> DataFrame:
    """Speech intervals with speaker label and gender.

    embeddings(utt_id, embedding): one per interval, utt_id being its number; pitch(cluster_id
    is filled here from t_ms).
    """
    speech = speech_islands(frames)
    clusters = speaker_clusters(embeddings).select(*CLIP, F.col("utt_id").alias("seg_idx"), "cluster_id")
    known = speech.join(clusters, [*CLIP, "seg_idx"])
    labels = number_speakers(first_seen(known)).select(*CLIP, "cluster_id", "speaker_label")
    sampled = pitch.withColumn("start_ms", F.col("t_ms")).withColumn("end_ms", F.col("t_ms") + 1)
    heard = interval_join(sampled.drop("cluster_id"), known.select(*CLIP, "cluster_id", "start_ms", "end_ms"), list(CLIP))
    genders = gender_from_pitch(heard).select(*CLIP, "cluster_id", "gender")
    named = known.join(labels, [*CLIP, "cluster_id"]).join(genders, [*CLIP, "cluster_id"], "left")
    return named.select(*CLIP, "seg_idx", "start_ms", "end_ms", "speaker_label", F.coalesce("gender", F.lit("female")).alias("gender"))


def run_summary(results: DataFrame, excerpts: DataFrame, tracks: DataFrame, subtitles: DataFrame, dubs: DataFrame, keep_clips: bool = True) -> tuple[DataFrame, DataFrame]:
    """The summary table (merged outputs included) and the outcome counts."""
    merged = merged_summary(results)
    rows = results if keep_clips else merge_only(results, merged)
    full = attach_artifacts(attach_excerpt(rows, excerpts, tracks), subtitles, dubs)
    table = with_merged_row(full, merged.drop("n_clips"))
    return summary_row(table), outcome_counts(results)


def select_sources(info: DataFrame, requests: DataFrame, files: DataFrame, formats: DataFrame, attempts: DataFrame, height: int | None = None) -> dict[str, DataFrame]:
    """Caption track, cached and missing sources, format and diagnosis of each video."""
    track = pick_track(info_tracks(info)).withColumn("url", pick_track_url(F.col("entries"))).drop("entries")
    cached, missing = reuse_cached_source(requests, files)
    flags = drm_flags(attempts)
    heights = info.select(F.col("id").alias("video_id"), "height", F.lit(height).cast("int").alias("requested"))
    return {"tracks": track, "cached": cached, "missing": missing, "formats": pick_format(formats, height), "diagnosis": diagnose_height(heights.join(flags, "video_id", "left"))}

