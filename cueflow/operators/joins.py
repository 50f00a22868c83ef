"""Interval joins, lookups and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.functions.display import extract_video_id
from cueflow.functions.text import language_code, opener, without_opener
from cueflow.functions.times import parse_timestamp_ms, strip
from cueflow.operators.predicates import completed_media

CLIP = ("video_id", "clip_index")


def binned(df: DataFrame, bin_ms: int, start: str, end: str) -> DataFrame:
    """A row for each time bin that [start, end) touches, with the first of them."""
    first, last = F.expr(f"`{start}` div {bin_ms}"), F.expr(f"greatest(`{start}`, `{end}` - 1) div {bin_ms}")
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], bin_ms: int | None = None) -> DataFrame:
    """Pairs of rows with equal keys and overlapping [start_ms, end_ms); right's times get the prefix ``r_``.

    Without bins Spark joins on the keys and tests every pair of a key.  ``bin_ms`` cuts both
    sides into time bins first, for keys with long histories; a pair counts in the first
    bin that both share, so it appears once.
    """
    moved = right.withColumnRenamed("start_ms", "r_start_ms").withColumnRenamed("end_ms", "r_end_ms")
    meet = (F.col("end_ms") > F.col("r_start_ms")) & (F.col("start_ms") < F.col("r_end_ms"))
    if bin_ms is None:
        return left.join(moved, keys).where(meet)
    a = binned(left, bin_ms, "start_ms", "end_ms")
    b = binned(moved, bin_ms, "r_start_ms", "r_end_ms").withColumnRenamed("_first", "_r_first")
    return a.join(b, [*keys, "_bin"]).where(meet & (F.col("_bin") == F.greatest("_first", "_r_first"))).drop("_bin", "_first", "_r_first")


def clip_cue_join(cues: DataFrame, clips: DataFrame, bin_ms: int | None = None) -> DataFrame:
    """All cues that overlap each clip of their video, with the clip's bounds."""
    joined = interval_join(cues, clips.select("video_id", "clip_index", "start_ms", "end_ms"), ["video_id"], bin_ms)
    return joined.withColumnRenamed("r_start_ms", "clip_start_ms").withColumnRenamed("r_end_ms", "clip_end_ms")


def _best_segment(cues: DataFrame, segments: DataFrame, value: str, name: str, bin_ms: int | None) -> DataFrame:
    """Per cue the ``value`` of the segment with the largest overlap; the earliest wins ties."""
    own = [c for c in ("video_id", "clip_index", "cue_ord") if c in cues.columns]
    keys = [k for k in CLIP if k in cues.columns and k in segments.columns]
    right = segments.select(*keys, "seg_idx", "start_ms", "end_ms", *({value} - {"seg_idx"}))
    met = interval_join(cues.select(*own, "start_ms", "end_ms"), right, keys, bin_ms)
    overlap = F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")
    best = met.groupBy(*own).agg(F.max_by(value, F.struct(overlap, -F.col("seg_idx"))).alias(name))
    return cues.join(best, own, "left")


def assign_speaker(cues: DataFrame, segments: DataFrame, bin_ms: int | None = None) -> DataFrame:
    """Cues with the ``speaker_label`` of their best segment; null without an overlap."""
    return _best_segment(cues.drop("speaker_label"), segments, "speaker_label", "speaker_label", bin_ms)


def assign_segment(cues: DataFrame, segments: DataFrame, bin_ms: int | None = None) -> DataFrame:
    """Cues with the index of their best segment as ``segment``; null without an overlap."""
    return _best_segment(cues, segments, "seg_idx", "segment", bin_ms)


def attach_voice(windows: DataFrame, voices: DataFrame, keys: tuple[str, ...] = CLIP, default_voice: str = "female", default_pitch: str = "+0Hz") -> DataFrame:
    """Voice and pitch by speaker label; a default for unknown and missing labels."""
    chosen = voices.select(*keys, "speaker_label", "voice", "pitch")
    return windows.join(chosen, [*keys, "speaker_label"], "left").withColumns({"voice": F.coalesce("voice", F.lit(default_voice)), "pitch": F.coalesce("pitch", F.lit(default_pitch))})


def attach_excerpt(results: DataFrame, excerpts: DataFrame, tracks: DataFrame) -> DataFrame:
    """Results with transcript (null if empty), is_auto and language."""
    text = excerpts.select(*CLIP, F.nullif(F.col("excerpt"), F.lit("")).alias("transcript"))
    return results.join(text, list(CLIP), "left").join(tracks.select("video_id", "is_auto", "language"), "video_id", "left")


def attach_artifacts(results: DataFrame, subtitles: DataFrame, dubs: DataFrame) -> DataFrame:
    """Results with the paths of their subtitle and dub, where there are any."""
    first = subtitles.select(*CLIP, F.col("path").alias("subtitle_path"))
    second = dubs.select(*CLIP, F.col("path").alias("dub_path"))
    return results.join(first, list(CLIP), "left").join(second, list(CLIP), "left")


def pending_work(items: DataFrame, cache: DataFrame, key: tuple[str, ...] = ("text", "voice", "pitch")) -> DataFrame:
    """Distinct keys (text stripped, not blank) that the cache doesn't hold."""
    wanted = items.withColumn("text", strip(F.col("text"))).where(F.col("text") != "").select(*key).distinct()
    return wanted.join(cache.select(*key), list(key), "left_anti")


def fan_out_results(items: DataFrame, results: DataFrame, key: tuple[str, ...] = ("text", "voice", "pitch")) -> DataFrame:
    """Every item with the one result of its key."""
    extra = [c for c in results.columns if c not in key]
    computed = results.select(*[F.col(k).alias(f"_{k}") for k in key], *extra)
    same = F.lit(True)
    for k in key:
        same = same & ((strip(F.col(k)) if k == "text" else F.col(k)) == F.col(f"_{k}"))
    return items.join(computed, same, "left").drop(*[f"_{k}" for k in key])


def opener_lookup(windows: DataFrame, column: str = "text") -> DataFrame:
    """``opener`` (the set phrase, null for none) and ``remainder`` of every text."""
    return windows.withColumns({"opener": opener(F.col(column)), "remainder": without_opener(F.col(column))})


def lang_alias_lookup(tracks: DataFrame, column: str = "language") -> DataFrame:
    return tracks.withColumn("source_lang", language_code(F.col(column)))


def reuse_cached_source(requests: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (url, resolution) that a completed file serves, and those to fetch."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    done = completed_media(files).select(F.regexp_extract(name, r"^source_(.+)_(best|\d+)\.[^.]+$", 1).alias("video_id"), F.regexp_extract(name, r"^source_(.+)_(best|\d+)\.[^.]+$", 2).alias("resolution"))
    done = done.where("video_id <> ''").distinct()
    keyed = requests.withColumn("video_id", extract_video_id(F.col("url")))
    return keyed.join(done, ["video_id", "resolution"], "left_semi"), keyed.join(done, ["video_id", "resolution"], "left_anti")


def apply_status_updates(rows: DataFrame, updates: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Rows with the updates' status where one matches; updates of unknown rows are ignored."""
    new = updates.select(*keys, F.col("status").alias("_status"))
    return rows.join(new, list(keys), "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


# What notes mark starts, ends and labels with.
_TOKEN = r"(\d{1,2}(?::\d{2}){1,2})"
START_NOTE = rf"(?iU)start\s*time\s*[:\-]?\s*\n?\s*{_TOKEN}"
END_NOTE = rf"(?iU)end\s*time\s*[:\-]?\s*\n?\s*{_TOKEN}"
LABEL_NOTE = r"(?iU)clip\s*#?\s*(\d+)"


def zip_pairs(notes: DataFrame) -> DataFrame:
    """notes(video_id, text) to (video_id, pair_no, start_ms, end_ms, label_no): Nth start with Nth end."""
    found = notes.select(
        "video_id", F.regexp_extract_all("text", F.lit(START_NOTE), F.lit(1)).alias("starts"),
        F.regexp_extract_all("text", F.lit(END_NOTE), F.lit(1)).alias("ends"), F.regexp_extract_all("text", F.lit(LABEL_NOTE), F.lit(1)).alias("labels"),
    )
    n = F.least(F.size("starts"), F.size("ends"))
    # Parsed before they become rows, so that a filter on times doesn't parse them again.
    pairs = F.arrays_zip(F.slice("starts", F.lit(1), n).alias("s"), F.slice("ends", F.lit(1), n).alias("e"))
    parsed = F.transform(pairs, lambda p: F.struct(parse_timestamp_ms(p["s"]).alias("start_ms"), parse_timestamp_ms(p["e"]).alias("end_ms")))
    each = found.select("video_id", "labels", F.posexplode(parsed).alias("pair_no", "p"))
    return each.select("video_id", "pair_no", "p.start_ms", "p.end_ms", F.try_element_at("labels", F.col("pair_no") + 1).alias("label_no"))
