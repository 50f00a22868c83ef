"""Picks by preference, and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.operators.predicates import completed_media

#: Preferred languages after the original, and clients by order of trial.
PREFERRED_LANGUAGES = ("vi", "en")
CLIENT_ORDER = ("default", "tv", "ios", "android")
#: Buckets of paths that are counted, and rows of a bucket that stay together.
BUCKETS, SPREAD = 1 << 16, 100_000


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def pick_track(tracks: DataFrame) -> DataFrame:
    """One caption track per video, for tracks(video_id, ord, language, is_auto, original_language).

    Original manual, original automatic, then preferred languages manual and automatic, the
    first manual, the first automatic.
    """
    language, auto = F.col("language"), F.col("is_auto")
    own = language == F.col("original_language")
    rank = F.when(own & ~auto, 0).when(own, 1)
    for i, code in enumerate(PREFERRED_LANGUAGES):
        rank = rank.when((language == code) & ~auto, 2 + i)
    for i, code in enumerate(PREFERRED_LANGUAGES):
        rank = rank.when((language == code) & auto, 2 + len(PREFERRED_LANGUAGES) + i)
    rank = rank.when(~auto, 98).otherwise(99)
    return first_per(tracks, ["video_id"], rank, F.col("ord"))


def pick_track_url(entries: Column) -> Column:
    """URL of the first VTT entry of array<struct<ext, url>>, else of the first entry."""
    return F.coalesce(F.get(F.filter(entries, lambda e: e["ext"] == "vtt"), F.lit(0)), F.get(entries, F.lit(0)))["url"]


def pick_format(formats: DataFrame, height: int | None = None, progressive_only: bool = False) -> DataFrame:
    """The format that a video's preference chain takes first, as video_id, rule, video_format, audio_format.

    Rules: H.264 mp4 video with m4a audio, any video with any audio, progressive mp4, any
    progressive, any progressive beyond the height ceiling.
    """
    video = F.col("vcodec").isNotNull() & (F.col("vcodec") != "none")
    audio = F.col("acodec").isNotNull() & (F.col("acodec") != "none")
    low = F.lit(True) if height is None else F.coalesce(F.col("height"), F.lit(0)) <= height
    tall = F.struct(F.coalesce("height", F.lit(0)).alias("h"), "format_id")
    best = lambda cond: F.max_by(F.when(cond, F.col("format_id")), F.when(cond, tall))
    only_video, only_audio, both = video & ~audio & low, audio & ~video, video & audio
    found = formats.groupBy("video_id").agg(
        best(only_video & (F.col("ext") == "mp4") & F.col("vcodec").startswith("avc1")).alias("v1"), best(only_audio & (F.col("ext") == "m4a")).alias("a1"),
        best(only_video).alias("v2"), best(only_audio).alias("a2"), best(both & low & (F.col("ext") == "mp4")).alias("p1"), best(both & low).alias("p2"), best(both).alias("p3"),
    )
    chain = [] if progressive_only else [("h264", "v1", "a1"), ("any", "v2", "a2")]
    chain += [("progressive_mp4", "p1", None), ("progressive", "p2", None), ("best", "p3", None)]
    rule = video_format = audio_format = None
    for name, v, a in chain:
        holds = F.col(v).isNotNull() & (F.lit(True) if a is None else F.col(a).isNotNull())
        add = lambda made, value: F.when(holds, value) if made is None else made.when(holds, value)  # noqa: B023, E731
        rule, video_format, audio_format = add(rule, F.lit(name)), add(video_format, F.col(v)), add(audio_format, F.lit(None) if a is None else F.col(a))
    return found.select("video_id", rule.alias("rule"), video_format.alias("video_format"), audio_format.cast("string").alias("audio_format")).where("rule is not null")


def resolve_artifact(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each video: the first of its candidate paths (array, in order) that is
    complete, as itself or as ``.mp4``; else its newest complete ``source_<id>_`` file.

    A path that many videos name is dealt over salts, of as many rows each as SPREAD says.  Rows
    are dealt by video before they are aggregated, as paths sort in every task that reads them
    otherwise: then what a task holds doesn't grow with the tables.
    """
    done = completed_media(files).select("path", "modificationTime")
    as_mp4 = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?<=[^/])\.[^./]+$|$", ".mp4"), r"(\.mp4)+$", ".mp4")
    tries = F.transform("paths", lambda p, i: F.array(F.struct((i * 2).alias("pos"), p.alias("path")), F.struct((i * 2 + 1).alias("pos"), as_mp4(p).alias("path"))))
    each = candidates.select("video_id", F.inline(F.flatten(tries)))
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).alias("_bucket")
    common = F.broadcast(each.groupBy(bucket).agg(F.ceil(F.count("*") / SPREAD).alias("_salts")).where("_salts > 1"))
    salted = each.select("*", bucket).join(common, "_bucket", "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("video_id"), F.col("_salts")), F.lit(0)))
    existing = done.select("path", bucket).join(common, "_bucket", "left").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt"))
    hits = salted.join(existing, ["path", "_salt"], "left_semi").select("video_id", "pos", "path")
    direct = hits.repartition("video_id").groupBy("video_id").agg(F.min_by("path", "pos").alias("direct"))
    named = done.select(F.regexp_extract("path", r"source_(.+)_[^_/]*$", 1).alias("video_id"), "path", "modificationTime").where("video_id <> ''")
    newest = named.repartition("video_id").groupBy("video_id").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("newest"))
    return candidates.select("video_id").join(direct, "video_id", "left").join(newest, "video_id", "left").select("video_id", F.coalesce("direct", "newest").alias("path"))


def order_by_start(clip_cues: DataFrame) -> DataFrame:
    return clip_cues.orderBy("video_id", "clip_index", "rel_start_ms", "cue_ord")


def restore_request_order(results: DataFrame) -> DataFrame:
    return results.orderBy("video_id", "clip_index")


def fallback_client_rank(attempts: DataFrame) -> DataFrame:
    """The client of each video's first success in the order of trial; null without one."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CLIENT_ORDER]), F.col("client"))
    won = F.col("ok") & (rank > 0)
    return attempts.groupBy("video_id").agg(F.min_by(F.when(won, F.col("client")), F.when(won, F.struct(rank, F.col("attempt_no")))).alias("client"), F.count("*").alias("attempts"))
