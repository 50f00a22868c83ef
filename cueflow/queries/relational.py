"""Queries of joins, aggregations, rankings, set operations, sources and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.functions.times import format_srt
from cueflow.operators import aggregates as A
from cueflow.operators import joins as J
from cueflow.operators import ranking as R
from cueflow.operators import sets as U
from cueflow.operators import vectors as V
from cueflow.plans.model import Model, sql
from cueflow.queries.registry import query
from cueflow.sources import readers as S
from cueflow.sources.folders import new_folder
from cueflow.sources.writers import srt_texts, write_captions, write_srt

_J1 = "SELECT c.video_id, k.clip_index, c.cue_ord, c.start_ms, c.end_ms, c.text, k.start_ms AS clip_start_ms, k.end_ms AS clip_end_ms FROM cues c JOIN clips k ON c.video_id = k.video_id AND c.end_ms > k.start_ms AND c.start_ms < k.end_ms"
_CC = ["video_id", "clip_index", "cue_ord", "start_ms", "end_ms", "text", "clip_start_ms", "clip_end_ms"]


@query("j1_clip_cue_join", sql("cues", "clips", body=_J1))
def j1(m: Model) -> DataFrame:
    return J.clip_cue_join(m.cues(), m.clips()).select(*_CC)


@query("j1_clip_cue_join_binned", sql("cues", "clips", body=_J1))
def j1_binned(m: Model) -> DataFrame:
    return J.clip_cue_join(m.cues(), m.clips(), bin_ms=10_000).select(*_CC)


# Shifted segments, so that cues straddle turns.
_SHIFTED = "shifted AS (SELECT video_id, clip_index, seg_idx, start_ms + 700 AS start_ms, end_ms + 700 AS end_ms, speaker_label, gender FROM segments)"
_BEST = """SELECT c.video_id, c.cue_ord, {pick} FROM cues c LEFT JOIN LATERAL (SELECT s.seg_idx, s.speaker_label FROM shifted s WHERE s.video_id = c.video_id AND least(s.end_ms, c.end_ms) > greatest(s.start_ms, c.start_ms)
    ORDER BY least(s.end_ms, c.end_ms) - greatest(s.start_ms, c.start_ms) DESC, s.seg_idx LIMIT 1) b ON true"""


def _shifted(m: Model) -> DataFrame:
    return m.segments().withColumns({"start_ms": F.col("start_ms") + 700, "end_ms": F.col("end_ms") + 700})


@query("j2_assign_speaker", sql("cues", "segments", _SHIFTED, body=_BEST.format(pick="b.speaker_label AS speaker_label")))
def j2(m: Model) -> DataFrame:
    return J.assign_speaker(m.whole_clip(), _shifted(m)).select("video_id", "cue_ord", "speaker_label")


@query("j3_assign_segment", sql("cues", "segments", _SHIFTED, body=_BEST.format(pick="b.seg_idx AS segment")))
def j3(m: Model) -> DataFrame:
    return J.assign_segment(m.whole_clip(), _shifted(m)).select("video_id", "cue_ord", "segment")


@query("j4_attach_voice", sql("cues", "segments", body="SELECT video_id, cue_ord, CASE WHEN speaker_label = 'user' THEN 'male' ELSE 'female' END AS voice, CASE WHEN speaker_label = 'user' THEN '-14Hz' ELSE '+0Hz' END AS pitch FROM cues"))
def j4(m: Model) -> DataFrame:
    voices = m.segments().where("speaker_label = 'user'").select("video_id", "clip_index", "speaker_label", F.lit("male").alias("voice"), F.lit("-14Hz").alias("pitch")).distinct()
    return J.attach_voice(m.whole_clip(), voices).select("video_id", "cue_ord", "voice", "pitch")


@query("j5_attach_excerpt", sql("results", body="SELECT video_id, clip_index, CASE WHEN clip_index % 3 = 1 THEN 'text ' || clip_index END AS transcript, CASE WHEN video_id::BIGINT % 2 = 0 THEN true END AS is_auto FROM results"))
def j5(m: Model) -> DataFrame:
    rows = m.results()
    excerpts = rows.where("clip_index % 3 < 2").select("video_id", "clip_index", F.when(F.col("clip_index") % 3 == 1, F.format_string("text %d", "clip_index")).otherwise("").alias("excerpt"))
    tracks = rows.where("cast(video_id as long) % 2 = 0").select("video_id", F.lit(True).alias("is_auto"), F.lit("en").alias("language")).distinct()
    return J.attach_excerpt(rows, excerpts, tracks).select("video_id", "clip_index", "transcript", "is_auto")


@query("j6_attach_artifacts", sql("results", body="SELECT video_id, clip_index, CASE WHEN clip_index % 2 = 0 THEN output_path || '.srt' END AS subtitle_path, CASE WHEN clip_index % 3 = 0 THEN output_path || '.wav' END AS dub_path FROM results"))
def j6(m: Model) -> DataFrame:
    rows = m.results()
    made = lambda n, ext: rows.where(f"clip_index % {n} = 0").select("video_id", "clip_index", F.concat("output_path", F.lit(ext)).alias("path"))
    return J.attach_artifacts(rows, made(2, ".srt"), made(3, ".wav")).select("video_id", "clip_index", "subtitle_path", "dub_path")


_ITEMS = "items AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 13 = 0 THEN '  ' ELSE ' p' || l_partkey % 997 || ' ' END AS text, l_returnflag AS voice, l_linestatus AS pitch FROM lineitem)"


def _items(m: Model) -> DataFrame:
    part = F.col("l_partkey")
    text = F.when(part % 13 == 0, "  ").otherwise(F.format_string(" p%d ", part % 997))
    return m.table("lineitem").select("l_orderkey", "l_linenumber", text.alias("text"), F.col("l_returnflag").alias("voice"), F.col("l_linestatus").alias("pitch"))


@query("j7_pending_work", sql(_ITEMS, body="SELECT DISTINCT trim(text) AS text, voice, pitch FROM items WHERE trim(text) <> '' AND NOT (voice = 'R' AND pitch = 'F')"))
def j7(m: Model) -> DataFrame:
    items = _items(m)
    cache = items.where("voice = 'R' and pitch = 'F'").select(F.trim("text").alias("text"), "voice", "pitch").distinct()
    return J.pending_work(items, cache)


@query("j8_fan_out_results", sql(_ITEMS, body="SELECT l_orderkey, l_linenumber, CASE WHEN trim(text) <> '' THEN md5(trim(text) || voice || pitch) END AS result FROM items"))
def j8(m: Model) -> DataFrame:
    items = _items(m)
    empty = items.limit(0).select("text", "voice", "pitch")
    done = J.pending_work(items, empty).withColumn("result", F.md5(F.concat("text", "voice", "pitch")))
    return J.fan_out_results(items, done).select("l_orderkey", "l_linenumber", "result")


@query("j9_opener_lookup", r"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Công bằng mà nói' WHEN 1 THEN 'Này' END AS opener, text AS remainder FROM conversations""")
def j9(m: Model) -> DataFrame:
    lead = F.when(F.col("turn") % 3 == 0, "To be fair, ").when(F.col("turn") % 3 == 1, "LOOK,  ").otherwise("")
    rows = m.table("conversations").select("conv_id", "turn", F.concat(lead, "text").alias("text"))
    return J.opener_lookup(rows).select("conv_id", "turn", "opener", "remainder")


_LANGS = ("zh-Hans", "zh-Hant", "zh-Hant-HK", "zh-yue", "zh", "ja", "en-US")


@query("j10_lang_alias_lookup", "SELECT doc_id, ['zh-CN', 'zh-TW', 'zh-CN', 'zh-CN', 'zh-CN', 'ja', 'en-US'][doc_id % 7 + 1] AS source_lang FROM documents")
def j10(m: Model) -> DataFrame:
    lang = F.element_at(F.array(*[F.lit(x) for x in _LANGS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return J.lang_alias_lookup(m.table("documents").select("doc_id", lang.alias("language"))).select("doc_id", "source_lang")


_DONE = "done AS (SELECT DISTINCT 'video' || substr(path, 20, 6) AS video_id, regexp_extract(path, '_(best|720|1080)\\.', 1) AS resolution FROM files WHERE length > 0 AND path NOT LIKE '%.PART')"
_ASKED = "asked AS (SELECT 'video' || regexp_extract(url, 'v=video(\\d{6})', 1) AS video_id, resolution FROM requests)"


@query("j11_reuse_cached_source", sql("files", "requests", _DONE, _ASKED, body="SELECT a.video_id, a.resolution, EXISTS (SELECT 1 FROM done d WHERE d.video_id = a.video_id AND d.resolution = a.resolution) AS cached FROM asked a"))
def j11(m: Model) -> DataFrame:
    cached, missing = J.reuse_cached_source(m.requests(), m.files())
    return cached.withColumn("cached", F.lit(True)).unionByName(missing.withColumn("cached", F.lit(False))).select("video_id", "resolution", "cached")


@query("j12_apply_status_updates", sql("results", body="SELECT video_id, clip_index, CASE WHEN clip_index = 2 THEN 'Cutting' ELSE status END AS status FROM results"))
def j12(m: Model) -> DataFrame:
    updates = m.results().where("clip_index = 2").select("video_id", "clip_index", F.lit("Cutting").alias("status"))
    unknown = updates.withColumn("clip_index", F.lit(99))
    return J.apply_status_updates(m.results(), updates.unionByName(unknown)).select("video_id", "clip_index", "status")


def notes(m: Model) -> DataFrame:
    """Orders as clip notes of three clips, the second of which ends before it starts in half of them."""
    stamp = lambda s: F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    a = F.col("o_orderkey") % 2000
    b = F.when(F.col("o_orderkey") % 2 == 0, a + 100).otherwise(a - a % 50)
    text = F.concat(
        F.lit("Clip #7\nStart Time: "), stamp(a), F.lit("\nEnd Time: "), stamp(a + 30), F.lit("\n\nCLIP 8\nstart time - "), stamp(a + 60), F.lit("\nend time\n"), stamp(b),
        F.lit("\n\nStart Time "), stamp(a + 200), F.lit(" End Time "), stamp(a + 260), F.lit("\nStart Time: 01:00"),
    )
    return m.table("orders").select(F.col("o_orderkey").cast("string").alias("video_id"), text.alias("text"))


_PAIRS = """pairs AS (SELECT o_orderkey::VARCHAR AS video_id, i AS pair_no, CASE i WHEN 0 THEN a WHEN 1 THEN a + 60 ELSE a + 200 END * 1000 AS start_ms,
    CASE i WHEN 0 THEN a + 30 WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN a + 100 ELSE a - a % 50 END ELSE a + 260 END * 1000 AS end_ms, CASE i WHEN 0 THEN '7' WHEN 1 THEN '8' END AS label_no
    FROM (SELECT o_orderkey, o_orderkey % 2000 AS a FROM orders), range(3) r(i))"""


@query("j13_zip_pairs", sql(_PAIRS, body="SELECT * FROM pairs"))
def j13(m: Model) -> DataFrame:
    return J.zip_pairs(notes(m))


@query("a1_outcome_counts", sql("results", body="SELECT video_id, count(*) FILTER (status = 'Done') AS succeeded, count(*) FILTER (status = 'Failed') AS failed FROM results GROUP BY 1"))
def a1(m: Model) -> DataFrame:
    return A.outcome_counts(m.results())


@query("a2_cleaning_totals", "SELECT conv_id::VARCHAR AS video_id, sum(turn % 3)::BIGINT AS filler_removed, sum(turn % 2)::BIGINT AS repetitions_removed FROM conversations GROUP BY 1")
def a2(m: Model) -> DataFrame:
    rows = m.table("conversations").select(F.col("conv_id").cast("string").alias("video_id"), F.lit(1).alias("clip_index"), F.struct((F.col("turn") % 3).alias("filler_removed"), (F.col("turn") % 2).alias("repetitions_removed")).alias("cleaned"))
    return A.cleaning_totals(rows).drop("clip_index")


@query("a3_speaker_count", sql("cues", body="SELECT video_id, greatest(1, count(DISTINCT CASE WHEN cue_ord % 5 > 0 THEN speaker_label END)) AS speakers FROM cues GROUP BY 1"))
def a3(m: Model) -> DataFrame:
    rows = m.whole_clip().withColumn("speaker_label", F.when(F.col("cue_ord") % 5 > 0, F.col("speaker_label")))
    return A.speaker_count(rows).drop("clip_index")


@query("a4_first_seen", "SELECT user_id::VARCHAR AS video_id, (event_id % 3)::INT AS cluster_id, min(event_id * 30) AS first_ms FROM events GROUP BY 1, 2")
def a4(m: Model) -> DataFrame:
    rows = m.table("events").select(F.col("user_id").cast("string").alias("video_id"), F.lit(1).alias("clip_index"), (F.col("event_id") % 3).cast("int").alias("cluster_id"), (F.col("event_id") * 30).alias("start_ms"))
    return A.first_seen(rows).drop("clip_index")


@query("a5_gender_from_pitch", "SELECT user_id::VARCHAR AS video_id, (event_id % 3)::INT AS cluster_id, CASE WHEN avg(100 + value) FILTER (event_type <> 'error') < 165 THEN 'male' ELSE 'female' END AS gender FROM events GROUP BY 1, 2")
def a5(m: Model) -> DataFrame:
    f0 = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(100 + F.col("value"))
    rows = m.table("events").select(F.col("user_id").cast("string").alias("video_id"), F.lit(1).alias("clip_index"), (F.col("event_id") % 3).cast("int").alias("cluster_id"), f0.alias("f0"), F.lit(True).alias("voiced"))
    return A.gender_from_pitch(rows).select("video_id", "cluster_id", "gender")


_FLAGS = """flags AS (SELECT a.video_id, bool_or(lower(message) LIKE '%drm protected%' AND client <> 'tv') AS drm, bool_or(lower(message) LIKE '%drm protected%' AND client = 'tv') AS tv_drm FROM attempts a
    LEFT JOIN (SELECT video_id, min(attempt_no) AS first_ok FROM attempts WHERE ok GROUP BY 1) f USING (video_id) WHERE (first_ok IS NULL OR attempt_no < first_ok) AND NOT ok AND client IN ('tv', 'ios', 'android') GROUP BY 1)"""


@query("a6_drm_flags", sql("attempts", _FLAGS, body="SELECT video_id, coalesce(drm, false) AS drm, coalesce(tv_drm, false) AS tv_drm FROM (SELECT DISTINCT video_id FROM attempts) LEFT JOIN flags USING (video_id)"))
def a6(m: Model) -> DataFrame:
    return A.drm_flags(m.attempts())


@query("a7_service_health", "SELECT event_type AS service, count(*) FILTER (event_id % 7 > 0) AS succeeded, count(*) FILTER (event_id % 7 = 0) AS failed, CASE WHEN count(*) FILTER (event_id % 7 = 0) > 0 THEN count(*) FILTER (event_id % 7 = 0) || ' of ' || count(*) || ' calls failed' END AS note FROM events GROUP BY 1")
def a7(m: Model) -> DataFrame:
    return A.service_health(m.table("events").select(F.col("event_type").alias("service"), (F.col("event_id") % 7 > 0).alias("ok")))


_MERGED = "merged AS (SELECT video_id, count(*) AS n_clips, sum(file_size_bytes)::BIGINT AS file_size_bytes, sum(actual_duration_ms)::BIGINT AS actual_duration_ms FROM results WHERE status = 'Done' GROUP BY 1 HAVING count(*) >= 2)"


@query("a8_merged_summary", sql("results", _MERGED, body="SELECT * FROM merged"))
def a8(m: Model) -> DataFrame:
    return A.merged_summary(m.results()).select("video_id", "n_clips", "file_size_bytes", "actual_duration_ms")


@query("a9_overall_progress", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount < 0.05 THEN floor(l_discount * 20 * 90) ELSE 90 + floor(least(l_linenumber, l_quantity) / l_quantity * 10) END::INT AS progress FROM lineitem")
def a9(m: Model) -> DataFrame:
    fraction = F.when(F.col("l_discount") < 0.05, F.col("l_discount") * 20).otherwise(1.0)
    rows = m.table("lineitem").select("l_orderkey", "l_linenumber", fraction.alias("fraction"), F.least("l_linenumber", "l_quantity").alias("done"), F.col("l_quantity").alias("total"))
    return A.overall_progress(rows).select("l_orderkey", "l_linenumber", "progress")


def _tracks(m: Model) -> tuple[DataFrame, DataFrame]:
    """Order lines as manual and automatic tracks."""
    lang = F.element_at(F.array(*[F.lit(x) for x in ("vi", "en", "fr", "de", "ja")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    own = F.element_at(F.array(*[F.lit(x) for x in ("fr", "ko")]), (F.col("l_orderkey") % 2 + 1).cast("int"))
    rows = m.lines().select(F.col("l_orderkey").cast("string").alias("video_id"), F.col("line").alias("ord"), lang.alias("language"), own.alias("original_language"), "l_suppkey")
    return rows.where("l_suppkey % 3 = 0").drop("l_suppkey"), rows.where("l_suppkey % 3 > 0").drop("l_suppkey")


_TRACKS = "tracks AS (SELECT l_orderkey::VARCHAR AS video_id, line AS ord, ['vi', 'en', 'fr', 'de', 'ja'][l_partkey % 5 + 1] AS language, ['fr', 'ko'][l_orderkey % 2 + 1] AS original_language, l_suppkey % 3 > 0 AS is_auto FROM lines)"


@query("u1_all_tracks", sql("lines", _TRACKS, body="SELECT * FROM tracks"))
def u1(m: Model) -> DataFrame:
    return U.all_tracks(*_tracks(m))


@query("t1_pick_track", sql("lines", _TRACKS, body="""SELECT video_id, ord, language, is_auto FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN language = original_language AND NOT is_auto THEN 0 WHEN language = original_language THEN 1
    WHEN language = 'vi' AND NOT is_auto THEN 2 WHEN language = 'en' AND NOT is_auto THEN 3 WHEN language = 'vi' THEN 4 WHEN language = 'en' THEN 5 WHEN NOT is_auto THEN 98 ELSE 99 END, ord) AS n FROM tracks) WHERE n = 1"""))
def t1(m: Model) -> DataFrame:
    return R.pick_track(U.all_tracks(*_tracks(m))).select("video_id", "ord", "language", "is_auto")


@query("t2_pick_track_url", "SELECT l_orderkey AS o, arg_min('u' || l_linenumber, struct_pack(a := (l_partkey % 4 > 0)::INT, b := l_linenumber)) AS url FROM lineitem GROUP BY 1")
def t2(m: Model) -> DataFrame:
    entry = F.struct("l_linenumber", F.when(F.col("l_partkey") % 4 == 0, "vtt").otherwise("srv3").alias("ext"), F.format_string("u%d", "l_linenumber").alias("url"))
    grouped = m.table("lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return grouped.select("o", R.pick_track_url(F.col("entries")).alias("url"))


_PICKS = """picks AS (SELECT video_id, arg_max(format_id, struct_pack(h := height, f := format_id)) FILTER (v AND NOT a AND height <= 720 AND ext = 'mp4' AND vcodec LIKE 'avc1%') AS v1, arg_max(format_id, struct_pack(h := height, f := format_id)) FILTER (a AND NOT v AND ext = 'm4a') AS a1,
    arg_max(format_id, struct_pack(h := height, f := format_id)) FILTER (v AND NOT a AND height <= 720) AS v2, arg_max(format_id, struct_pack(h := height, f := format_id)) FILTER (a AND NOT v) AS a2, arg_max(format_id, struct_pack(h := height, f := format_id)) FILTER (v AND a AND height <= 720 AND ext = 'mp4') AS p1,
    arg_max(format_id, struct_pack(h := height, f := format_id)) FILTER (v AND a AND height <= 720) AS p2, arg_max(format_id, struct_pack(h := height, f := format_id)) FILTER (v AND a) AS p3 FROM (SELECT *, vcodec <> 'none' AS v, acodec <> 'none' AS a FROM formats) GROUP BY 1)"""


@query("t3_pick_format", sql("formats", _PICKS, body="""SELECT video_id, CASE WHEN v1 IS NOT NULL AND a1 IS NOT NULL THEN 'h264' WHEN v2 IS NOT NULL AND a2 IS NOT NULL THEN 'any' WHEN p1 IS NOT NULL THEN 'progressive_mp4' WHEN p2 IS NOT NULL THEN 'progressive' ELSE 'best' END AS rule,
    CASE WHEN v1 IS NOT NULL AND a1 IS NOT NULL THEN v1 WHEN v2 IS NOT NULL AND a2 IS NOT NULL THEN v2 ELSE coalesce(p1, p2, p3) END AS video_format, CASE WHEN v1 IS NOT NULL AND a1 IS NOT NULL THEN a1 WHEN v2 IS NOT NULL AND a2 IS NOT NULL THEN a2 END AS audio_format
    FROM picks WHERE p3 IS NOT NULL OR (v2 IS NOT NULL AND a2 IS NOT NULL)"""))
def t3(m: Model) -> DataFrame:
    return R.pick_format(m.formats(), 720)


@query("t4_resolve_artifact", sql("files", "good AS (SELECT * FROM files WHERE length > 0 AND path NOT LIKE '%.PART')", body="""SELECT 'video' || lpad(o_orderkey::VARCHAR, 6, '0') AS video_id, coalesce((SELECT min(path) FROM good g WHERE g.path = '/media/source_video' || lpad(o_orderkey::VARCHAR, 6, '0') || '_720.mp4'),
    (SELECT arg_max(path, mtime) FROM good g WHERE substr(g.path, 15, 11) = 'video' || lpad(o_orderkey::VARCHAR, 6, '0'))) AS path FROM orders"""))
def t4(m: Model) -> DataFrame:
    video = F.concat(F.lit("video"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"))
    wanted = m.table("orders").select(video.alias("video_id"), F.array(F.lit("/tmp/none.bin"), F.concat(F.lit("/media/source_"), video, F.lit("_720.webm.part"))).alias("paths"))
    wanted = wanted.withColumn("paths", F.array(F.element_at("paths", 1), F.regexp_replace(F.element_at("paths", 2), r"\.webm\.part$", ".xyz")))
    return R.resolve_artifact(wanted, m.files())


@query("t5_order_by_start", sql("cues", "clips", body=f"SELECT video_id, clip_index, cue_ord, row_number() OVER (PARTITION BY video_id, clip_index ORDER BY start_ms, cue_ord) AS n FROM ({_J1})"))
def t5(m: Model) -> DataFrame:
    from pyspark.sql import Window

    ordered = R.order_by_start(J.clip_cue_join(m.cues(), m.clips()).withColumn("rel_start_ms", F.col("start_ms") - F.col("clip_start_ms")))
    number = F.row_number().over(Window.partitionBy("video_id", "clip_index").orderBy("rel_start_ms", "cue_ord"))
    return ordered.select("video_id", "clip_index", "cue_ord", number.alias("n"))


@query("t6_restore_request_order", sql("results", body="SELECT video_id, clip_index, status FROM results ORDER BY video_id, clip_index"))
def t6(m: Model) -> DataFrame:
    return R.restore_request_order(m.results()).select("video_id", "clip_index", "status")


@query("t7_fallback_client_rank", sql("attempts", body="SELECT video_id, arg_min(client, struct_pack(r := list_position(['default', 'tv', 'ios', 'android'], client), n := attempt_no)) FILTER (ok) AS client, count(*) AS attempts FROM attempts GROUP BY 1"))
def t7(m: Model) -> DataFrame:
    return R.fallback_client_rank(m.attempts())


@query("u2_with_merged_row", sql("results", _MERGED, body="SELECT video_id, clip_index, file_size_bytes FROM results UNION ALL SELECT video_id, 0, file_size_bytes FROM merged"))
def u2(m: Model) -> DataFrame:
    return U.with_merged_row(m.results(), A.merged_summary(m.results())).select("video_id", "clip_index", "file_size_bytes")


@query("u3_merge_only", sql("results", _MERGED, body="SELECT video_id, clip_index, status FROM results WHERE NOT (status = 'Done' AND video_id IN (SELECT video_id FROM merged WHERE video_id::BIGINT % 3 > 0))"))
def u3(m: Model) -> DataFrame:
    merged = A.merged_summary(m.results()).withColumn("status", F.when(F.col("video_id").cast("long") % 3 > 0, "Done").otherwise("Failed"))
    return U.merge_only(m.results(), merged).select("video_id", "clip_index", "status")


@query("u4_distinct_consecutive", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def u4(m: Model) -> DataFrame:
    return U.distinct_consecutive(m.table("events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")


def _caption_files(m: Model) -> DataFrame:
    """Cues as VTT files: odd videos have an automatic file too, every fifth an empty manual one."""
    cue = F.concat(F.replace(format_srt(F.col("start_ms")), F.lit(","), F.lit(".")), F.lit(" --> "), F.replace(format_srt(F.col("end_ms")), F.lit(","), F.lit(".")), F.lit("\n<c>"), F.regexp_replace("text", "\n+", "\r\n"), F.lit("</c>"))
    blocks = m.cues().groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("cue_ord", cue.alias("b")))).alias("bs"))
    whole = blocks.select("video_id", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(F.transform("bs", lambda b: b["b"]), "\r\n\r\n")).alias("value"))
    n = F.col("video_id").cast("long")
    manual = whole.select(F.concat(F.lit("transcript_"), "video_id", F.lit(".manual.en.vtt")).alias("file_name"), F.when(n % 5 == 0, "WEBVTT\n\n").otherwise(F.col("value")).alias("value"))
    return manual.unionByName(whole.where(n % 2 == 1).select(F.concat(F.lit("transcript_"), "video_id", F.lit(".auto.vi.vtt")).alias("file_name"), "value"))


@query("s1_parse_captions", sql("cues", body=r"SELECT video_id, start_ms, end_ms, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM cues WHERE video_id::BIGINT % 5 > 0 AND regexp_matches(text, '[^\s]')"))
def s1(m: Model) -> DataFrame:
    parsed = S.parse_captions(_caption_files(m))
    return S.caption_file_keys(parsed).where("not is_auto").select("video_id", "start_ms", "end_ms", "text")


@query("s2_caption_file_keys", sql("cues", body="SELECT DISTINCT video_id, video_id::BIGINT % 5 = 0 AS is_auto, CASE WHEN video_id::BIGINT % 5 = 0 THEN 'vi' ELSE 'en' END AS language FROM cues WHERE video_id::BIGINT % 5 > 0 OR video_id::BIGINT % 2 = 1"))
def s2(m: Model) -> DataFrame:
    return S.first_caption_files(S.parse_captions(_caption_files(m))).select("video_id", "is_auto", "language")


@query("s1_read_captions", sql("cues", body=r"SELECT video_id, CASE WHEN video_id::BIGINT % 5 > 0 THEN 'en' ELSE 'vi' END AS language, video_id::BIGINT % 5 = 0 AS is_auto, start_ms, end_ms, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM cues WHERE (video_id::BIGINT % 5 > 0 OR video_id::BIGINT % 2 = 1) AND regexp_matches(text, '[^\s]')"))
def s1_files(m: Model) -> DataFrame:
    """Files written, scanned and parsed: each video's manual captions, or the automatic ones where those are empty."""
    folder = new_folder(m.spark, "captions")
    write_captions(_caption_files(m), folder)
    return S.read_captions(m.spark, folder).select("video_id", "language", "is_auto", "start_ms", "end_ms", "text")


def _video_infos(m: Model) -> DataFrame:
    entry = F.struct(F.lit("vtt").alias("ext"), F.col("event_id").cast("string").alias("url"))
    lists = m.table("events").groupBy("user_id", (F.col("event_id") % 2 == 0).alias("auto"), "event_type").agg(F.collect_list(entry).alias("es"))
    chosen = lambda auto: F.map_from_entries(F.collect_list(F.when(F.col("auto") == auto, F.struct("event_type", "es"))))
    return lists.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.lit("en").alias("language"), chosen(False).alias("subtitles"), chosen(True).alias("automatic_captions"))


@query("s3_read_video_info", "SELECT user_id::VARCHAR AS video_id, event_type AS language, event_id % 2 = 0 AS is_auto, count(*) AS entries, min(event_id) AS first FROM events GROUP BY ALL")
def s3_files(m: Model) -> DataFrame:
    """Metadata written as JSON and read back by its schema."""
    folder = new_folder(m.spark, "info")
    _video_infos(m).write.json(folder)
    first = F.array_min(F.transform("entries", lambda e: e["url"].cast("long")))
    return S.info_tracks(S.read_video_info(m.spark, folder)).select("video_id", "language", "is_auto", F.size("entries").cast("long").alias("entries"), first.alias("first"))


@query("s3_info_tracks", "SELECT user_id::VARCHAR AS video_id, event_type AS language, event_id % 2 = 0 AS is_auto, count(*) AS entries FROM events GROUP BY ALL")
def s3(m: Model) -> DataFrame:
    return S.info_tracks(_video_infos(m)).select("video_id", "language", "is_auto", F.size("entries").cast("long").alias("entries"))


@query("s4_clip_notes", "SELECT user_id::VARCHAR AS video_id, string_agg(event_type, chr(10) || chr(10) ORDER BY event_id) AS text FROM events WHERE event_id % 4 > 0 GROUP BY 1")
def s4(m: Model) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, " \n").otherwise(F.concat(F.lit("  "), "event_type", F.lit("\t")))
    return S.read_clip_notes(m.table("events").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("box_ord"), text.alias("text")))


@query("s5_media_keys", sql("files", body="SELECT path, length, 'video' || substr(path, 20, 6) AS video_id, regexp_extract(path, '_(best|720|1080)\\.', 1) AS resolution FROM files"))
def s5(m: Model) -> DataFrame:
    return S.media_keys(m.files()).select("path", "length", "video_id", "resolution")


_SRT_T = "lpad(({0} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({0} // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad(({0} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({0} % 1000)::VARCHAR, 3, '0')"


@query("s6_srt_texts", sql("cues", body=f"SELECT video_id, string_agg(n || chr(10) || {_SRT_T.format('start_ms')} || ' --> ' || {_SRT_T.format('end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, cue_ord) AS n FROM cues) GROUP BY 1"))
def s6(m: Model) -> DataFrame:
    cues = m.whole_clip().select("video_id", "clip_index", "cue_ord", F.col("start_ms").alias("rel_start_ms"), F.col("end_ms").alias("rel_end_ms"), F.col("text").alias("translated"))
    return srt_texts(cues).select("video_id", "srt")


@query("s6_write_srt", sql("cues", body=f"SELECT video_id, string_agg(n || chr(10) || {_SRT_T.format('start_ms')} || ' --> ' || {_SRT_T.format('end_ms')} || chr(10) || text || chr(10), chr(10) ORDER BY n) || chr(10) AS srt FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, cue_ord) AS n FROM cues) GROUP BY 1"))
def s6_files(m: Model) -> DataFrame:
    """Subtitle files written and read back."""
    folder = new_folder(m.spark, "srt")
    write_srt(m.whole_clip().select("video_id", "clip_index", "cue_ord", F.col("start_ms").alias("rel_start_ms"), F.col("end_ms").alias("rel_end_ms"), F.col("text").alias("translated")), folder)
    return S.whole_texts(m.spark, folder).select(F.col("video_id").cast("string").alias("video_id"), F.col("value").alias("srt"))


_EMB = "pairs AS (SELECT a.video_id, a.utt_id, a.cluster_id, b.cluster_id AS oc, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embedded a JOIN embedded b ON a.video_id = b.video_id AND a.utt_id <> b.utt_id)"


@query("v2_silhouette", sql("embedded", _EMB, body="""SELECT video_id, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS score FROM (SELECT video_id, utt_id, min(d) FILTER (oc = cluster_id) AS a, min(d) FILTER (oc <> cluster_id) AS b
    FROM (SELECT video_id, utt_id, cluster_id, oc, avg(d) AS d FROM pairs GROUP BY ALL) GROUP BY 1, 2) GROUP BY 1"""))
def v2(m: Model) -> DataFrame:
    return V.silhouette(m.clip_embeddings()).select("video_id", F.round("score", 6).alias("score"))


@query("v3_choose_k", "SELECT l_orderkey::VARCHAR AS video_id, CASE WHEN max(l_discount * 3) >= 0.15 THEN arg_max(l_linenumber, struct_pack(s := l_discount, k := -l_linenumber)) ELSE 1 END AS k FROM lineitem GROUP BY 1")
def v3(m: Model) -> DataFrame:
    scores = m.table("lineitem").select(F.col("l_orderkey").cast("string").alias("video_id"), F.lit(1).alias("clip_index"), F.col("l_linenumber").alias("k"), (F.col("l_discount") * 3).alias("score"))
    return V.choose_k(scores).select("video_id", "k")


@query("v1_cluster_utterances")
def v1(m: Model) -> DataFrame:
    clusters = V.relabelled(V.speaker_clusters(m.clip_embeddings().drop("cluster_id")))
    return clusters.select("video_id", "utt_id", F.col("cluster_id").cast("int").alias("cluster_id"))


@query("v4_cluster_corpus")
def v4(m: Model) -> DataFrame:
    return V.cluster_corpus(m.table("embeddings").select(F.col("vec_id").alias("utt_id"), "embedding"), 8).select("utt_id", "cluster_id")
