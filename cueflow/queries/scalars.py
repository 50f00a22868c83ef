"""Queries of the Column functions and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.functions import display as D
from cueflow.functions import text as X
from cueflow.functions import times as T
from cueflow.operators import predicates as P
from cueflow.plans.model import Model, sql
from cueflow.queries.registry import query

_STAMPS = """stamps AS (SELECT event_id, event_id % 75 AS m, event_id % 61 AS s, event_id % 3 = 0 AS h FROM events),
texts AS (SELECT *, CASE WHEN h THEN (event_id % 7) || ':' || lpad((m)::VARCHAR, 2, '0') ELSE m::VARCHAR END || ':' || CASE WHEN event_id % 11 = 0 THEN s::VARCHAR ELSE lpad(s::VARCHAR, 2, '0') END AS stamp FROM stamps)"""


def _stamps(m: Model) -> DataFrame:
    e = F.col("event_id")
    minutes, seconds = e % 75, e % 61
    head = F.when(e % 3 == 0, F.concat((e % 7).cast("string"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"))).otherwise(minutes.cast("string"))
    tail = F.when(e % 11 == 0, seconds.cast("string")).otherwise(F.lpad(seconds.cast("string"), 2, "0"))
    return m.table("events").select("event_id", F.concat(head, F.lit(":"), tail).alias("stamp"))


@query("f1_parse_timestamp", sql(_STAMPS, body="""SELECT event_id, stamp, CASE WHEN (s < 10 AND event_id % 11 = 0) OR s >= 60 OR m >= 60 THEN NULL
    ELSE ((CASE WHEN h THEN event_id % 7 ELSE 0 END * 60 + m) * 60 + s) * 1000 END AS ms FROM texts"""))
def f1(m: Model) -> DataFrame:
    return _stamps(m).select("event_id", "stamp", T.parse_timestamp_ms(F.col("stamp")).alias("ms"))


_MS = "l_orderkey * 1000 + l_partkey * 7 + l_linenumber"
_PARTS = f"({_MS}) // 3600000 AS h, ({_MS}) // 60000 % 60 AS m, ({_MS}) // 1000 % 60 AS s, ({_MS}) % 1000 AS x"
_PADDED = "lpad(h::VARCHAR, greatest(2, length(h::VARCHAR))::INT, '0') || ':' || lpad(m::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0')"


def _ms(m: Model) -> DataFrame:
    return m.table("lineitem").select("l_orderkey", "l_linenumber", F.expr("l_orderkey * 1000 + l_partkey * 7 + l_linenumber").alias("ms"))


@query("f2_vtt_ms", f"SELECT l_orderkey, l_linenumber, ms FROM (SELECT l_orderkey, l_linenumber, ({_MS}) % 360000000 AS ms FROM lineitem)")
def f2(m: Model) -> DataFrame:
    stamp = F.replace(T.format_srt(F.col("ms") % 360000000), F.lit(","), F.lit("."))
    return _ms(m).select("l_orderkey", "l_linenumber", T.vtt_ms(stamp).alias("ms"))


@query("f3_format_duration", f"""SELECT l_orderkey, l_linenumber, CASE WHEN t >= 3600 THEN (t // 3600) || ':' || lpad((t // 60 % 60)::VARCHAR, 2, '0') ELSE lpad((t // 60)::VARCHAR, 2, '0') END || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS shown
    FROM (SELECT *, round_even(({_MS}) / 1000.0, 0)::BIGINT AS t FROM lineitem)""")
def f3(m: Model) -> DataFrame:
    return _ms(m).select("l_orderkey", "l_linenumber", T.format_duration(F.col("ms")).alias("shown"))


@query("f4_format_hms_ms", f"SELECT l_orderkey, l_linenumber, {_PADDED} || '.' || lpad(x::VARCHAR, 3, '0') AS shown FROM (SELECT l_orderkey, l_linenumber, {_PARTS} FROM lineitem)")
def f4(m: Model) -> DataFrame:
    return _ms(m).select("l_orderkey", "l_linenumber", T.format_hms_ms(F.col("ms")).alias("shown"))


@query("f5_format_srt", f"SELECT l_orderkey, l_linenumber, {_PADDED} || ',' || lpad(x::VARCHAR, 3, '0') AS shown FROM (SELECT l_orderkey, l_linenumber, {_PARTS} FROM lineitem)")
def f5(m: Model) -> DataFrame:
    return _ms(m).select("l_orderkey", "l_linenumber", T.format_srt(F.col("ms")).alias("shown"))


@query("f6_format_filesize", """SELECT l_orderkey, l_linenumber, CASE WHEN z IS NULL THEN '-' WHEN z < 1024 THEN z || ' B' WHEN z < 1048576 THEN printf('%.1f KB', z / 1024.0) WHEN z < 1073741824 THEN printf('%.1f MB', z / 1048576.0)
    WHEN z < 1099511627776 THEN printf('%.1f GB', z / 1073741824.0) ELSE printf('%.1f TB', z / 1099511627776.0) END AS shown
    FROM (SELECT *, CASE WHEN l_linenumber < 7 THEN l_partkey * (10 ** (2 * l_linenumber - 2))::BIGINT END AS z FROM lineitem)""")
def f6(m: Model) -> DataFrame:
    size = F.when(F.col("l_linenumber") < 7, F.col("l_partkey") * F.pow(F.lit(10.0), 2 * F.col("l_linenumber") - 2).cast("long"))
    return m.table("lineitem").select("l_orderkey", "l_linenumber", D.format_filesize(size).alias("shown"))


@query("f7_sanitize_filename", r"""SELECT page_id, CASE WHEN c = '' THEN 'clip' ELSE c END AS name FROM (SELECT page_id, trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '', 'g')) AS c FROM pages)""")
def f7(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", D.sanitize_filename(F.col("url")).alias("name"))


@query("f8_output_filename", sql("results", body="SELECT video_id, clip_index, coalesce(output_filename, printf('clip_%02d.mp4', clip_index)) AS file FROM results"))
def f8(m: Model) -> DataFrame:
    return m.results().select("video_id", "clip_index", D.output_filename(F.col("output_filename"), F.col("clip_index")).alias("file"))


@query("f9_transcript_preview", r"""SELECT doc_id, '[' || upper(lang) || CASE WHEN doc_id % 2 = 0 THEN ' · Tự động' ELSE '' END || '] ' || CASE WHEN length(text) > 80 THEN regexp_replace(substr(text, 1, 80), '\s+$', '') || '…' ELSE text END AS preview FROM documents""")
def f9(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", D.transcript_preview(F.col("text"), F.col("lang"), F.col("doc_id") % 2 == 0).alias("preview"))


@query("f10_strip_speaker_markers", r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '^\s*[A-Z][A-Za-z.''-]{1,24}(\s[A-Z][A-Za-z.''-]{1,24}){0,2}\s*:(\s+|$)', ''), '\s+', ' ', 'g')) AS cleaned FROM conversations""")
def f10(m: Model) -> DataFrame:
    named = F.concat(F.lit(">> Joe: >> Mary Ann: >> "), F.col("text"), F.lit(" >> Bob:"))
    return m.table("conversations").select("conv_id", "turn", X.single_spaced(X.strip_speaker_markers(named)).alias("cleaned"))


@query("f11_remove_fillers")
def f11(m: Model) -> DataFrame:
    spoken = F.concat(F.lit("I mean, "), F.col("text"), F.lit(" This is, like, um done. Well, yes"))
    return m.table("conversations").select("conv_id", "turn", X.remove_fillers(spoken).alias("r")).select("conv_id", "turn", "r.text", "r.removed")


@query("f12_dedupe_repeats")
def f12(m: Model) -> DataFrame:
    return m.line_cues().select("video_id", "cue_ord", X.dedupe_repeats(F.col("text")).alias("r")).select("video_id", "cue_ord", "r.text", "r.removed")


#: DuckDB maps letters one to one; these become several in upper case, and İ becomes two in lower case.
_SEVERAL = "MAP {" + ", ".join(f"'{c}': '{c.upper()}'" for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1) + "}"


@query("f13_capitalize_first", rf"""SELECT doc_id, CASE WHEN c <> '' THEN b || coalesce({_SEVERAL}[c], upper(c)) || substr(t, length(b) + 2) ELSE t END AS shown
    FROM (SELECT *, regexp_extract(t, '^[ \t]*') AS b, regexp_extract(t, '^[ \t]*(\p{{L}})', 1) AS c FROM (SELECT doc_id, '  ' || lower(replace(text, 'İ', 'i' || chr(775))) AS t FROM documents))""")
def f13(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", X.capitalize_first(F.concat(F.lit("  "), F.lower("text"))).alias("shown"))


@query("f14_clean_cue")
def f14(m: Model) -> DataFrame:
    return m.line_cues().select("video_id", "cue_ord", X.clean_cue(F.concat(F.lit(">> Joe: um, "), F.col("text"))).alias("r")).select("video_id", "cue_ord", "r.*")


_OPENED = """opened AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Obviously, ' WHEN 1 THEN 'in fact ,  ' WHEN 2 THEN 'look ' ELSE '' END || text AS t FROM conversations)"""


def _opened(m: Model) -> DataFrame:
    lead = F.element_at(F.array(F.lit("Obviously, "), F.lit("in fact ,  "), F.lit("look "), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    return m.table("conversations").select("conv_id", "turn", F.concat(lead, "text").alias("text"))


@query("f15_apply_opener", sql(_OPENED, body=r"""SELECT conv_id, turn, CASE WHEN o IS NULL THEN r WHEN r = '' THEN o || '.' ELSE o || ', ' || lower(substr(r, 1, 1)) || substr(r, 2) END AS joined
    FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Tất nhiên' WHEN 1 THEN 'Thực ra' END AS o, CASE WHEN turn % 4 < 2 THEN trim(regexp_replace(t, '^(Obviously|in fact)\s*,\s*', '')) ELSE t END AS r FROM opened)"""))
def f15(m: Model) -> DataFrame:
    return _opened(m).select("conv_id", "turn", X.apply_opener(X.opener(F.col("text")), X.without_opener(F.col("text"))).alias("joined"))


@query("f16_strip_tags", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def f16(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", X.strip_tags(F.col("html")).alias("plain"))


@query("f17_word_count", r"SELECT doc_id, len(regexp_extract_all(text, '[^\s]+')) AS n FROM documents")
def f17(m: Model) -> DataFrame:
    return m.table("documents").select("doc_id", X.word_count(F.col("text")).alias("n"))


@query("f19_clean_log_message", sql("attempts", body="SELECT video_id, attempt_no, regexp_replace(message, '^(ERROR: )+', 'ERROR: ') AS message FROM attempts"))
def f19(m: Model) -> DataFrame:
    colour = F.concat(F.lit("\x1b[0;31m"), F.col("message"), F.lit("\x1b[0m"))
    return m.attempts().select("video_id", "attempt_no", X.clean_log_message(colour).alias("message"))


@query("f21_settings_digest", "SELECT l_orderkey, l_linenumber, substr(sha1(l_orderkey || '|' || l_returnflag || '|' || l_linenumber), 1, 16) AS digest FROM lineitem")
def f21(m: Model) -> DataFrame:
    return m.table("lineitem").select("l_orderkey", "l_linenumber", D.settings_digest(F.col("l_orderkey"), F.col("l_returnflag"), F.col("l_linenumber")).alias("digest"))


@query("f22_is_due", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true ELSE ts <= TIMESTAMP '2024-01-02 12:00:00' END AS due FROM events")
def f22(m: Model) -> DataFrame:
    last = F.when(F.col("event_id") % 5 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return m.events().select("event_id", T.is_due(last, F.lit("2024-01-03 12:00:00").cast("timestamp"), 24 * 3_600_000).alias("due"))


@query("f23_overlap_ms", sql("cues", "clips", body="SELECT c.video_id, c.cue_ord, k.clip_index, least(c.end_ms, k.end_ms) - greatest(c.start_ms, k.start_ms) AS overlap FROM cues c JOIN clips k USING (video_id)"))
def f23(m: Model) -> DataFrame:
    c, k = m.cues().alias("c"), m.clips().alias("k")
    return c.join(k, "video_id").select("video_id", "cue_ord", "clip_index", T.overlap_ms(F.col("c.start_ms"), F.col("c.end_ms"), F.col("k.start_ms"), F.col("k.end_ms")).alias("overlap"))


@query("f24_clip_duration", "SELECT l_orderkey, l_linenumber, greatest(0, l_partkey - l_suppkey) AS duration FROM lineitem")
def f24(m: Model) -> DataFrame:
    return m.table("lineitem").select("l_orderkey", "l_linenumber", T.duration_ms(F.col("l_suppkey"), F.col("l_partkey")).alias("duration"))


@query("f25_cosine", sql("embedded", body="SELECT a.video_id, a.utt_id, b.utt_id AS other, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embedded a JOIN embedded b ON a.video_id = b.video_id AND a.utt_id < b.utt_id"))
def f25(m: Model) -> DataFrame:
    a, b = m.clip_embeddings().alias("a"), m.clip_embeddings().alias("b")
    met = a.join(b, (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a.utt_id") < F.col("b.utt_id")))
    return met.select("a.video_id", "a.utt_id", F.col("b.utt_id").alias("other"), F.round(D.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("sim"))


_URLS = "urls AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' https://youtu.be/' || lpad(page_id::VARCHAR, 11, 'x') || '?t=1' WHEN 1 THEN 'HTTP://www.YouTube.com/watch?list=a&v=' || lpad(page_id::VARCHAR, 11, 'y') WHEN 2 THEN 'm.youtube.com/watch?v=' || lpad(page_id::VARCHAR, 11, '-') ELSE url END AS url FROM pages)"


def _urls(m: Model) -> DataFrame:
    number = lambda fill: F.lpad(F.col("page_id").cast("string"), 11, fill)
    kind = F.col("page_id") % 4
    url = F.when(kind == 0, F.concat(F.lit(" https://youtu.be/"), number("x"), F.lit("?t=1"))).when(kind == 1, F.concat(F.lit("HTTP://www.YouTube.com/watch?list=a&v="), number("y")))
    return m.table("pages").select("page_id", url.when(kind == 2, F.concat(F.lit("m.youtube.com/watch?v="), number("-"))).otherwise(F.col("url")).alias("url"))


@query("p1_valid_url", sql(_URLS, body="SELECT page_id, page_id % 4 IN (0, 2) AS valid FROM urls"))
def p1(m: Model) -> DataFrame:
    return _urls(m).select("page_id", D.valid_url(F.col("url")).alias("valid"))


@query("p2_extract_video_id", sql(_URLS, body="SELECT page_id, CASE page_id % 4 WHEN 0 THEN lpad(page_id::VARCHAR, 11, 'x') WHEN 1 THEN lpad(page_id::VARCHAR, 11, 'y') WHEN 2 THEN lpad(page_id::VARCHAR, 11, '-') END AS video FROM urls"))
def p2(m: Model) -> DataFrame:
    return _urls(m).select("page_id", D.extract_video_id(F.col("url")).alias("video"))


@query("p3_valid_clip_range", "SELECT l_orderkey, l_linenumber, l_partkey AS start_ms, l_suppkey * 20 AS end_ms FROM lineitem WHERE l_suppkey * 20 > l_partkey")
def p3(m: Model) -> DataFrame:
    return P.valid_clip_range(m.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("start_ms"), (F.col("l_suppkey") * 20).alias("end_ms")))


@query("p4_overlaps", sql("cues", body="SELECT video_id, cue_ord, end_ms > 5000 AND start_ms < 12000 AS meets FROM cues"))
def p4(m: Model) -> DataFrame:
    return m.cues().select("video_id", "cue_ord", P.overlaps(F.col("start_ms"), F.col("end_ms"), F.lit(5000), F.lit(12000)).alias("meets"))


@query("p5_drop_blank_cues", sql("line_cues", body=r"SELECT video_id, cue_ord, text FROM line_cues WHERE regexp_matches(text, '[^\s]')"))
def p5(m: Model) -> DataFrame:
    return P.drop_blank_cues(m.line_cues()).select("video_id", "cue_ord", "text")


@query("p6_completed_media", sql("files", body="SELECT path, length FROM files WHERE length > 0 AND NOT lower(path) LIKE '%.part'"))
def p6(m: Model) -> DataFrame:
    return P.completed_media(m.files()).select("path", "length")


@query("p7_min_duration", sql("cues", "segments", body="SELECT video_id, seg_idx, start_ms, end_ms FROM segments WHERE end_ms - start_ms >= 20000"))
def p7(m: Model) -> DataFrame:
    return P.min_duration(m.segments(), 20000).select("video_id", "seg_idx", "start_ms", "end_ms")


@query("p7_min_duration_default", sql("cues", body="SELECT video_id, cue_ord, start_ms, end_ms FROM cues WHERE end_ms - start_ms >= 350"))
def p7_default(m: Model) -> DataFrame:
    """The default, 350 ms, over cues: those of one word go."""
    return P.min_duration(m.cues()).select("video_id", "cue_ord", "start_ms", "end_ms")


@query("p8_validate_artifacts", sql("results", body="""SELECT video_id, clip_index, r AS reason, r IS NULL AS valid FROM (SELECT *, CASE WHEN output_path IS NULL THEN 'missing' WHEN file_size_bytes % 10 = 0 THEN 'empty' WHEN actual_duration_ms IS NULL THEN 'unknown_duration' WHEN actual_duration_ms < 1000 THEN 'too_short' END AS r FROM results)"""))
def p8(m: Model) -> DataFrame:
    length = F.when(F.col("file_size_bytes") % 10 == 0, 0).otherwise(F.col("file_size_bytes"))
    rows = m.results().select("video_id", "clip_index", F.col("output_path").isNotNull().alias("exists"), length.alias("length"), F.col("actual_duration_ms").alias("duration_ms"))
    return P.validate_artifacts(rows).select("video_id", "clip_index", "reason", "valid")


@query("p9_needs_reencode", "SELECT l_orderkey, l_linenumber, l_partkey % 5 = 0 OR l_returnflag <> 'N' OR l_suppkey % 7 = 0 OR l_suppkey % 3 = 0 OR l_linenumber = 6 AS reencode FROM lineitem")
def p9(m: Model) -> DataFrame:
    flag = lambda c, n: F.col(c) % n == 0
    plans = m.table("lineitem").select("l_orderkey", "l_linenumber", flag("l_partkey", 5).alias("watermark"), F.when(F.col("l_returnflag") == "N", "none").otherwise("mix").alias("audio_mode"), flag("l_suppkey", 7).alias("music"), flag("l_suppkey", 3).alias("dub"), (F.col("l_linenumber") == 6).alias("subtitles"))
    return P.needs_reencode(plans).select("l_orderkey", "l_linenumber", "reencode")


_JOINED = "joined AS (SELECT c.video_id, k.clip_index, c.cue_ord, c.start_ms, c.end_ms, c.text, k.start_ms AS cs, k.end_ms AS ce FROM cues c JOIN clips k ON c.video_id = k.video_id AND c.end_ms > k.start_ms AND c.start_ms < k.end_ms)"


def _joined(m: Model) -> DataFrame:
    from cueflow.operators.joins import clip_cue_join

    return clip_cue_join(m.cues(), m.clips())


@query("p10_rebase_to_clip", sql("cues", "clips", _JOINED, body="SELECT video_id, clip_index, cue_ord, start_ms - cs AS rel_start_ms, end_ms - cs AS rel_end_ms FROM joined"))
def p10(m: Model) -> DataFrame:
    return P.rebase_to_clip(_joined(m)).select("video_id", "clip_index", "cue_ord", "rel_start_ms", "rel_end_ms")


@query("p11_clamp_to_clip", sql("cues", "clips", _JOINED, body=r"SELECT video_id, clip_index, cue_ord, greatest(start_ms, cs) AS start_ms, least(end_ms, ce) AS end_ms FROM joined WHERE least(end_ms, ce) > greatest(start_ms, cs) AND regexp_matches(text, '[^\s]')"))
def p11(m: Model) -> DataFrame:
    return P.clamp_to_clip(_joined(m)).select("video_id", "clip_index", "cue_ord", "start_ms", "end_ms")


@query("p12_fit_to_slot", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_suppkey % 10 > 0 THEN greatest(0.9, least(1.15, (l_suppkey % 10 * 100) / greatest(50, l_partkey % 1000)::DOUBLE)) ELSE 1.0 END, 6) AS ratio, greatest(0, l_partkey - 50) AS delay_ms FROM lineitem")
def p12(m: Model) -> DataFrame:
    start = F.col("l_partkey") - 50
    rows = m.table("lineitem").select("l_orderkey", "l_linenumber", start.alias("start_ms"), (start + F.col("l_partkey") % 1000).alias("end_ms"), (F.col("l_suppkey") % 10 * 100).alias("raw_ms"))
    return P.fit_to_slot(rows).select("l_orderkey", "l_linenumber", F.round("ratio", 6).alias("ratio"), "delay_ms")


@query("p14_classify_attempt_error", sql("attempts", body="""SELECT video_id, attempt_no, CASE WHEN message LIKE '%cookie%' THEN 'cookie' WHEN message LIKE '%403%' THEN 'forbidden' WHEN message LIKE '%format is not%' THEN 'format_unavailable'
    WHEN message LIKE '%private%' THEN 'video_unavailable' WHEN message LIKE '%urlopen%' THEN 'network' ELSE 'other' END AS kind FROM attempts"""))
def p14(m: Model) -> DataFrame:
    return m.attempts().select("video_id", "attempt_no", P.classify_attempt_error(F.col("message")).alias("kind"))


@query("p15_diagnose_height", """SELECT l_orderkey, l_linenumber, CASE WHEN h IS NULL THEN NULL WHEN l_partkey % 9 = 0 THEN 'drm' WHEN l_partkey % 9 = 1 THEN 'tv_false_positive' WHEN h <= 360 AND (q IS NULL OR q > 360) THEN 'cap_360' WHEN h < q THEN 'lower_than_requested' ELSE 'ok' END AS diagnosis
    FROM (SELECT *, CASE l_suppkey % 4 WHEN 0 THEN 360 WHEN 1 THEN 720 WHEN 2 THEN 1080 END AS h, CASE l_partkey % 4 WHEN 0 THEN 360 WHEN 1 THEN 720 WHEN 2 THEN 1080 END AS q FROM lineitem)""")
def p15(m: Model) -> DataFrame:
    step = lambda c: F.when(F.col(c) % 4 == 0, 360).when(F.col(c) % 4 == 1, 720).when(F.col(c) % 4 == 2, 1080)
    rows = m.table("lineitem").select("l_orderkey", "l_linenumber", step("l_suppkey").alias("height"), step("l_partkey").alias("requested"), (F.col("l_partkey") % 9 == 0).alias("drm"), (F.col("l_partkey") % 9 == 1).alias("tv_drm"))
    return P.diagnose_height(rows).select("l_orderkey", "l_linenumber", "diagnosis")


@query("p16_translation_fallback", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text ELSE trim(reverse(text), ' ' || chr(10)) END AS shown FROM conversations")
def p16(m: Model) -> DataFrame:
    translated = F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.reverse("text"))
    return m.table("conversations").select("conv_id", "turn", P.translation_fallback(translated, F.col("text")).alias("shown"))


@query("p17_summary_row", sql("results", body="""SELECT video_id, clip_index, coalesce(output_filename, printf('clip_%02d.mp4', clip_index)) AS file,
    coalesce(CASE WHEN t >= 3600 THEN (t // 3600) || ':' || lpad((t // 60 % 60)::VARCHAR, 2, '0') ELSE lpad((t // 60)::VARCHAR, 2, '0') END || ':' || lpad((t % 60)::VARCHAR, 2, '0'), '-') AS duration, CASE WHEN file_size_bytes < 1024 THEN file_size_bytes || ' B' WHEN file_size_bytes < 1048576 THEN printf('%.1f KB', file_size_bytes / 1024.0)
    WHEN file_size_bytes < 1073741824 THEN printf('%.1f MB', file_size_bytes / 1048576.0) WHEN file_size_bytes < 1099511627776 THEN printf('%.1f GB', file_size_bytes / 1073741824.0) ELSE printf('%.1f TB', file_size_bytes / 1099511627776.0) END AS size, CASE WHEN status = 'Done' THEN '✓ Done' ELSE '✗ Failed' END AS status_label, CASE WHEN clip_index % 2 = 0 THEN '—' ELSE '[EN] ' || status END AS transcript
    FROM (SELECT *, round_even(actual_duration_ms / 1000.0, 0)::BIGINT AS t FROM results)"""))
def p17(m: Model) -> DataFrame:
    rows = m.results().withColumns({"transcript": F.when(F.col("clip_index") % 2 == 0, "").otherwise(F.col("status")), "language": F.lit("en"), "is_auto": F.lit(False)})
    return P.summary_row(rows)
