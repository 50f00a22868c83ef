"""Queries of window functions, folds and composite jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueflow.functions.text import words
from cueflow.hooks import Limits
from cueflow.operators import aggregates as A
from cueflow.operators import sequences as W
from cueflow.operators.joins import assign_segment
from cueflow.plans import jobs as C
from cueflow.plans.model import Model, sql
from cueflow.queries.registry import query
from cueflow.queries.relational import _FLAGS, _J1, _MERGED, _PAIRS, _PICKS, _shifted, notes

CC = ["video_id", "clip_index", "cue_ord"]
#: The stand-ins for services run here: nothing to wait for.
LOCAL = Limits(attempts=3, timeout_s=60)
_WORDS = r"regexp_extract_all({0}, '[^\s]+')"

# Cues that open with the last three words of the cue before.
_ROLLED = f"rolled AS (SELECT video_id, cue_ord, start_ms, end_ms, coalesce(array_to_string(list_slice(lag(ws) OVER (PARTITION BY video_id ORDER BY cue_ord), -3, -1), ' ') || ' ', '') || text AS text FROM (SELECT *, {_WORDS.format('text')} AS ws FROM cues))"
_OVERLAP = "coalesce(list_max(list_filter(range(1, least(len({p}), len({c})) + 1), lambda k: list_transform(list_slice({p}, len({p}) - k + 1, len({p})), lambda w: lower(w)) = list_transform(list_slice({c}, 1, k), lambda w: lower(w)))), 0)"


def _rolled(m: Model) -> DataFrame:
    before = F.lag(words(F.col("text"))).over(Window.partitionBy("video_id").orderBy("cue_ord"))
    tail = F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), F.lit(3))
    return m.whole_clip().withColumn("text", F.concat(F.coalesce(F.concat(F.array_join(tail, " "), F.lit(" ")), F.lit("")), "text"))


@query("w1_dedupe_rolling", sql("cues", _ROLLED, f"listed AS (SELECT *, lag(c) OVER (PARTITION BY video_id ORDER BY cue_ord) AS p FROM (SELECT *, {_WORDS.format('text')} AS c FROM rolled))",
    body=f"SELECT video_id, cue_ord, array_to_string(list_slice(c, k + 1, len(c)), ' ') AS text FROM (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE {_OVERLAP.format(p='p', c='c')} END AS k FROM listed) WHERE k < len(c)"))
def w1(m: Model) -> DataFrame:
    return W.dedupe_rolling(_rolled(m)).select("video_id", "cue_ord", "text")


_SEQ = f"seq AS (SELECT *, len({_WORDS.format('text')}) AS nw, row_number() OVER (PARTITION BY video_id ORDER BY cue_ord) AS i, start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY cue_ord) AS gap, lag(text) OVER (PARTITION BY video_id ORDER BY cue_ord) AS before FROM {{src}} WHERE regexp_matches(text, '[^\\s]'))"


@query("w2_merge_short_cues", sql("line_cues", _SEQ.format(src="line_cues"), """merged AS (SELECT video_id, i, cue_ord, cue_ord AS head, start_ms AS s, end_ms AS e, nw AS n FROM seq WHERE i = 1 UNION ALL
    SELECT q.video_id, q.i, q.cue_ord, CASE WHEN r.e - r.s < 1200 AND r.n + q.nw <= 12 THEN r.head ELSE q.cue_ord END, CASE WHEN r.e - r.s < 1200 AND r.n + q.nw <= 12 THEN r.s ELSE q.start_ms END, q.end_ms, CASE WHEN r.e - r.s < 1200 AND r.n + q.nw <= 12 THEN r.n + q.nw ELSE q.nw END
    FROM merged r JOIN seq q ON q.video_id = r.video_id AND q.i = r.i + 1)""", recursive=True,
    body="SELECT m.video_id, m.head AS cue_ord, min(q.start_ms) AS start_ms, max(q.end_ms) AS end_ms, string_agg(q.text, ' ' ORDER BY q.cue_ord) AS text FROM merged m JOIN seq q USING (video_id, cue_ord) GROUP BY 1, 2"))
def w2(m: Model) -> DataFrame:
    cues = m.line_cues().where(F.col("text").rlike(r"\S"))
    return W.merge_short_cues(cues).select("video_id", "cue_ord", "start_ms", "end_ms", "text")


def _windows(src: str, cut: str, name: str = "win") -> tuple[str, str]:
    """CTEs that number greedy windows: a cut where a hard boundary or a cap (n, w of the open window) says so."""
    rec = f"""{name} AS (SELECT video_id, i, cue_ord, 0 AS window_id, 1 AS n, nw AS w FROM seq WHERE i = 1 UNION ALL
        SELECT q.video_id, q.i, q.cue_ord, r.window_id + ({cut})::INT, CASE WHEN {cut} THEN 1 ELSE r.n + 1 END, CASE WHEN {cut} THEN q.nw ELSE r.w + q.nw END FROM {name} r JOIN seq q ON q.video_id = r.video_id AND q.i = r.i + 1)"""
    return _SEQ.format(src=src), rec


_W3_CUT = r"(q.gap > 1500 OR regexp_matches(q.before, '[.!?]\s*$') OR r.n >= 6 OR r.w >= 40)"
# Without their punctuation lines reach the caps.
_BARE = "bare AS (SELECT video_id, clip_index, cue_ord, start_ms, end_ms, CASE WHEN cue_ord % 9 = 0 THEN text ELSE regexp_replace(text, '[.!?]', '', 'g') END AS text FROM line_cues)"


def _bare(m: Model) -> DataFrame:
    return m.line_cues().withColumn("text", F.when(F.col("cue_ord") % 9 == 0, F.col("text")).otherwise(F.regexp_replace("text", "[.!?]", "")))


@query("w3_translation_windows", sql("line_cues", _BARE, *_windows("bare", _W3_CUT), recursive=True, body="SELECT video_id, cue_ord, window_id FROM win"))
def w3(m: Model) -> DataFrame:
    return W.translation_windows(_bare(m)).select("video_id", "cue_ord", "window_id")


_SPOKEN = "spoken AS (SELECT *, CASE WHEN cue_ord % 10 < 8 THEN 'Speaker ' || (cue_ord // 10 % 2) END AS speaker_label FROM bare)"
_SEQ4 = _SEQ.format(src="spoken").replace("AS before FROM", "AS before, lag(speaker_label) OVER (PARTITION BY video_id ORDER BY cue_ord) AS who FROM")
_W4_CUT = "(q.gap > 1500 OR q.speaker_label IS DISTINCT FROM q.who OR r.n >= 6 OR r.w >= 40)"


def _spoken(m: Model) -> DataFrame:
    return _bare(m).withColumn("speaker_label", F.when(F.col("cue_ord") % 10 < 8, F.format_string("Speaker %d", F.floor(F.col("cue_ord") / 10) % 2)))


@query("w4_dub_windows_fallback", sql("line_cues", _BARE, _SPOKEN, _SEQ4, _windows("spoken", _W4_CUT)[1], recursive=True, body="SELECT video_id, cue_ord, window_id FROM win"))
def w4(m: Model) -> DataFrame:
    return W.dub_windows_fallback(_spoken(m)).select("video_id", "cue_ord", "window_id")


# Turns of fifteen lines with a hole of five; cues touch but for every seventh.
_TURNS = "turns AS (SELECT video_id, 1 AS clip_index, (cue_ord // 20)::INT AS seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, 'Speaker ' || (cue_ord // 20 % 2) AS speaker_label FROM line_cues WHERE cue_ord % 20 < 15 GROUP BY ALL)"
_TOUCH = "touching AS (SELECT video_id, clip_index, cue_ord, start_ms, CASE WHEN cue_ord % 7 = 0 THEN end_ms ELSE end_ms + 100 END AS end_ms, text FROM bare)"
_PLACED = """placed AS (SELECT c.*, b.seg_idx, b.speaker_label FROM touching c LEFT JOIN LATERAL (SELECT s.seg_idx, s.speaker_label FROM turns s WHERE s.video_id = c.video_id AND least(s.end_ms, c.end_ms) > greatest(s.start_ms, c.start_ms)
    ORDER BY least(s.end_ms, c.end_ms) - greatest(s.start_ms, c.start_ms) DESC, s.seg_idx LIMIT 1) b ON true)"""
_SEQ5 = _SEQ.format(src="placed").replace("AS before FROM", "AS before, lag(seg_idx) OVER (PARTITION BY video_id ORDER BY cue_ord) AS turn_before FROM")
_W5_CUT = "(q.seg_idx IS DISTINCT FROM q.turn_before OR (q.seg_idx IS NULL AND (q.gap > 1500 OR r.n >= 6 OR r.w >= 40)) OR (q.seg_idx IS NOT NULL AND q.gap > 30 AND (r.n >= 6 OR r.w >= 40)))"


def _turns(m: Model) -> DataFrame:
    seg = F.floor(F.col("cue_ord") / 20).cast("int")
    return m.line_cues().where("cue_ord % 20 < 15").groupBy("video_id", "clip_index", seg.alias("seg_idx")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).withColumns({"speaker_label": F.format_string("Speaker %d", F.col("seg_idx") % 2), "gender": F.when(F.col("seg_idx") % 2 == 0, "male").otherwise("female")})


def _touching(m: Model) -> DataFrame:
    return _bare(m).withColumn("end_ms", F.col("end_ms") + F.when(F.col("cue_ord") % 7 == 0, 0).otherwise(100)).withColumn("speaker_label", F.lit(None).cast("string"))


@query("w5_dub_windows_by_segment", sql("line_cues", _BARE, _TURNS, _TOUCH, _PLACED, _SEQ5, _windows("placed", _W5_CUT)[1], recursive=True, body="SELECT video_id, cue_ord, window_id, seg_idx AS segment FROM win JOIN placed USING (video_id, cue_ord)"))
def w5(m: Model) -> DataFrame:
    return W.dub_windows_by_segment(_touching(m), _turns(m)).select("video_id", "cue_ord", "window_id", "segment")


_W6_CUT = f"(CASE WHEN q.video_id::BIGINT % 2 = 0 THEN {_W5_CUT} ELSE (q.gap > 1500 OR r.n >= 6 OR r.w >= 40) END)"


@query("w6_dub_windows", sql("line_cues", _BARE, _TURNS, _TOUCH, _PLACED, _SEQ5, _windows("placed", _W6_CUT)[1], recursive=True, body="SELECT video_id, cue_ord, window_id, CASE WHEN video_id::BIGINT % 2 = 0 THEN speaker_label END AS speaker_label FROM win JOIN placed USING (video_id, cue_ord)"))
def w6(m: Model) -> DataFrame:
    return W.dub_windows(_touching(m), _turns(m).where("cast(video_id as long) % 2 = 0")).select("video_id", "cue_ord", "window_id", "speaker_label")


_ISLANDS = """islands AS (SELECT video_id, min(frame_no) * 30 AS start_ms, (max(frame_no) + 1) * 30 AS end_ms FROM (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY frame_no) AS g FROM
    (SELECT *, coalesce((frame_no - lag(frame_no) OVER (PARTITION BY video_id ORDER BY frame_no) > 11)::INT, 0) AS c FROM frames WHERE voiced)) GROUP BY video_id, g)"""


def _sparse(m: Model) -> DataFrame:
    """Frames spread out by their event type, so that pauses of all lengths occur."""
    return m.frames().withColumn("frame_no", F.col("frame_no") * 3 + F.floor(F.col("frame_no") / 7) * 9)


_SPARSE = "SELECT user_id::VARCHAR AS video_id, 1 AS clip_index, n * 3 + n // 7 * 9 AS frame_no, event_type <> 'error' AS voiced FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)"


@query("w7_speech_islands", sql(f"frames AS ({_SPARSE})", _ISLANDS, body="SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ms) - 1 AS seg_idx, start_ms, end_ms FROM islands WHERE end_ms - start_ms >= 350"))
def w7(m: Model) -> DataFrame:
    return W.speech_islands(_sparse(m)).select("video_id", "seg_idx", "start_ms", "end_ms")


@query("w8_number_speakers", "SELECT l_orderkey::VARCHAR AS video_id, l_linenumber AS cluster_id, 'Speaker ' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) AS speaker_label FROM lineitem")
def w8(m: Model) -> DataFrame:
    rows = m.table("lineitem").select(F.col("l_orderkey").cast("string").alias("video_id"), F.lit(1).alias("clip_index"), F.col("l_linenumber").alias("cluster_id"), F.col("l_partkey").alias("first_ms"))
    return W.number_speakers(rows).select("video_id", "cluster_id", "speaker_label")


@query("w9_assign_voices", sql("lines", body="""SELECT video_id, speaker_label, voice, ['+0Hz', '-14Hz', '-28Hz', '-42Hz'][least(4, row_number() OVER (PARTITION BY video_id, voice ORDER BY f))] AS pitch
    FROM (SELECT l_orderkey::VARCHAR AS video_id, 's' || line AS speaker_label, CASE WHEN l_suppkey % 3 = 0 THEN 'male' ELSE 'female' END AS voice, line AS f FROM lines)"""))
def w9(m: Model) -> DataFrame:
    gender = F.when(F.col("l_suppkey") % 3 == 0, "male").when(F.col("l_suppkey") % 3 == 1, "female").otherwise("unknown")
    rows = m.lines().select(F.col("l_orderkey").cast("string").alias("video_id"), F.lit(1).alias("clip_index"), F.col("line").alias("seg_idx"), F.format_string("s%d", "line").alias("speaker_label"), gender.alias("gender"))
    return W.assign_voices(rows).select("video_id", "speaker_label", "voice", "pitch")


@query("w10_reindex_clips", sql(_PAIRS, body="SELECT video_id, n AS clip_index, start_ms, end_ms, 'Clip ' || coalesce(label_no, n::VARCHAR) AS label FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pair_no) AS n FROM pairs WHERE end_ms > start_ms)"))
def w10(m: Model) -> DataFrame:
    from cueflow.operators.joins import zip_pairs
    from cueflow.operators.predicates import valid_clip_range

    return W.reindex_clips(valid_clip_range(zip_pairs(notes(m)))).select("video_id", "clip_index", "start_ms", "end_ms", "label")


@query("w11_concat_timeline", sql("results", body="SELECT video_id, clip_index, coalesce(sum(actual_duration_ms) OVER (PARTITION BY video_id ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ms FROM results WHERE status = 'Done'"))
def w11(m: Model) -> DataFrame:
    return W.concat_timeline(m.results()).select("video_id", "clip_index", "offset_ms")


_FOLD = f"""listed AS (SELECT video_id, clip_index, {_WORDS.format('text')} AS c, row_number() OVER (PARTITION BY video_id, clip_index ORDER BY cue_ord) AS i FROM joined),
    folded AS (SELECT video_id, clip_index, i, c AS acc FROM listed WHERE i = 1 UNION ALL
    SELECT l.video_id, l.clip_index, l.i, list_concat(f.acc, list_slice(l.c, {_OVERLAP.format(p='f.acc', c='l.c')} + 1, len(l.c))) FROM folded f JOIN listed l ON l.video_id = f.video_id AND l.clip_index = f.clip_index AND l.i = f.i + 1)"""
_LAST = "SELECT video_id, clip_index, array_to_string(acc, ' ') AS excerpt, len(acc) AS n_words FROM folded QUALIFY row_number() OVER (PARTITION BY video_id, clip_index ORDER BY i DESC) = 1"


@query("w12_merge_rolling_text", sql("cues", _ROLLED, "joined AS (SELECT *, 1 AS clip_index FROM rolled)", _FOLD, recursive=True, body=_LAST))
def w12(m: Model) -> DataFrame:
    return W.merge_rolling_text(_rolled(m))


_SHARES = f"""members AS (SELECT video_id, window_id, cue_ord, q.text, greatest(1, q.nw) AS wc, row_number() OVER (PARTITION BY video_id, window_id ORDER BY cue_ord) AS k, count(*) OVER (PARTITION BY video_id, window_id) AS m FROM win JOIN seq q USING (video_id, cue_ord)),
    whole AS (SELECT video_id, window_id, {_WORDS.format("string_agg(text, ' ' ORDER BY cue_ord) || ' x y z'")} AS ws, sum(wc)::INT AS total FROM members GROUP BY 1, 2),
    shares AS (SELECT m.video_id, m.window_id, m.k, m.cue_ord, 0 AS before, CASE WHEN m.m = 1 THEN len(ws) ELSE greatest(0, least(greatest(1, round_even(len(ws) * wc / total::DOUBLE, 0)::INT), len(ws) - (m.m - 1))) END AS share FROM members m JOIN whole USING (video_id, window_id) WHERE k = 1 UNION ALL
    SELECT m.video_id, m.window_id, m.k, m.cue_ord, s.before + s.share, CASE WHEN m.k = m.m THEN len(ws) - s.before - s.share ELSE greatest(0, least(greatest(1, round_even(len(ws) * wc / total::DOUBLE, 0)::INT), len(ws) - s.before - s.share - (m.m - m.k))) END
    FROM shares s JOIN members m ON m.video_id = s.video_id AND m.window_id = s.window_id AND m.k = s.k + 1 JOIN whole w ON w.video_id = m.video_id AND w.window_id = m.window_id)"""


@query("w13_split_by_word_ratio", sql("line_cues", _BARE, *_windows("bare", _W3_CUT), _SHARES, recursive=True, body="SELECT s.video_id, s.cue_ord, array_to_string(list_slice(ws, before + 1, before + share), ' ') AS part FROM shares s JOIN whole USING (video_id, window_id)"))
def w13(m: Model) -> DataFrame:
    from cueflow.functions.text import single_spaced

    windowed = W.translation_windows(_bare(m))
    members = windowed.groupBy("video_id", "clip_index", "window_id").agg(F.sort_array(F.collect_list(F.struct("cue_ord", "text"))).alias("cues"))
    text = F.concat(F.array_join(F.transform("cues", lambda c: c["text"]), " "), F.lit(" x y z"))
    return W.split_by_word_ratio(members.withColumn("translated", single_spaced(text))).select("video_id", "cue_ord", "part")


@query("w14_srt_numbering", sql("cues", "clips", body=f"SELECT video_id, clip_index, cue_ord, row_number() OVER (PARTITION BY video_id, clip_index ORDER BY start_ms, cue_ord) AS srt_no FROM ({_J1})"))
def w14(m: Model) -> DataFrame:
    from cueflow.operators.joins import clip_cue_join

    rows = clip_cue_join(m.cues(), m.clips()).withColumn("rel_start_ms", F.col("start_ms") - F.col("clip_start_ms"))
    return W.srt_numbering(rows).select(*CC, "srt_no")


@query("a10_windows_per_clip", sql("line_cues", _BARE, *_windows("bare", _W3_CUT), recursive=True, body="SELECT video_id, count(*) AS cues, count(DISTINCT window_id) AS windows, round(count(*) / count(DISTINCT window_id), 6) AS cues_per_window FROM win GROUP BY 1"))
def a10(m: Model) -> DataFrame:
    return A.windows_per_clip(W.translation_windows(_bare(m))).select("video_id", "cues", "windows", F.round("cues_per_window", 6).alias("cues_per_window"))


@query("a11_window_rollup", sql("line_cues", _BARE, *_windows("bare", _W3_CUT), recursive=True, body="SELECT video_id, window_id, string_agg(q.text, ' ' ORDER BY cue_ord) AS text, min(q.start_ms) AS start_ms, max(q.end_ms) AS end_ms, count(*) AS n_cues FROM win JOIN seq q USING (video_id, cue_ord) GROUP BY 1, 2"))
def a11(m: Model) -> DataFrame:
    return A.window_rollup(W.translation_windows(_bare(m))).select("video_id", "window_id", "text", "start_ms", "end_ms", F.size("cue_ords").cast("long").alias("n_cues"))


@query("c7_clip_excerpts", sql("cues", "clips", f"joined AS ({_J1})", _FOLD, recursive=True, body=_LAST))
def c7(m: Model) -> DataFrame:
    return C.clip_excerpts(m.cues(), m.clips())


@query("c1_clean_corpus")
def c1(m: Model) -> DataFrame:
    cleaned, totals = C.clean_corpus(m.line_cues())
    counts = cleaned.groupBy("video_id", "clip_index").agg(F.count("*").alias("cues"), F.sum(F.length("text")).alias("chars"))
    return totals.join(counts, ["video_id", "clip_index"], "left")


@query("c2_subtitles")
def c2(m: Model) -> DataFrame:
    return C.subtitles(m.cues(), m.clips(), _marked, LOCAL)


def _marked(text: str) -> str:
    """A stand-in for a translation service: the words, marked."""
    return " ".join(f"<{w}>" for w in text.split())


_DUBBED = """placed AS (SELECT c.video_id, c.cue_ord, c.start_ms, c.end_ms, c.text, b.seg_idx, b.speaker_label FROM cues c LEFT JOIN LATERAL (SELECT s.seg_idx, s.speaker_label FROM segments s WHERE s.video_id = c.video_id AND least(s.end_ms + 700, c.end_ms) > greatest(s.start_ms + 700, c.start_ms)
    ORDER BY least(s.end_ms + 700, c.end_ms) - greatest(s.start_ms + 700, c.start_ms) DESC, s.seg_idx LIMIT 1) b ON true)"""
_VOICED = r"""rolled AS (SELECT video_id, window_id, string_agg(q.text, ' ' ORDER BY cue_ord) AS text, arg_min(q.start_ms, cue_ord) AS start_ms, arg_max(q.end_ms, cue_ord) AS end_ms, min(q.speaker_label) AS speaker_label FROM win JOIN seq q USING (video_id, cue_ord) GROUP BY 1, 2),
    speakers AS (SELECT video_id, speaker_label, min(seg_idx) AS f, CASE WHEN arg_min(gender, seg_idx) = 'male' THEN 'male' ELSE 'female' END AS voice FROM segments GROUP BY 1, 2),
    voices AS (SELECT *, ['+0Hz', '-14Hz', '-28Hz', '-42Hz'][least(4, row_number() OVER (PARTITION BY video_id, voice ORDER BY f))] AS pitch FROM speakers),
    lengths AS (SELECT 'wav:' || md5(text) AS result, max(end_ms - start_ms) AS raw FROM cues GROUP BY 1),
    named AS (SELECT *, 'wav:' || md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS result FROM rolled)"""


@query("c3_dub_plan", sql("cues", "segments", _DUBBED, _SEQ5, _windows("placed", _W5_CUT)[1], _VOICED, recursive=True, body="""SELECT n.video_id, n.window_id, n.speaker_label, coalesce(v.voice, 'female') AS voice, coalesce(v.pitch, '+0Hz') AS pitch, n.start_ms, n.end_ms,
    round(CASE WHEN l.raw IS NULL OR l.raw <= 0 THEN 1.0 ELSE greatest(0.9, least(1.15, l.raw::DOUBLE / greatest(50, n.end_ms - n.start_ms))) END, 6) AS ratio, greatest(0, n.start_ms) AS delay_ms, n.result
    FROM named n LEFT JOIN voices v ON v.video_id = n.video_id AND v.speaker_label = n.speaker_label LEFT JOIN lengths l ON l.result = n.result"""))
def c3(m: Model) -> DataFrame:
    cues = m.whole_clip().drop("speaker_label")
    raw = m.cues().select(F.col("text").alias("t"), (F.col("end_ms") - F.col("start_ms")).alias("raw_ms"))
    lengths = raw.groupBy(F.concat(F.lit("wav:"), F.md5("t")).alias("result")).agg(F.max("raw_ms").alias("raw_ms"))
    return C.dub_plan(cues, _shifted(m), _synthesized, lengths, LOCAL).select("video_id", "window_id", "speaker_label", "voice", "pitch", "start_ms", "end_ms", F.round("ratio", 6).alias("ratio"), "delay_ms", "result")


def _synthesized(text: str, voice: str, pitch: str) -> str:
    """A stand-in for a speech service: the name of a file."""
    import hashlib

    return f"wav:{hashlib.md5(text.encode()).hexdigest()}"


@query("c4_speaker_segments")
def c4(m: Model) -> DataFrame:
    frames = m.table("embeddings").select(F.format_string("v%d", F.floor(F.col("vec_id") / 25)).alias("video_id"), F.lit(1).alias("clip_index"), F.explode(F.sequence((F.col("vec_id") % 25) * 40, (F.col("vec_id") % 25) * 40 + 20)).alias("frame_no"), F.lit(True).alias("voiced"))
    pitch = frames.select("video_id", "clip_index", (F.col("frame_no") * 30).alias("t_ms"), (F.lit(120.0) + F.col("frame_no") % 97).alias("f0"), "voiced")
    return C.speaker_segments(frames, m.clip_embeddings().drop("cluster_id"), pitch).select("video_id", "seg_idx", "start_ms", "end_ms", "speaker_label", "gender")


_SIZE = """CASE WHEN z IS NULL THEN '-' WHEN z < 1024 THEN z || ' B' WHEN z < 1048576 THEN printf('%.1f KB', round_even(z / 1024.0 * 10, 0) / 10) WHEN z < 1073741824 THEN printf('%.1f MB', round_even(z / 1048576.0 * 10, 0) / 10)
    WHEN z < 1099511627776 THEN printf('%.1f GB', round_even(z / 1073741824.0 * 10, 0) / 10) ELSE printf('%.1f TB', round_even(z / 1099511627776.0 * 10, 0) / 10) END"""


@query("c5_run_summary", sql("results", _MERGED, """listed AS (SELECT video_id, clip_index, coalesce(output_filename, printf('clip_%02d.mp4', clip_index)) AS file, actual_duration_ms AS d, file_size_bytes AS z, status, CASE WHEN clip_index % 2 = 0 THEN '[EN] line ' || clip_index ELSE '—' END AS transcript
    FROM results WHERE NOT (status = 'Done' AND video_id IN (SELECT video_id FROM merged)) UNION ALL SELECT video_id, 0, 'merged.mp4', actual_duration_ms, file_size_bytes, 'Done', '—' FROM merged)""",
    body=f"""SELECT video_id, clip_index, file, CASE WHEN t IS NULL THEN '-' WHEN t >= 3600 THEN (t // 3600) || ':' || lpad((t // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') ELSE lpad((t // 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') END AS duration,
    {_SIZE} AS size, CASE WHEN status = 'Done' THEN '✓ Done' ELSE '✗ Failed' END AS status_label, transcript FROM (SELECT *, round_even(d / 1000.0, 0)::BIGINT AS t FROM listed)"""))
def c5(m: Model) -> DataFrame:
    results = C.stored(m.results(), "results")
    excerpts = results.select("video_id", "clip_index", F.when(F.col("clip_index") % 2 == 0, F.format_string("line %d", "clip_index")).otherwise("").alias("excerpt"))
    tracks = results.select("video_id", F.lit(False).alias("is_auto"), F.lit("en").alias("language")).distinct()
    none = results.limit(0).select("video_id", "clip_index", F.col("output_path").alias("path"))
    return C.run_summary(results, excerpts, tracks, none, none, keep_clips=False)[0]


@query("c6_select_sources", sql("formats", "attempts", _PICKS, _FLAGS, "info AS (SELECT l_orderkey::VARCHAR AS video_id, (min(l_suppkey) * 100)::INT AS height, max(line) AS n FROM lines WHERE line <= 7 GROUP BY 1)",
    body="""SELECT i.video_id, CASE WHEN n >= 3 THEN 'fr' ELSE 'vi' END AS language, CASE WHEN n >= 3 THEN '3' ELSE '1' END AS url, CASE WHEN v1 IS NOT NULL AND a1 IS NOT NULL THEN 'h264' WHEN v2 IS NOT NULL AND a2 IS NOT NULL THEN 'any' WHEN p1 IS NOT NULL THEN 'progressive_mp4' WHEN p2 IS NOT NULL THEN 'progressive' WHEN p3 IS NOT NULL THEN 'best' END AS rule,
    CASE WHEN v1 IS NOT NULL AND a1 IS NOT NULL THEN v1 WHEN v2 IS NOT NULL AND a2 IS NOT NULL THEN v2 ELSE coalesce(p1, p2, p3) END AS video_format, CASE WHEN drm THEN 'drm' WHEN tv_drm THEN 'tv_false_positive' WHEN height <= 360 THEN 'cap_360' WHEN height < 720 THEN 'lower_than_requested' ELSE 'ok' END AS diagnosis
    FROM info i LEFT JOIN picks p ON p.video_id = i.video_id LEFT JOIN flags f ON f.video_id = i.video_id"""))
def c6(m: Model) -> DataFrame:
    entry = F.struct(F.lit("vtt").alias("ext"), F.col("line").cast("string").alias("url"))
    lang = F.element_at(F.array(*[F.lit(x) for x in ("vi", "en", "fr", "de", "ja", "ko", "it")]), F.col("line"))
    lists = F.map_from_entries(F.collect_list(F.struct(lang, F.array(entry))))
    info = m.lines().where("line <= 7").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.lit("fr").alias("language"), (F.min("l_suppkey") * 100).cast("int").alias("height"), lists.alias("subtitles"), lists.alias("automatic_captions"))
    parts = C.select_sources(info, m.requests(), m.files(), m.formats(), m.attempts(), 720)
    chosen = parts["tracks"].select("video_id", "language", "url").join(parts["formats"].select("video_id", "rule", "video_format"), "video_id", "left")
    return chosen.join(parts["diagnosis"].select("video_id", "diagnosis"), "video_id", "left")


@query("h3_assigned_segments_per_clip", sql("cues", "segments", body="SELECT video_id, count(*) AS cues, count(DISTINCT CASE WHEN end_ms > start_ms THEN seg_idx END) AS segments, NULL::VARCHAR AS error FROM runs GROUP BY 1"))
def h3(m: Model) -> DataFrame:
    from cueflow.hooks import per_clip

    placed = assign_segment(m.whole_clip(), m.segments()).select("video_id", "clip_index", "cue_ord", "segment")
    return per_clip(placed, _segment_counts, "video_id string, cues long, segments long").select("video_id", "cues", "segments", "error")


def _segment_counts(frame):
    import pandas as pd

    return pd.DataFrame({"video_id": frame["video_id"].iloc[:1], "cues": [len(frame)], "segments": [frame["segment"].nunique()]})


@query("h5_failing_clips", sql("cues", body="SELECT video_id, 1 AS clip_index, CASE WHEN count(*) % 3 > 0 THEN count(*) END AS n, CASE WHEN count(*) % 3 = 0 THEN 'ValueError: no clips of ' || count(*) || ' cues' END AS error FROM cues GROUP BY video_id"))
def h5(m: Model) -> DataFrame:
    """User code that fails on some clips: the others come through, each failure is a row that says which clip it was."""
    from cueflow.hooks import per_clip

    return per_clip(m.whole_clip().select("video_id", "clip_index", "cue_ord"), _picky, "n long")


def _picky(frame):
    import pandas as pd

    if len(frame) % 3 == 0:
        raise ValueError(f"no clips of {len(frame)} cues")
    return pd.DataFrame({"n": [len(frame)]})


@query("h1_translate_with", r"""SELECT conv_id, turn, CASE WHEN bare = '' OR length(bare) % 5 = 0 THEN text ELSE reverse(bare) END AS translated, bare <> '' AND length(bare) % 5 = 0 AS failed
    FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM conversations)""")
def h1(m: Model) -> DataFrame:
    from cueflow.hooks import translate_with

    rows = m.table("conversations").select("conv_id", "turn", "text")
    return translate_with(rows, _shout, limits=LOCAL).select("conv_id", "turn", "translated", F.col("error").isNotNull().alias("failed"))


def _shout(text: str) -> str:
    """A stand-in for a translation service that fails on some texts."""
    if len(text) % 5 == 0:
        raise ValueError("no translation")
    return text[::-1]


@query("h2_synthesize_with", r"SELECT conv_id, turn, CASE WHEN bare <> '' THEN 'wav:' || md5(bare) END AS result FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS bare FROM conversations)")
def h2(m: Model) -> DataFrame:
    from cueflow.hooks import synthesize_with

    rows = m.table("conversations").select("conv_id", "turn", "text", F.lit("female").alias("voice"), F.lit("+0Hz").alias("pitch"))
    return synthesize_with(rows, _synthesized, limits=LOCAL).select("conv_id", "turn", "result")
