"""Timed-text tables that the driver's tables stand for, as DataFrames and as DuckDB CTEs.

Every rule is integer arithmetic, so both sides agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueflow.functions.text import word_count


class Model:
    """The tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def cues(self) -> DataFrame:
        """Conversations as cues: 300 ms a word, gaps of 200 ms, or 2 s behind every fourth turn."""
        turns = self.table("conversations").select("conv_id", "turn", "role", "text").withColumn("len", 300 * word_count(F.col("text")))
        gap = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, 2000).otherwise(200)
        before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
        timed = turns.withColumn("start_ms", F.coalesce(F.sum(F.col("len") + gap).over(before), F.lit(0)))
        return timed.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("cue_ord"), "start_ms", (F.col("start_ms") + F.col("len")).alias("end_ms"), "text", F.col("role").alias("speaker_label"))

    def line_cues(self) -> DataFrame:
        """Lines of documents as cues of one clip, a second each and 100 ms apart."""
        lines = self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("cue_ord", "text"))
        start = F.col("cue_ord") * 1100
        return lines.select(F.col("doc_id").cast("string").alias("video_id"), F.lit(1).alias("clip_index"), "cue_ord", start.cast("long").alias("start_ms"), (start + 1000).cast("long").alias("end_ms"), "text")

    def clips(self) -> DataFrame:
        """Two overlapping clips of every conversation."""
        videos = self.table("conversations").select(F.col("conv_id").cast("string").alias("video_id")).distinct()
        bounds = F.array(*[F.struct(F.lit(i).alias("clip_index"), F.lit(a).cast("long").alias("start_ms"), F.lit(z).cast("long").alias("end_ms")) for i, a, z in ((1, 0, 20000), (2, 15000, 45000))])
        return videos.select("video_id", F.inline(bounds)).withColumn("label", F.format_string("Clip %d", "clip_index"))

    def whole_clip(self) -> DataFrame:
        """Cues as one clip per video, speakers and all."""
        return self.cues().withColumn("clip_index", F.lit(1))

    def segments(self) -> DataFrame:
        """Runs of one role as speech turns of clip 1."""
        order = Window.partitionBy("video_id").orderBy("cue_ord")
        change = F.coalesce((F.col("speaker_label") != F.lag("speaker_label").over(order)).cast("int"), F.lit(0))
        runs = self.cues().withColumn("c", change).withColumn("seg_idx", F.sum("c").over(order).cast("int"))
        spans = runs.groupBy("video_id", "seg_idx").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("speaker_label").alias("speaker_label"))
        return spans.select("video_id", F.lit(1).alias("clip_index"), "seg_idx", "start_ms", "end_ms", "speaker_label", F.when(F.col("speaker_label") == "user", "male").otherwise("female").alias("gender"))

    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def frames(self) -> DataFrame:
        """Events of a user as frames: an error is silence."""
        number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
        return self.table("events").select(F.col("user_id").cast("string").alias("video_id"), F.lit(1).alias("clip_index"), number.alias("frame_no"), (F.col("event_type") != "error").alias("voiced"))

    def statuses(self) -> DataFrame:
        """Events as status updates: run = user, clip = event number modulo 5."""
        status = F.when(F.col("event_type") == "error", "Failed").when(F.col("event_type") == "purchase", "Done").otherwise("Cutting")
        return self.events().select("ts", "event_id", F.col("user_id").cast("string").alias("run_id"), (F.col("event_id") % 5).cast("int").alias("clip_index"), status.alias("status"))

    def attempts(self) -> DataFrame:
        """Events as download attempts: clients take turns, errors fail."""
        number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
        rows = self.table("events").withColumn("attempt_no", number.cast("int"))
        client = F.element_at(F.array(*[F.lit(c) for c in ("default", "tv", "ios", "android")]), (F.col("event_id") % 4 + 1).cast("int"))
        message = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
        return rows.select(F.col("user_id").cast("string").alias("video_id"), "attempt_no", client.alias("client"), ((F.col("event_type") != "error") & (F.col("event_id") % 3 == 0)).alias("ok"), message.alias("message"))

    def lines(self) -> DataFrame:
        """Order lines, numbered within their order: ``line``."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        return self.table("lineitem").withColumn("line", F.row_number().over(order))

    def results(self) -> DataFrame:
        """Order lines as clip results: order = video, line = clip."""
        line, order = F.col("line"), F.col("l_orderkey")
        status = F.when(F.col("l_returnflag") == "R", "Failed").otherwise("Done")
        return self.lines().select(
            order.cast("string").alias("video_id"), line.cast("int").alias("clip_index"), status.alias("status"),
            F.when(status == "Done", F.concat(F.lit("/out/"), order.cast("string"), F.lit("_"), line.cast("string"))).alias("output_path"),
            F.when(F.col("l_partkey") % 7 == 0, F.format_string("part %d.mp4", "l_partkey")).alias("output_filename"),
            (F.col("l_partkey") * 7919 * F.col("l_suppkey")).alias("file_size_bytes"), F.when(F.col("l_suppkey") % 11 > 0, F.col("l_partkey") * 37).alias("actual_duration_ms"),
        )

    def formats(self) -> DataFrame:
        """Order lines as formats of a video."""
        pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))
        part, supp = F.col("l_partkey"), F.col("l_suppkey")
        return self.lines().select(
            F.col("l_orderkey").cast("string").alias("video_id"), F.format_string("f%d", "line").alias("format_id"), pick(("mp4", "webm", "m4a"), part).alias("ext"),
            pick(("avc1.64", "vp9", "none"), part).alias("vcodec"), pick(("none", "mp4a", "opus"), supp).alias("acodec"), pick((360, 720, 1080), supp).alias("height"),
        )

    def files(self) -> DataFrame:
        """Orders as media files."""
        pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))
        order = F.col("o_orderkey")
        path = F.concat(F.lit("/media/source_video"), F.lpad(order.cast("string"), 6, "0"), F.lit("_"), pick(("best", "720", "1080"), order), pick((".mp4", ".webm", ".PART", ".mkv"), order))
        return self.table("orders").select(path.alias("path"), F.when(order % 5 == 0, 0).otherwise(order * 1000).cast("long").alias("length"), F.timestamp_seconds(order).alias("modificationTime"))

    def requests(self) -> DataFrame:
        """Orders as requests for videos."""
        order = F.col("o_orderkey")
        url = F.concat(F.lit("https://www.youtube.com/watch?list=x&v=video"), F.lpad(order.cast("string"), 6, "0"), F.lit("&t=3"))
        return self.table("orders").select(url.alias("url"), F.element_at(F.array(F.lit("best"), F.lit("720")), (order % 2 + 1).cast("int")).alias("resolution"))

    def clip_embeddings(self) -> DataFrame:
        """Embeddings in clips of 25."""
        return self.table("embeddings").select(F.format_string("v%d", F.floor(F.col("vec_id") / 25)).alias("video_id"), F.lit(1).alias("clip_index"), (F.col("vec_id") % 25).alias("utt_id"), "embedding", F.col("label").alias("cluster_id"))


MESSAGES = (
    "ERROR: ERROR: Could not copy Chrome cookie database", "HTTP Error 403: Forbidden", "Requested format is not available",
    "This video is DRM protected", "Video unavailable. This video is private", "<urlopen error timed out>", "something else",
)

_LIST = lambda names: "[" + ", ".join(str(n) if isinstance(n, int) else "'" + n + "'" for n in names) + "]"
WORDS = r"len(regexp_extract_all({0}, '[^\s]+'))"

_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS line FROM lineitem)"

CTE: dict[str, str] = {
    "cues": r"""
        cues_len AS (SELECT conv_id, turn, role, text, 300 * len(regexp_extract_all(text, '[^\s]+')) AS dur FROM conversations),
        cues_at AS (SELECT *, coalesce(sum(dur + CASE WHEN (conv_id + turn) % 4 = 0 THEN 2000 ELSE 200 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM cues_len),
        cues AS (SELECT conv_id::VARCHAR AS video_id, turn::INT AS cue_ord, start_ms, (start_ms + dur)::BIGINT AS end_ms, text, role AS speaker_label FROM cues_at)""",
    "line_cues": """
        line_cues AS (SELECT doc_id::VARCHAR AS video_id, 1 AS clip_index, (i - 1)::INT AS cue_ord, ((i - 1) * 1100)::BIGINT AS start_ms, ((i - 1) * 1100 + 1000)::BIGINT AS end_ms, ls[i] AS text
            FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i))""",
    "clips": """
        clips AS (SELECT DISTINCT conv_id::VARCHAR AS video_id, c.clip_index, c.start_ms, c.end_ms, 'Clip ' || c.clip_index AS label
            FROM conversations, (VALUES (1, 0::BIGINT, 20000::BIGINT), (2, 15000::BIGINT, 45000::BIGINT)) AS c(clip_index, start_ms, end_ms))""",
    "segments": """
        runs AS (SELECT *, sum(c) OVER (PARTITION BY video_id ORDER BY cue_ord)::INT AS seg_idx FROM (SELECT *, coalesce((speaker_label <> lag(speaker_label) OVER (PARTITION BY video_id ORDER BY cue_ord))::INT, 0) AS c FROM cues)),
        segments AS (SELECT video_id, 1 AS clip_index, seg_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(speaker_label) AS speaker_label,
            CASE WHEN min(speaker_label) = 'user' THEN 'male' ELSE 'female' END AS gender FROM runs GROUP BY video_id, seg_idx)""",
    "frames": """
        frames AS (SELECT user_id::VARCHAR AS video_id, 1 AS clip_index, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no, event_type <> 'error' AS voiced FROM events)""",
    "statuses": """
        statuses AS (SELECT ts, event_id, user_id::VARCHAR AS run_id, (event_id % 5)::INT AS clip_index, CASE event_type WHEN 'error' THEN 'Failed' WHEN 'purchase' THEN 'Done' ELSE 'Cutting' END AS status FROM events)""",
    "attempts": f"""
        attempts AS (SELECT user_id::VARCHAR AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS attempt_no, ['default', 'tv', 'ios', 'android'][event_id % 4 + 1] AS client,
            event_type <> 'error' AND event_id % 3 = 0 AS ok, {_LIST(MESSAGES)}[event_id % {len(MESSAGES)} + 1] AS message FROM events)""",
    "lines": _LINES,
    "results": _LINES + """,
        results AS (SELECT l_orderkey::VARCHAR AS video_id, line::INT AS clip_index, CASE WHEN l_returnflag = 'R' THEN 'Failed' ELSE 'Done' END AS status,
            CASE WHEN l_returnflag <> 'R' THEN '/out/' || l_orderkey || '_' || line END AS output_path, CASE WHEN l_partkey % 7 = 0 THEN 'part ' || l_partkey || '.mp4' END AS output_filename,
            l_partkey * 7919 * l_suppkey AS file_size_bytes, CASE WHEN l_suppkey % 11 > 0 THEN l_partkey * 37 END AS actual_duration_ms FROM lines)""",
    "formats": _LINES + """,
        formats AS (SELECT l_orderkey::VARCHAR AS video_id, 'f' || line AS format_id, ['mp4', 'webm', 'm4a'][l_partkey % 3 + 1] AS ext, ['avc1.64', 'vp9', 'none'][l_partkey % 3 + 1] AS vcodec,
            ['none', 'mp4a', 'opus'][l_suppkey % 3 + 1] AS acodec, [360, 720, 1080][l_suppkey % 3 + 1] AS height FROM lines)""",
    "files": """
        files AS (SELECT '/media/source_video' || lpad(o_orderkey::VARCHAR, 6, '0') || '_' || ['best', '720', '1080'][o_orderkey % 3 + 1] || ['.mp4', '.webm', '.PART', '.mkv'][o_orderkey % 4 + 1] AS path,
            CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey * 1000 END AS length, o_orderkey AS mtime FROM orders)""",
    "requests": """
        requests AS (SELECT 'https://www.youtube.com/watch?list=x&v=video' || lpad(o_orderkey::VARCHAR, 6, '0') || '&t=3' AS url, ['best', '720'][o_orderkey % 2 + 1] AS resolution FROM orders)""",
    "embedded": """
        embedded AS (SELECT 'v' || (vec_id // 25) AS video_id, 1 AS clip_index, vec_id % 25 AS utt_id, embedding, label AS cluster_id FROM embeddings)""",
}


def sql(*ctes: str, body: str, recursive: bool = False) -> str:
    """A DuckDB query over the model's CTEs."""
    parts = [CTE[c].strip() if c in CTE else c for c in ctes]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
