"""Readers, writers, rankings, sets, vectors and hooks on small files and tables."""

from pyspark.sql import functions as F

from cueflow.hooks import synthesize_with, translate_with
from cueflow.operators import joins as J
from cueflow.operators import predicates as P
from cueflow.operators import ranking as R
from cueflow.operators import sequences as W
from cueflow.operators import sets as U
from cueflow.operators import vectors as V
from cueflow.sources import readers as S
from cueflow.sources import writers as O

VTT = "WEBVTT\r\nKind: captions\r\n\r\nNOTE nothing\r\n\r\n1\r\n00:01.000 --> 00:02.500 align:start\r\n<c>Hello</c>   there\r\n42\r\nyou\r\n\r\n01:00:00.000 --> 01:00:01.000\r\n\r\n\r\n00:03.000-->00:04.000\nbye"


def test_captions(spark, tmp_path):
    (tmp_path / "transcript_abc.manual.en.vtt").write_text(VTT, newline="")
    (tmp_path / "transcript_abc.auto.en.vtt").write_text(VTT.replace("Hello", "Auto"), newline="")
    (tmp_path / "transcript_xyz.manual.de.vtt").write_text("WEBVTT\n\n")
    (tmp_path / "transcript_xyz.auto.vi.vtt").write_text("00:00.000 --> 00:00.100\nxin")
    rows = S.read_captions(spark, str(tmp_path / "*.vtt")).orderBy("video_id", "cue_ord").collect()
    assert [(r.video_id, r.language, r.is_auto, r.start_ms, r.end_ms, r.text) for r in rows] == [
        ("abc", "en", False, 1000, 2500, "Hello there you"), ("abc", "en", False, 3000, 4000, "bye"), ("xyz", "vi", True, 0, 100, "xin"),
    ]


def test_video_info(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "v", "language": "fr", "height": 360, "subtitles": {"de": [{"ext": "srv", "url": "u1"}, {"ext": "vtt", "url": "u2"}]}, "automatic_captions": {"fr": [{"ext": "x", "url": "u3"}]}}\n')
    tracks = S.info_tracks(S.read_video_info(spark, str(tmp_path)))
    picked = R.pick_track(tracks).withColumn("url", R.pick_track_url(F.col("entries"))).first()
    assert (picked.language, picked.is_auto, picked.url) == ("fr", True, "u3")
    assert R.pick_track(tracks.where("not is_auto")).withColumn("url", R.pick_track_url(F.col("entries"))).first().url == "u2"


def test_notes_to_clips(spark):
    text = "Clip #1\nStart Time: 07:55\nEnd Time: 08:51\n\nClip #2\nStart Time: 10:00\nEnd Time: 09:00\n\nClip #3\nStart Time\n1:02:09\nEnd Time - 1:03:00\n"
    boxes = spark.createDataFrame([("v", 2, text[30:]), ("v", 1, text[:30]), ("v", 3, "  ")], "video_id string, box_ord int, text string")
    assert S.read_clip_notes(boxes).first().text.startswith("Clip #1")
    notes = spark.createDataFrame([("v", text), ("none", "no times"), ("null", None)], "video_id string, text string")
    clips = W.reindex_clips(P.valid_clip_range(J.zip_pairs(notes)))
    assert [tuple(r) for r in clips.select("clip_index", "start_ms", "end_ms", "label").orderBy("clip_index").collect()] == [(1, 475000, 531000, "Clip 1"), (2, 3729000, 3780000, "Clip 3")]


def test_media_inventory(spark, tmp_path):
    for name in ("source_abc_720.mp4", "source_a_b_best.webm", "source_abc_1080.part", "other.mp4"):
        (tmp_path / name).write_bytes(b"xx")
    (tmp_path / "source_e_360.mp4").write_bytes(b"")
    listed = S.read_media_inventory(spark, str(tmp_path))
    assert "content" not in listed.columns
    done = P.completed_media(listed)
    assert {(r.video_id, r.resolution) for r in done.collect()} == {("abc", "720"), ("a_b", "best")}


def test_srt_files(spark, tmp_path):
    cues = spark.createDataFrame([("v", 1, 1, 2000, 3000, "b"), ("v", 1, 0, 0, 1500, "a"), ("w", 2, 0, 10, 20, "c")], "video_id string, clip_index int, cue_ord int, rel_start_ms long, rel_end_ms long, translated string")
    O.write_srt(cues, str(tmp_path / "srt"))
    files = {str(p.parent.relative_to(tmp_path / "srt")): p.read_text() for p in (tmp_path / "srt").rglob("part-*.txt")}
    assert files == {
        "video_id=v/clip_index=1": "1\n00:00:00,000 --> 00:00:01,500\na\n\n2\n00:00:02,000 --> 00:00:03,000\nb\n\n",
        "video_id=w/clip_index=2": "1\n00:00:00,010 --> 00:00:00,020\nc\n\n",
    }


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("v", 1, "Done"), ("v", 2, "Failed")], "video_id string, clip_index int, status string")
    O.write_manifest(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("status = 'Done'").count() == 1


def test_format_chain(spark):
    rows = [("v", "a", "mp4", "avc1", "none", 1080), ("v", "b", "mp4", "avc1", "none", 720), ("v", "c", "m4a", "none", "mp4a", None), ("w", "d", "webm", "vp9", "none", 720), ("w", "e", "webm", "none", "opus", None), ("x", "f", "flv", "h263", "mp3", 1080)]
    formats = spark.createDataFrame(rows, "video_id string, format_id string, ext string, vcodec string, acodec string, height int")
    got = {r.video_id: (r.rule, r.video_format, r.audio_format) for r in R.pick_format(formats, 720).collect()}
    assert got == {"v": ("h264", "b", "c"), "w": ("any", "d", "e"), "x": ("best", "f", None)}
    assert {r.video_id for r in R.pick_format(formats, 720, progressive_only=True).collect()} == {"x"}


def test_consecutive_and_merge_only(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k int, o int, v string")
    assert [r.o for r in U.distinct_consecutive(rows, ["k"], "o", "v").orderBy("o").collect()] == [1, 3, 5]
    results = spark.createDataFrame([("v", 1, "Done", "p"), ("v", 2, "Failed", None), ("v", 3, "Done", "q")], "video_id string, clip_index int, status string, output_path string")
    merged = spark.createDataFrame([("v", "Done")], "video_id string, status string")
    assert [r.clip_index for r in U.merge_only(results, merged).collect()] == [2]
    assert U.merge_only(results, merged.withColumn("status", F.lit("Failed"))).count() == 3


def test_error_kinds(spark):
    messages = ["ERROR: Could not copy Chrome cookie database", "HTTP Error 403", "Requested format is not available", "Video unavailable", "urlopen error", "odd", "cookies are nice", None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m string").select("i", P.classify_attempt_error(F.col("m")).alias("k"))
    assert [r.k for r in df.orderBy("i").collect()] == ["cookie", "forbidden", "format_unavailable", "video_unavailable", "network", "other", "other", None]


def test_hooks_call_once_per_key_and_keep_failures_apart(spark, tmp_path):
    items = spark.createDataFrame([(1, "a "), (2, "a"), (3, "bad"), (4, "  "), (5, "kept")], "i int, text string")
    cache = spark.createDataFrame([("kept", "from cache", None)], "text string, result string, error string")
    log = str(tmp_path)

    def fn(text):
        import os
        import uuid

        open(os.path.join(log, f"{text}-{uuid.uuid4()}"), "w").close()
        if text == "bad":
            raise ValueError("no")
        return text.upper()

    rows = {r.i: (r.translated, r.error) for r in translate_with(items, fn, cache).collect()}
    assert rows == {1: ("A", None), 2: ("A", None), 3: ("bad", "ValueError: no"), 4: ("  ", None), 5: ("from cache", None)}
    calls = sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    assert calls == ["a", "bad", "bad", "bad"]
    spoken = items.withColumn("voice", F.lit("f")).withColumn("pitch", F.lit("0"))
    assert {r.i: r.result for r in synthesize_with(spoken, lambda t, v, p: f"{t}{v}{p}" if t != "bad" else 1 / 0).collect()} == {1: "af0", 2: "af0", 3: None, 4: None, 5: "keptf0"}


def test_clusters_find_planted_groups(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = np.eye(3, 8)
    rows = [("v", 1, i, [float(x) for x in centres[i % 3] + rng.normal(0, 0.03, 8)]) for i in range(12)] + [("w", 1, 0, [1.0] * 8), ("w", 1, 1, [-1.0] * 8)]
    df = spark.createDataFrame(rows, "video_id string, clip_index int, utt_id long, embedding array<float>")
    got = {(r.video_id, r.utt_id): r.cluster_id for r in V.relabelled(V.speaker_clusters(df)).collect()}
    assert [got["v", i] for i in range(12)] == [0, 1, 2] * 4
    assert got["w", 0] == got["w", 1] == 0


def test_corpus_clusters_refuse_nothing(spark, sf_dir):
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("utt_id"), "embedding")
    assert V.cluster_corpus(emb, 4).count() == emb.count()


def test_files_are_written_by_several_tasks(spark, tmp_path):
    """Small files were left to one task by adaptive execution."""
    from cueflow.sources.writers import write_captions

    write_captions(spark.createDataFrame([(f"transcript_{i}.manual.en.vtt", "WEBVTT") for i in range(40)], "file_name string, value string"), str(tmp_path / "files"))
    written = list((tmp_path / "files").rglob("part-*"))
    assert len(written) == 40 and len({p.name.split("-")[1] for p in written}) > 1


def test_files_are_written_as_spark_writes_them(spark, tmp_path):
    """Files that tasks write themselves have the folders and texts of Spark's own writer, and no checksums beside them."""
    from cueflow.sources.writers import write_texts

    keys = ["a", "b c", "x/y", "50%", "q?*:=#'\"{[]^}\\", "é ü", "\x01\x7f", "", None, "__x", ".h"]
    rows = [(k, i % 2, t) for i, k in enumerate(keys) for t in ("one\ntwo", "", None)]
    texts = spark.createDataFrame(rows, "k string, n int, value string")
    for _ in range(2):
        write_texts(texts, str(tmp_path / "own"), "k", "n")
    texts.repartition(1, "k", "n").write.partitionBy("k", "n").option("lineSep", "\n").text(str(tmp_path / "spark"))
    found = {name: {str(p.parent.relative_to(tmp_path / name)): sorted(p.read_text().split("\n")) for p in (tmp_path / name).rglob("part-*.txt")} for name in ("own", "spark")}
    assert found["own"] == found["spark"]
    assert not [p for p in (tmp_path / "own").rglob("*") if p.is_file() and not p.name.startswith(("part-", "_SUCCESS"))]
    assert (tmp_path / "own" / "_SUCCESS").exists()


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Each folder was a task of the listing job; the session keeps its own setting."""
    from cueflow.sources.writers import write_captions

    write_captions(spark.createDataFrame([(f"transcript_{i}.manual.en.vtt", "WEBVTT") for i in range(80)], "file_name string, value string"), str(tmp_path / "files"))
    before, status = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        assert S.caption_texts(spark, str(tmp_path / "files")).count() == 80
        tasks = [status.getStageInfo(k).numTasks for job in status.getJobIdsForGroup("listing") for k in status.getJobInfo(job).stageIds if status.getStageInfo(k)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks and max(tasks) < 40
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_caption_files_are_read_once(spark, tmp_path):
    """A video's first file that holds cues is known from the cues, not from a second reading of all files."""
    cue = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n{}\n"
    for name, text in (("a.manual.en", ""), ("a.auto.vi", "x"), ("b.manual.fr", "y"), ("b.manual.en", "z"), ("b.auto.vi", "w")):
        (tmp_path / f"transcript_{name}.vtt").write_text(cue.format(text) if text else "WEBVTT\n")
    read = S.read_captions(spark, str(tmp_path))
    assert {(r.video_id, r.language, r.is_auto, r.text) for r in read.collect()} == {("a", "vi", True, "x"), ("b", "en", False, "z")}
    assert read._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
