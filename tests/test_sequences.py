"""Window and fold operators against worked examples and properties."""

import random

from pyspark.sql import functions as F

from cueflow.operators import joins as J
from cueflow.operators import ranking as R
from cueflow.operators import sequences as W
from cueflow.plans import jobs as C
from cueflow.plans.model import Model

CUE = "video_id string, clip_index int, cue_ord int, start_ms long, end_ms long, text string, speaker_label string"
SEG = "video_id string, clip_index int, seg_idx int, start_ms long, end_ms long, speaker_label string, gender string"


def cues(spark, rows):
    return spark.createDataFrame([("v", 1, i, a, z, t, s) for i, (a, z, t, s) in enumerate(rows)], CUE)


def segments(spark, rows):
    return spark.createDataFrame([("v", 1, i, a, z, s, g) for i, (a, z, s, g) in enumerate(rows)], SEG)


def windows(df):
    out = {}
    for r in df.orderBy("cue_ord").collect():
        out.setdefault(r.window_id, []).append(r.cue_ord)
    return [out[k] for k in sorted(out)]


def test_one_long_turn_is_one_window(spark):
    c = cues(spark, [(i * 1200, (i + 1) * 1200, "đây là một câu rất dài được", None) for i in range(8)])
    assert windows(W.dub_windows(c, segments(spark, [(0, 9600, "Speaker 1", "female")]))) == [list(range(8))]


def test_real_pause_cuts_a_full_turn(spark):
    rows = [(i * 1000, (i + 1) * 1000, " ".join(["một"] * 8), None) for i in range(10)] + [(10200 + i * 1000, 11200 + i * 1000, " ".join(["hai"] * 6), None) for i in range(2)]
    assert windows(W.dub_windows(cues(spark, rows), segments(spark, [(0, 12200, "Speaker 1", "male")]))) == [list(range(10)), [10, 11]]


def test_speaker_change_cuts(spark):
    c = cues(spark, [(0, 1000, "xin chào", None), (1000, 2000, "tôi khỏe", None)])
    out = W.dub_windows(c, segments(spark, [(0, 1000, "Speaker 1", "female"), (1000, 2000, "Speaker 2", "male")]))
    assert windows(out) == [[0], [1]]
    assert [r.speaker_label for r in out.orderBy("cue_ord").collect()] == ["Speaker 1", "Speaker 2"]


def test_without_segments_caps_cut(spark):
    c = cues(spark, [(i * 1000, (i + 1) * 1000, "một hai ba", None) for i in range(8)])
    assert windows(W.dub_windows(c, segments(spark, [(0, 1, "x", "male")]).limit(0))) == [list(range(6)), [6, 7]]


def test_translation_windows(spark):
    c = cues(spark, [(0, 1000, "One.", None), (1000, 2000, "two", None), (3501, 4000, "three", None), (4000, 5000, "  ", None), (5500, 6000, "four", None)])
    assert windows(W.translation_windows(c)) == [[0], [1], [2, 4]]


def test_rolling_text(spark):
    c = cues(spark, [(0, 1, "luôn vui vẻ, luôn tràn đầy", None), (1, 2, "luôn vui vẻ, luôn tràn đầy năng lượng tích cực và", None)])
    assert [r.excerpt for r in W.merge_rolling_text(c).collect()] == ["luôn vui vẻ, luôn tràn đầy năng lượng tích cực và"]
    assert [r.text for r in W.dedupe_rolling(c).orderBy("cue_ord").collect()] == ["luôn vui vẻ, luôn tràn đầy", "năng lượng tích cực và"]


def test_rolling_text_compares_with_all_or_with_the_last(spark):
    c = cues(spark, [(0, 1, "a b c", None), (1, 2, "C", None), (2, 3, "B c d", None)])
    assert [r.text for r in W.dedupe_rolling(c).orderBy("cue_ord").collect()] == ["a b c", "B c d"]
    assert W.merge_rolling_text(c).first().excerpt == "a b c d"


def test_short_cues_merge(spark):
    c = cues(spark, [(0, 500, "a b", None), (500, 1000, "c", None), (1000, 3000, "d", None), (3000, 3100, "e", None), (3100, 3200, " ".join("x" * 12), None)])
    assert [(r.cue_ord, r.start_ms, r.end_ms, r.text) for r in W.merge_short_cues(c).orderBy("cue_ord").collect()] == [(0, 0, 3000, "a b c d"), (3, 3000, 3100, "e"), (4, 3100, 3200, "x x x x x x x x x x x x")]


def test_speech_islands(spark):
    def spans(voiced):
        rows = [("v", 1, i, i in voiced) for i in range(80)]
        return [(r.start_ms, r.end_ms) for r in W.speech_islands(spark.createDataFrame(rows, "video_id string, clip_index int, frame_no int, voiced boolean")).orderBy("start_ms").collect()]

    assert spans({*range(20), *range(30, 50)}) == [(0, 1500)]
    assert spans({*range(20), *range(31, 51)}) == [(0, 600), (930, 1530)]
    assert spans(set(range(11))) == []
    assert spans(set(range(12))) == [(0, 360)]


def test_voices_go_down_the_pitches(spark):
    s = segments(spark, [(i, i + 1, f"Speaker {i + 1}", g) for i, g in enumerate(["male", "female", "male", "male", "male", "male"])])
    assert [r.pitch for r in W.assign_voices(s).orderBy("speaker_label").collect()] == ["+0Hz", "+0Hz", "-14Hz", "-28Hz", "-42Hz", "-42Hz"]


def test_word_ratio(spark):
    row = spark.createDataFrame([("v", 1, 0, [(0, "a b c"), (1, "d"), (2, "e f")], "1 2 3 4 5 6 7")], "video_id string, clip_index int, window_id int, cues array<struct<cue_ord:int,text:string>>, translated string")
    assert [r.part for r in W.split_by_word_ratio(row).orderBy("cue_ord").collect()] == ["1 2 3 4", "5", "6 7"]
    none = row.withColumn("translated", F.lit(""))
    assert [r.part for r in W.split_by_word_ratio(none).collect()] == ["", "", ""]


def test_word_ratio_parts_rejoin(spark):
    random.seed(5)
    rows = [("v", 1, i, [(k, " ".join("w" * random.randint(1, 6))) for k in range(random.randint(1, 6))], " ".join(f"t{j}" for j in range(random.randint(0, 20)))) for i in range(40)]
    df = spark.createDataFrame(rows, "video_id string, clip_index int, window_id int, cues array<struct<cue_ord:int,text:string>>, translated string")
    got = {}
    for r in W.split_by_word_ratio(df).orderBy("window_id", "cue_ord").collect():
        got.setdefault(r.window_id, []).append(r.part)
    assert {i: " ".join(p for p in got[i] if p) for i in got} == {r[2]: r[4] for r in rows}


def test_windows_partition_the_spoken_cues(spark, sf_dir):
    lines = Model(spark, sf_dir).line_cues()
    spoken = lines.where(F.length(F.trim(F.regexp_replace("text", r"\s", ""))) > 0).count()
    out = W.translation_windows(lines)
    assert out.count() == spoken
    assert out.groupBy("video_id").agg(F.max("window_id").alias("m"), F.count_distinct("window_id").alias("c")).where("m + 1 <> c").count() == 0
    assert out.groupBy("video_id", "window_id").count().where("count > 6").count() == 0


def test_best_segment_ties_go_to_the_earliest(spark):
    c = cues(spark, [(1000, 3000, "x", None), (9000, 9500, "y", None)])
    s = segments(spark, [(0, 2000, "A", "male"), (2000, 4000, "B", "male")])
    assert [r.speaker_label for r in J.assign_speaker(c, s).orderBy("cue_ord").collect()] == ["A", None]
    assert [r.segment for r in J.assign_segment(c, s, bin_ms=700).orderBy("cue_ord").collect()] == [0, None]


def test_binned_interval_join_is_the_plain_one(spark):
    random.seed(3)
    span = lambda: (a := random.randint(0, 50_000), a + random.randint(0, 9_000))
    left = spark.createDataFrame([(str(i % 3), i, *span()) for i in range(150)], "video_id string, l int, start_ms long, end_ms long")
    right = spark.createDataFrame([(str(i % 3), i, *span()) for i in range(150)], "video_id string, r int, start_ms long, end_ms long")
    plain = {tuple(r) for r in J.interval_join(left, right, ["video_id"]).select("l", "r").collect()}
    for bin_ms in (1_000, 7_777, 100_000):
        pairs = [tuple(r) for r in J.interval_join(left, right, ["video_id"], bin_ms).select("l", "r").collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == plain


def test_excerpts_of_nothing(spark, sf_dir):
    m = Model(spark, sf_dir)
    assert C.clip_excerpts(m.cues().limit(0), m.clips()).count() == 0


def test_plans_shuffle_once_and_stay_in_the_jvm(spark, sf_dir):
    m = Model(spark, sf_dir)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = W.translation_windows(m.whole_clip())._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan
        joined = J.clip_cue_join(m.cues(), m.clips())._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in joined and "BroadcastNestedLoop" not in joined
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def greedy_windows(rows, turns=None):
    """Windows of (start, end, words, speaker or turn, pause allowed) by a plain loop over the rules."""
    out, n, w, number = [], 0, 0, -1
    for i, (a, z, words, hard, may) in enumerate(rows):
        if i == 0 or hard or ((n >= W.MAX_CUES or w >= W.MAX_WORDS) and may):
            number, n, w = number + 1, 0, 0
        n, w = n + 1, w + words
        out.append(number)
    return out


def long_clip(spark, n, words="pmod(xxhash64(id), 9) + 1", gap="0"):
    text = F.array_join(F.array_repeat(F.lit("x"), F.expr(f"cast({words} as int)")), " ")
    start = F.col("id") * 1000
    return spark.range(n).select(F.lit("v").alias("video_id"), F.lit(1).alias("clip_index"), F.col("id").cast("int").alias("cue_ord"), start.alias("start_ms"), (start + 1000 - F.expr(gap)).alias("end_ms"), text.alias("text"), F.lit(None).cast("string").alias("speaker_label"))


def test_windows_of_an_island_of_many_chunks(spark):
    cues = long_clip(spark, 30_000)
    rows = cues.orderBy("cue_ord").collect()
    want = greedy_windows([(r.start_ms, r.end_ms, len(r.text.split()), False, True) for r in rows])
    got = [r.window_id for r in W.translation_windows(cues.repartition(3)).orderBy("cue_ord").collect()]
    assert got == want
    assert [r.window_id for r in W.dub_windows_fallback(cues).orderBy("cue_ord").collect()] == want


def test_a_turn_of_many_chunks_is_cut_at_pauses_only(spark):
    cues = long_clip(spark, 12_000, gap="if(pmod(xxhash64(id, 7), 23) = 0, 100, 0)")
    rows = cues.orderBy("cue_ord").collect()
    want = greedy_windows([(r.start_ms, r.end_ms, len(r.text.split()), False, i > 0 and r.start_ms - rows[i - 1].end_ms > W.REAL_PAUSE_MS) for i, r in enumerate(rows)])
    turn = segments(spark, [(0, 12_000_000, "Speaker 1", "male")])
    assert [r.window_id for r in W.dub_windows_by_segment(cues, turn).orderBy("cue_ord").collect()] == want


def test_two_hundred_thousand_cues_in_one_island(spark):
    out = W.translation_windows(long_clip(spark, 200_000, words="1"))
    assert out.agg(F.count("*"), F.max("window_id")).first() == (200_000, 33_333)
    assert out.groupBy("window_id").count().where("count > 6").count() == 0


def merged_cues(rows):
    """The rule of short cues as a plain loop over (start, end, text)."""
    out = []
    for a, z, t in rows:
        if out and out[-1][1] - out[-1][0] < W.SHORT_CUE_MS and len(out[-1][2].split()) + len(t.split()) <= W.MERGED_WORDS:
            out[-1] = (out[-1][0], z, f"{out[-1][2]} {t}")
        else:
            out.append((a, z, t))
    return out


def test_short_cues_of_a_long_clip(spark):
    rng = random.Random(8)
    rows, at = [], 0
    for _ in range(20_000):
        at += rng.choice([0, 0, 100, 400])
        # Some overlap the one before, some are long, many are tiny.
        a = max(0, at - rng.choice([0, 0, 0, 900]))
        at = a + rng.choice([50, 200, 500, 1199, 1200, 2500])
        rows.append((a, at, " ".join("x" * rng.choice([1, 1, 2, 5, 11, 13]))))
    got = [(r.start_ms, r.end_ms, r.text) for r in W.merge_short_cues(cues(spark, [(*r, None) for r in rows]).repartition(3)).orderBy("cue_ord").collect()]
    assert got == merged_cues(rows)
    tiny = long_clip(spark, 20_000, words="1").withColumns({"start_ms": F.col("cue_ord").cast("long"), "end_ms": F.col("cue_ord").cast("long") + 1})
    assert W.merge_short_cues(tiny).count() == -(-20_000 // 12)


def rolled_together(texts):
    done = []
    for own in (t.split() for t in texts):
        fit = [k for k in range(min(len(done), len(own)), 0, -1) if [w.lower() for w in done[-k:]] == [w.lower() for w in own[:k]]]
        done += own[fit[0] if fit else 0 :]
    return " ".join(done)


def test_rolling_text_of_a_long_clip(spark):
    rng = random.Random(9)
    texts, last = [], []
    for i in range(20_000):
        new = [rng.choice("aabcD") if rng.random() < 0.3 else f"w{i}" for _ in range(rng.randint(0, 7))]
        last = [w.upper() if rng.random() < 0.1 else w for w in last[-rng.randint(1, 6) :]] + new if rng.random() < 0.8 else new
        texts.append(" ".join(last))
    out = W.merge_rolling_text(cues(spark, [(i, i + 1, t, None) for i, t in enumerate(texts)]).repartition(3)).first()
    assert out.excerpt == rolled_together(texts) and out.n_words == len(out.excerpt.split())
    same = cues(spark, [(i, i + 1, "a a a a b", None) for i in range(50)] + [(60, 61, "", None), (61, 62, "a b a", None)])
    assert W.merge_rolling_text(same).first().excerpt == rolled_together(["a a a a b"] * 50 + ["", "a b a"])


def test_stamps_are_parsed_once(spark):
    """A filter on times and their use don't make a plan that parses every stamp over and over."""
    from cueflow.operators.predicates import valid_clip_range

    text = "Start Time: 07:55\nEnd Time: 08:51\nStart Time: 10:00 End Time: 09:00\nstart time - 1:02:09 end time\n1:03:00\nStart Time 00:61 End Time 2:00"
    clips = W.reindex_clips(valid_clip_range(J.zip_pairs(spark.createDataFrame([("v", text)], "video_id string, text string"))))
    got = [(r.clip_index, r.start_ms, r.end_ms, r.label) for r in clips.orderBy("clip_index").collect()]
    assert got == [(1, 475000, 531000, "Clip 1"), (2, 3729000, 3780000, "Clip 2")]
    assert clips._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 2


def test_word_shares_count_once(spark):
    """Every text is counted once, not once for each cue of its window."""
    rows = [("v", 1, 0, [(0, "a b c"), (1, "d"), (2, "e f")], "1 2 3 4 5 6 7"), ("v", 1, 1, [(3, "a"), (4, "")], "x"), ("v", 1, 2, [(5, "b")], "p  q"), ("v", 1, 3, [], "r")]
    out = W.split_by_word_ratio(spark.createDataFrame(rows, "video_id string, clip_index int, window_id int, cues array<struct<cue_ord int, text string>>, translated string"))
    assert {r.cue_ord: r.part for r in out.collect()} == {0: "1 2 3 4", 1: "5", 2: "6 7", 3: "", 4: "x", 5: "p  q"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 3


def test_common_paths_are_dealt_over_salts(spark, monkeypatch):
    """A path that most videos name, there or not; repeated videos and files; no candidates at all."""
    monkeypatch.setattr(R, "SPREAD", 10)
    videos = [(f"v{i:03d}", ["/none.bin", "/all.webm" if i % 2 else f"/own_{i}.mkv"]) for i in range(80)] + [("v001", ["/none.bin"]), ("w", []), ("x", ["/a/source_x_1.mp4.mp4"])]
    files = [(p, 1, t) for t, p in enumerate(["/all.mp4", "/all.mp4", "/own_4.mkv", "/m/source_v006_720.mp4", "/m/source_v006_best.webm", "/a/source_x_1.mp4", "/m/source_w_1.part"])]
    ddl = spark.createDataFrame(files, "path string, length long, t long").withColumn("modificationTime", F.timestamp_seconds("t"))
    got = R.resolve_artifact(spark.createDataFrame(videos, "video_id string, paths array<string>"), ddl).collect()
    odd = {f"v{i:03d}": "/all.mp4" for i in range(1, 80, 2)}
    known = odd | {"v004": "/own_4.mkv", "v006": "/m/source_v006_best.webm", "x": "/a/source_x_1.mp4"}
    assert sorted((r.video_id, r.path) for r in got) == sorted(((v, known.get(v)) for v, _ in videos), key=lambda r: r[0])


def test_merged_clips_go_by_one_join(spark):
    """Results aren't joined with themselves; a failed clip, one without a path and other videos stay."""
    from cueflow.operators.sets import merge_only

    results = spark.createDataFrame([("a", 1, "Done", "/1"), ("a", 2, "Failed", None), ("a", 3, "Done", None), ("b", 1, "Done", "/2"), ("c", 1, "Done", "/3"), ("c", 2, None, "/4")], "video_id string, clip_index int, status string, output_path string")
    merged = spark.createDataFrame([("a", "Done"), ("a", "Done"), ("b", "Failed"), ("c", "Done")], "video_id string, status string")
    left = merge_only(results, merged)
    assert {(r.video_id, r.clip_index) for r in left.collect()} == {("a", 2), ("a", 3), ("b", 1), ("c", 2)} and left.count() == 4
    assert left._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
