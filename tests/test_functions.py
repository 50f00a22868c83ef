"""Column functions against documented examples."""

import pytest
from pyspark.sql import functions as F

from cueflow.functions import display as D
from cueflow.functions import text as X
from cueflow.functions import times as T


def each(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_parse_timestamp(spark):
    assert each(spark, T.parse_timestamp_ms, ["07:55", "1:02:09", "61:00", "1:2", "00:60", " 7:05 ", "", None]) == [475000, 3729000, None, None, None, 425000, None, None]


def test_time_formats(spark):
    assert each(spark, T.format_duration, [475000, 3729000, 500, 1500, -5, None], "long") == ["07:55", "1:02:09", "00:00", "00:02", "00:00", None]
    assert each(spark, T.format_srt, [3723004, 0, None], "long") == ["01:02:03,004", "00:00:00,000", None]
    assert each(spark, T.format_hms_ms, [3723004], "long") == ["01:02:03.004"]
    assert each(spark, T.vtt_ms, ["01:02:03.004", "02:03.500", "x"]) == [3723004, 123500, None]


def test_filesize_and_names(spark):
    assert each(spark, D.format_filesize, [None, 512, 1536, 6400, 5 * 1024**3, 3 * 1024**5], "long") == ["-", "512 B", "1.5 KB", "6.2 KB", "5.0 GB", "3072.0 TB"]
    assert each(spark, D.sanitize_filename, ["a<b>:c?", " /\\ ", "ok.mp4"]) == ["abc", "clip", "ok.mp4"]
    assert each(spark, lambda c: D.output_filename(c, F.lit(3)), [None, "x.mp4", ""]) == ["clip_03.mp4", "x.mp4", "clip_03.mp4"]


def test_preview(spark):
    long = "word " * 30
    assert each(spark, lambda c: D.transcript_preview(c, F.lit("vi"), F.lit(True)), ["", "xin chào", long]) == ["—", "[VI · Tự động] xin chào", "[VI · Tự động] " + long[:80].rstrip() + "…"]
    assert each(spark, lambda c: D.transcript_preview(c, F.lit(None), F.lit(False)), ["x"]) == ["[?] x"]


def test_urls(spark):
    urls = ["https://www.youtube.com/watch?list=x&v=abcdefghijk&t=3", "https://youtu.be/abcdefghijk", "http://example.com", None]
    assert each(spark, D.extract_video_id, urls) == ["abcdefghijk", "abcdefghijk", None, None]
    assert each(spark, D.valid_url, [" https://youtu.be/a ", "YouTube.com/shorts/x", "https://example.com", None]) == [True, True, False, False]


@pytest.mark.parametrize(
    ("given", "text", "fillers", "repeats", "dropped"),
    [
        (">> Joe: >> Reuben: This is a very important point.", "This is a very important point.", 0, 0, False),
        (">> Joe: >> Reuben:", "", 0, 0, True),
        ("I mean, this is important.", "This is important.", 1, 0, False),
        ("I mean what I said.", "I mean what I said.", 0, 0, False),
        ("This is, like, really cool.", "This is really cool.", 1, 0, False),
        ("very, very, very important", "very important", 0, 2, False),
        ("I think, I think so", "I think so", 0, 1, False),
        ("không không được", "không được", 0, 1, False),
        ("um, so it goes", "So it goes", 1, 0, False),
    ],
)
def test_clean_cue(spark, given, text, fillers, repeats, dropped):
    assert tuple(each(spark, X.clean_cue, [given])[0]) == (text, fillers, repeats, dropped)


def test_start_filler_takes_the_blank_after_a_sentence(spark):
    assert each(spark, lambda c: X.remove_fillers(c)["text"], ["Ok. Well, this is"]) == ["Ok.this is"]


def test_openers(spark):
    assert each(spark, X.opener, ["Obviously, it works", "It is obviously true", "LOOK , here"]) == ["Tất nhiên", None, "Này"]
    assert each(spark, X.without_opener, ["Obviously, it works", "It is"]) == ["it works", "It is"]
    assert each(spark, lambda c: X.apply_opener(F.lit("Tất nhiên"), c), ["Nó chạy", "  "]) == ["Tất nhiên, nó chạy", "Tất nhiên."]


def test_languages_and_logs(spark):
    assert each(spark, X.language_code, ["zh-Hans", "zh-Hant", "zh-Hant-HK", "ja", None]) == ["zh-CN", "zh-TW", "zh-CN", "ja", None]
    assert each(spark, X.clean_log_message, ["\x1b[0;31mERROR:\x1b[0m ERROR: no"]) == ["ERROR: no"]


def test_words_and_tags(spark):
    assert each(spark, X.word_count, [" a  b c\n", "", None]) == [3, 0, 0]
    assert each(spark, X.strip_tags, ["<c>a</c>  <i>b</i> "]) == ["a b"]
    assert each(spark, X.capitalize_first, ["  abc", "(abc", "", "đá"]) == ["  Abc", "(abc", "", "Đá"]


def test_is_due(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert each(spark, lambda c: T.is_due(c, now, 86_400_000), ["2024-01-01 00:00:00", "2024-01-01 00:00:01", "", "junk", None]) == [True, False, True, True, True]


def test_repeats_go_as_by_six_plain_searches(spark):
    """Against the searches in full, with words that share starts, marks, commas and other scripts."""
    import random
    import re

    rng = random.Random(5)
    vocabulary = ["a", "ab", "A", "không", "KHÔNG", "ß", "été", "e\u0301t", "x1", "_", "b"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", ", ", ",", ". ", "\u00a0", " - "]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    plain = F.col("v")
    for n in (3, 2, 1, 3, 2, 1):
        plain = F.regexp_replace(plain, rf"(?iU)\b(\w+(?:\s+\w+){{{n - 1}}})\b(?:[,]?\s+\1\b)+", "$1")
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", plain.alias("plain"), X.dedupe_repeats(F.col("v")).alias("r"), F.col("v").rlike(X._RECURRING).alias("searched")).collect()
    assert [r.r.text for r in rows] == [re.sub(r"\s+", " ", r.plain).strip() for r in rows]
    # Before, every text was searched for all three lengths, twice.
    assert 200 < sum(not r.searched for r in rows)
