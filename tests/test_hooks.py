"""Hooks under limits: hanging, failing and rate-limited services."""

import threading
import time

from cueflow import hooks as H

TEXT = "i int, text string"


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), TEXT)


def test_a_hanging_call_costs_its_own_row_only(spark):
    def fn(text):
        if text.startswith("hang"):
            time.sleep(30)
        return text.upper()

    began = time.monotonic()
    out = H.translate_with(texts(spark, "a", "hang 1", "b", "hang 2", "c"), fn, partitions=1, limits=H.Limits(attempts=2, timeout_s=0.5))
    rows = {r.text: (r.translated, r.error) for r in out.collect()}
    assert rows == {"a": ("A", None), "b": ("B", None), "c": ("C", None), "hang 1": ("hang 1", "TimeoutError: no result within 0.5 s"), "hang 2": ("hang 2", "TimeoutError: no result within 0.5 s")}
    assert time.monotonic() - began < 25


def service(limits, fn):
    frames = lambda n: iter([__import__("pandas").DataFrame({"text": [f"t{i}" for i in range(n)]})])
    return lambda n: next(H._mapped(fn, ["text"], limits)(frames(n)))


def test_calls_keep_their_distance_and_their_number():
    starts, running, most, lock = [], [0], [0], threading.Lock()

    def fn(text):
        with lock:
            starts.append(time.monotonic())
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.12)
        with lock:
            running[0] -= 1
        return text

    frame = service(H.Limits(slots=3, spacing_s=0.03, timeout_s=5), fn)(20)
    gaps = [b - a for a, b in zip(starts, starts[1:], strict=False)]
    assert most[0] == 3 and min(gaps) >= 0.02 and frame["result"].tolist() == frame["text"].tolist() and starts[-1] - starts[0] < 20 * 0.12


def test_a_rate_limited_service_is_tried_again_later():
    calls = []

    def fn(text):
        calls.append(time.monotonic())
        if len(calls) < 3:
            raise RuntimeError("429")
        return "" if text == "t1" else text

    frame = service(H.Limits(attempts=3, retry_s=0.1, timeout_s=5), fn)(2)
    assert frame["result"].tolist() == ["t0", None] and frame["error"].tolist() == [None, "ValueError: empty result"]
    assert len(calls) == 6 and calls[1] - calls[0] >= 0.1


def test_a_service_that_always_hangs_is_given_up(monkeypatch):
    monkeypatch.setattr(H, "HANGING", 4)
    ended = threading.Event()
    frame = service(H.Limits(attempts=1, timeout_s=0.02), lambda text: ended.wait(20))(30)
    ended.set()
    assert frame["error"].tolist() == ["TimeoutError: no result within 0.02 s"] * 4 + ["TimeoutError: 4 calls hang"] * 26


def test_a_failing_clip_is_named(spark):
    import pandas as pd

    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7), (None, 1, 8)], "video_id string, clip_index int, x int")

    def fn(frame):
        if frame["x"].iloc[0] == 6:
            raise KeyError("six")
        return pd.DataFrame({"total": [int(frame["x"].sum())]})

    got = {(r.video_id, r.clip_index): (r.total, r.error) for r in H.per_clip(df, fn, "total long").collect()}
    assert got == {("a", 1): (5, None), ("a", 2): (None, "KeyError: 'six'"), ("b", 1): (7, None), (None, 1): (8, None)}
    assert H.per_clip(df, fn, "clip_index int, total long").columns == ["video_id", "clip_index", "total", "error"]
    assert H.per_clip(df.limit(0), fn, "total long").count() == 0
