"""Throttle and cooldown of tables against a plain loop."""

import random

import numpy as np
import pytest

from cueflow.streaming import jobs as X

ROW = "ts timestamp_ltz, key string, event_id long, limited boolean"


def walked(rows, gap, cooled):
    out, at = [], {}
    for t, key, n, limited in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2])):
        ok = key not in at or t >= at[key] + gap
        if ok and (limited or not cooled):
            at[key] = t
        if ok:
            out.append((key, n))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out, n = [], 0
    for key, count, step in (("hot", 3000, 40), ("slow", 200, 5000), ("a", 30, 300), (None, 50, 200), ("once", 1, 1), ("ties", 60, 1)):
        t = rng.randint(-5000, 5000)
        for _ in range(count):
            t += rng.choice([0, 0, 1, rng.randint(0, step), step * (20 if rng.random() < 0.02 else 1)])
            out.append((t, key, n, rng.random() < 0.2))
            n += 1
    out.append((None, "a", n, True))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("gap", [0, 1, 300, 1000, 7001])
def test_gates_let_the_right_rows_through(spark, rows, gap):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "t long, key string, event_id long, limited boolean").withColumn("ts", F.timestamp_millis("t")).withColumn("part", F.lit("clash")).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for cooled, gate in ((False, X.throttle), (True, X.cooldown)):
            assert sorted(((r.key, r.event_id) for r in gate(df, gap).collect()), key=repr) == walked(rows, gap, cooled)
            assert gate(df.limit(0), gap).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_part_s_state_passes_from_batch_to_batch():
    times = np.arange(0, 100_000, 7)
    whole, _ = X._admitted(times, times < 0, None, 1000)
    state, parts = None, []
    for a in range(0, len(times), 100):
        got, state = X._admitted(times[a : a + 100], times[a : a + 100] < 0, state, 1000)
        parts.append(got)
    assert (np.concatenate(parts) == whole).all()
