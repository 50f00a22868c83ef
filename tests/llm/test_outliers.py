"""The robust estimate of the quality rules against numpy, and the verdict on planted junk."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueflow.llm.quality import DIM, FLOOR, X, judged, minimum_determinants


def log_det(points, weights=None):
    cov = np.cov(points.T, bias=True, aweights=weights) if len(points) > 1 else np.zeros((DIM, DIM))
    return np.linalg.slogdet(cov + np.diag(np.square(FLOOR)))[1]


def concentrated(points, starts, rng):
    """The smallest log determinant over half of the points from many random starts, and its half."""
    half, best = -(-len(points) // 2), (np.inf, None)
    for _ in range(starts):
        near, last = rng.choice(len(points), DIM + 1, replace=False), np.inf
        while True:
            mean = points[near].mean(0)
            cov = np.cov(points[near].T, bias=True) + np.diag(np.square(FLOOR))
            gap = points - mean
            near = np.argsort(np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap), kind="stable")[:half]
            now = log_det(points[near])
            if now > last - 1e-9:
                break
            last = now
        if last < best[0]:
            best = (last, near)
    return best


def test_determinants_against_numpy(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(DIM, DIM))
    cells = {
        "tiny": rng.normal(size=(9, DIM)) * 2,
        "clean": rng.normal(size=(700, DIM)) @ mix,
        # 45 in 100 rows in a tight heap far away, which plain moments would go to.
        "heap": np.vstack([rng.normal(size=(330, DIM)) @ mix, rng.normal(size=(270, DIM)) * 0.3 + 12]),
        "same": np.tile(rng.normal(size=(1, DIM)), (50, 1)),
        "one": rng.normal(size=(1, DIM)),
    }
    rows = spark.createDataFrame([(c, *map(float, p)) for c, points in cells.items() for p in points], "cell string, " + ", ".join(f"{x} double" for x in X))
    got = {r["cell"]: r for r in minimum_determinants(rows).collect()}
    assert set(got) == set(cells)
    # Nine rows without structure have dozens of local minima: the starts need not lead to the lowest, but to a low one.
    every = sorted(log_det(cells["tiny"][list(s)]) for s in itertools.combinations(range(9), 5))
    assert got["tiny"].logdet <= every[len(every) // 10]
    for c in ("clean", "heap"):
        want, near = concentrated(cells[c], 60, rng)
        assert abs(got[c].logdet - want) < 0.05, c
        assert np.abs(np.array(got[c]["mean"]) - cells[c][near].mean(0)).max() < 0.25
        assert got[c].n == pytest.approx(len(cells[c]) / 2)
    for c in ("same", "one"):
        assert np.allclose(got[c]["mean"], cells[c][0]) and got[c].logdet == pytest.approx(2 * sum(map(math.log, FLOOR)))
    again = {r["cell"]: r.logdet for r in minimum_determinants(rows.orderBy(X[1]).repartition(7)).collect()}
    assert all(again[c] == pytest.approx(got[c].logdet, abs=1e-6) for c in cells)


def good(rng):
    words = ["the", "of", "and", "people", "water", "house", "between", "which", "city", "river", "small", "important"]
    return " ".join(rng.choice(words) + str(i % 7) * (i % 3 == 0) for i in range(rng.randint(60, 220)))


def junk(rng):
    return " ".join("#$%" * rng.randint(1, 3) + rng.choice("abc") + str(rng.randint(0, 10**6)) for _ in range(rng.randint(60, 220)))


def verdicts(spark, parts):
    """Kept rows by (source, good) for [(lang, source, number of good rows, number of junk rows)]."""
    rng = random.Random(3)
    rows = [(lang, source, ok, good(rng) if ok else junk(rng)) for lang, source, n, bad in parts for ok in [True] * n + [False] * bad]
    docs = spark.createDataFrame([(i, lang, source, int(ok), text) for i, (lang, source, ok, text) in enumerate(rows)], "doc_id long, lang string, source string, ok int, text string")
    out = judged(docs).join(docs.select("doc_id", "ok"), "doc_id").where("not base_failed")
    return {(r.source, bool(r.ok)): r.kept for r in out.groupBy("source", "ok").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}


def test_a_source_with_much_junk(spark):
    kept = verdicts(spark, [("en", "a", 240, 160)])
    assert kept["a", True] >= 0.98 and kept["a", False] == 0


@pytest.mark.parametrize("n", [34, 35])
def test_small_tables_are_judged_as_large_ones(spark, n):
    kept = verdicts(spark, [("en", "a", n, max(1, n // 7))])
    assert kept["a", True] == 1 and kept["a", False] == 0


def test_small_sources_are_judged_by_wider_cells(spark):
    kept = verdicts(spark, [("en", "a", 150, 10), ("en", "junk", 0, 3), ("en", None, 3, 1), ("xx", "b", 2, 1), (None, None, 1, 0)])
    assert kept["a", False] == kept["junk", False] == kept[None, False] == kept["b", False] == 0
    assert kept["a", True] >= 0.98 and kept[None, True] == kept["b", True] == 1
