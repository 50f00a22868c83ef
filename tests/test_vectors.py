"""Clusters of utterances against plain average linkage, small and large clips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueflow.operators import vectors as V

ROW = "video_id string, clip_index int, utt_id long, embedding array<float>"


def plain_linkage(vectors, k):
    """Partition of the rows into k by average linkage on cosine distances, all pairs each time."""
    unit = [v / np.linalg.norm(v) for v in vectors]
    parts = [[i] for i in range(len(unit))]
    while len(parts) > k:
        pairs = [(np.mean([1 - unit[i] @ unit[j] for i in a for j in b]), x, y) for x, a in enumerate(parts) for y, b in enumerate(parts) if x < y]
        _, x, y = min(pairs)
        parts[x] += parts.pop(y)
    return {frozenset(p) for p in parts}


def partition(rows):
    out = {}
    for i, c in rows:
        out.setdefault(c, set()).add(i)
    return {frozenset(p) for p in out.values()}


def clip(spark, vectors, name="v"):
    return spark.createDataFrame([(name, 1, i, [float(x) for x in v]) for i, v in enumerate(vectors)], ROW)


def test_small_clips_are_exact(spark):
    rng = np.random.default_rng(2)
    for n in (3, 9, 24):
        vectors = rng.normal(0, 1, (n, 6)).astype(np.float32)
        got = V.cluster_utterances(clip(spark, vectors)).collect()
        for k in range(2, min(4, n - 1) + 1):
            assert partition((r.utt_id, r.cluster_id) for r in got if r.k == k) == plain_linkage(vectors.astype(float), k)


def direct_silhouette(vectors, labels):
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm > 0, norm, 1)
    d, scores = 1 - unit @ unit.T, []
    for i, own in enumerate(labels):
        same = [j for j in range(len(labels)) if labels[j] == own and j != i]
        others = [np.mean([d[i, j] for j in range(len(labels)) if labels[j] == c]) for c in set(labels) - {own}]
        a, b = (np.mean(d[i, same]) if same else None), (min(others) if others else None)
        scores.append(0 if a is None or b is None else (b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette_is_the_direct_one_without_pairs(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 1, (40, 5))
    vectors[7] = 0
    labels = [int(x) for x in rng.integers(0, 3, 39)] + [9]
    df = clip(spark, vectors.astype(np.float32)).join(spark.createDataFrame(list(enumerate(labels)), "utt_id long, cluster_id int"), "utt_id")
    assert V.silhouette(df).first().score == pytest.approx(direct_silhouette(vectors.astype(np.float32).astype(float), labels), abs=1e-9)
    assert V.silhouette(df.withColumn("cluster_id", F.lit(1))).first().score == 0
    assert V.silhouette(df.limit(0)).count() == 0
    plan = V.silhouette(clip(spark, vectors).withColumn("cluster_id", F.col("utt_id") % 3))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


@pytest.fixture(scope="module")
def large(spark):
    """A clip of 50,000 utterances of three speakers of unlike size, one of two, and one of 2,001 equal rows."""
    noise = lambda d: (F.pmod(F.xxhash64("id", F.lit(d)), 1000) / 1000 - 0.5) * 0.5
    who = F.when(F.col("id") % 10 < 6, 0).when(F.col("id") % 10 < 9, 1).otherwise(2)
    vector = F.array(*[(F.when(who == d, 1.0).otherwise(0.0) + noise(d)).cast("float") for d in range(8)])
    main = spark.range(50_000).select(F.lit("big").alias("video_id"), F.lit(1).alias("clip_index"), F.col("id").alias("utt_id"), vector.alias("embedding"))
    equal = spark.range(2_001).select(F.lit("equal").alias("video_id"), F.lit(1).alias("clip_index"), F.col("id").alias("utt_id"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    return main.unionByName(clip(spark, [[1, 0], [0, 1]], "two")).unionByName(equal)


def test_clips_of_any_size(spark, large):
    got = V.speaker_clusters(large).cache()
    assert got.groupBy("video_id").count().orderBy("video_id").collect() == [("big", 50_000), ("equal", 2_001), ("two", 2)]
    cells = got.where("video_id = 'big'").groupBy((F.when(F.col("utt_id") % 10 < 6, 0).when(F.col("utt_id") % 10 < 9, 1).otherwise(2)).alias("who"), "cluster_id").count().collect()
    assert sorted(r["count"] for r in cells) == [5_000, 15_000, 30_000] and len({r.cluster_id for r in cells}) == 3
    assert got.where("video_id <> 'big'").agg(F.max("cluster_id")).first()[0] == 0
    got.unpersist()


def test_features_keep_counts_and_sums():
    rng = np.random.default_rng(3)
    unit = V._unit(rng.normal(0, 1, (5_000, 4)))
    unit[100:200] = unit[0]
    made = V._Features(4)
    for i in range(0, 5_000, 700):
        made.add(np.ones(len(unit[i : i + 700])), unit[i : i + 700])
    assert len(made.count) <= V.LEAVES and made.count.sum() == 5_000 and np.allclose(made.sum.sum(axis=0), unit.sum(axis=0))
    same = V._Features(4)
    same.add(np.ones(300), np.repeat(unit[:3], 100, axis=0))
    assert sorted(same.count) == [100, 100, 100]
