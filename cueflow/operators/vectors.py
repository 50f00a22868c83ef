"""Clusters of utterance embeddings per clip, and of whole corpora."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = ("video_id", "clip_index")
#: Most speakers, and least silhouette of a split.  Rows that one task clusters exactly.
MAX_SPEAKERS, MIN_SILHOUETTE = 4, 0.15
MAX_GROUP = 2_000
#: Clustering features of a larger clip, and rows of a salted part of it.
LEAVES, SALTED = 1_000, 20_000


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def _merges(distance: np.ndarray, size: np.ndarray, ks: list[int]) -> dict[int, np.ndarray]:
    """Average-linkage labels for each k, 0..k-1, numbered by first member; ``size``: rows that each point stands for."""
    n = len(distance)
    mean, size = distance.copy(), size.astype(float)
    np.fill_diagonal(mean, np.inf)
    label, out = np.arange(n), {}
    for left in range(n, 0, -1):
        if left in ks:
            out[left] = np.unique(label, return_inverse=True)[1]
        if left <= min(ks, default=n):
            break
        a, b = sorted(divmod(int(np.argmin(mean)), n))
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        mean[:, a] = mean[a]
        mean[a, a] = np.inf
        mean[b], mean[:, b] = np.inf, np.inf
        size[a] += size[b]
        label[label == b] = a
    return out


class _Features:
    """Clustering features of many vectors: at most LEAVES pairs of a count and a sum of unit vectors.

    A vector joins the leaf that it is nearest to within the threshold, else it starts one;
    when there are too many the threshold grows and the leaves themselves are put in anew.
    Features add up, so those of parts of a clip go in as vectors do.
    """

    def __init__(self, width: int):
        self.count, self.sum, self.threshold = np.zeros(0), np.zeros((0, width)), 0.0

    def add(self, count: np.ndarray, total: np.ndarray) -> None:
        for i in range(0, len(count), LEAVES):
            self._put(count[i : i + LEAVES], total[i : i + LEAVES])
            while len(self.count) > LEAVES:
                unit = _unit(self.sum)
                apart = 1 - unit @ unit.T
                np.fill_diagonal(apart, np.inf)
                self.threshold = max(2 * self.threshold, float(np.median(apart.min(axis=1))), 1e-9)
                old_count, old_sum = self.count, self.sum
                self.count, self.sum = np.zeros(0), np.zeros((0, old_sum.shape[1]))
                self._put(old_count, old_sum)

    def _put(self, count: np.ndarray, total: np.ndarray) -> None:
        own, left = _unit(total), np.ones(len(count), dtype=bool)
        while left.any():
            if len(self.count):
                at = np.flatnonzero(left)
                near = own[at] @ _unit(self.sum).T
                best = near.argmax(axis=1)
                fits = 1 - near[np.arange(len(at)), best] <= self.threshold
                np.add.at(self.count, best[fits], count[at[fits]])
                np.add.at(self.sum, best[fits], total[at[fits]])
                left[at[fits]] = False
            # The next leaf, and all of those left that are near to it.
            rest = np.flatnonzero(left)
            if len(rest):
                fits = rest[(1 - own[rest] @ own[rest[0]] <= self.threshold) | (rest == rest[0])]
                self.count = np.append(self.count, count[fits].sum())
                self.sum = np.vstack([self.sum, total[fits].sum(axis=0)])
                left[fits] = False
                # A threshold of zero only joins equal vectors, which the line above has done.
                if self.threshold == 0:
                    groups, first, inverse = np.unique(own[left], axis=0, return_index=True, return_inverse=True)
                    counts, sums = np.zeros(len(groups)), np.zeros((len(groups), own.shape[1]))
                    np.add.at(counts, inverse.ravel(), count[left])
                    np.add.at(sums, inverse.ravel(), total[left])
                    self.count, self.sum = np.append(self.count, counts), np.vstack([self.sum, sums])
                    left[:] = False


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, bool, list[list]]]:
    """(key, is it the first part, rows without their key) of runs of rows with one key; a run can come in several parts."""
    last = None
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, run in groupby(rows, key=lambda r: r[:keys]):
            yield key, key != last, [r[keys:] for r in run]
            last = key


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, dtype=float)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(clip, salt, utt_id, embedding) in order to the features of each salt of a clip."""

    def result(key: tuple, made: _Features) -> pa.RecordBatch:
        n = len(made.count)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, type=pa.int32()), pa.array(made.count), pa.array(made.sum.tolist(), type=pa.list_(pa.float64()))], names=["video_id", "clip_index", "n", "total"])

    current, made = None, None
    for key, first, rows in _groups(batches, 3):
        if first:
            if made is not None:
                yield result(current, made)
            current, made = key, _Features(len(rows[0][1]))
        unit = _unit(_matrix([r[1] for r in rows]))
        made.add(np.ones(len(unit)), unit)
    if made is not None:
        yield result(current, made)


def _leaves(ks: list[int]):
    """(clip, n, total) in order to the leaves of each clip: leaf, centre, labels for each of ``ks``."""

    def result(key: tuple, made: _Features) -> pa.RecordBatch:
        mean = made.sum / made.count[:, None]
        labels = _merges(1 - mean @ mean.T, made.count, [k for k in ks if k <= len(made.count)])
        n = len(made.count)
        # With fewer leaves than clusters each leaf is one.
        rows = [[int(labels[k][i]) if k in labels else i for k in ks] for i in range(n)]
        columns = [pa.array([key[0]] * n), pa.array([key[1]] * n, type=pa.int32()), pa.array(_unit(made.sum).tolist(), type=pa.list_(pa.float64())), pa.array(rows, type=pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["video_id", "clip_index", "centre", "labels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, made = None, None
        for key, first, rows in _groups(batches, 2):
            if first:
                if made is not None:
                    yield result(current, made)
                current, made = key, _Features(len(rows[0][1]))
            made.add(np.array([r[0] for r in rows]), _matrix([r[1] for r in rows]))
        if made is not None:
            yield result(current, made)

    return run


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(clip, salt, kind, utt_id, vector, labels), leaves before rows, to the labels of each row's nearest leaf."""
    centres, labels = [], []
    for key, first, rows in _groups(batches, 3):
        if first:
            centres, labels = [], []
        for kind, part in groupby(rows, key=lambda r: r[0]):
            part = list(part)
            if kind == 0:
                centres += [r[2] for r in part]
                labels += [r[3] for r in part]
                continue
            best = (_unit(_matrix([r[2] for r in part])) @ _matrix(centres).T).argmax(axis=1)
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n), pa.array([key[1]] * n, type=pa.int32()), pa.array([r[1] for r in part], type=pa.int64()), pa.array([labels[i] for i in best], type=pa.list_(pa.int32()))],
                names=["video_id", "clip_index", "utt_id", "labels"],
            )


def _cluster_large(rows: DataFrame, max_k: int) -> DataFrame:
    """As ``cluster_utterances``, by features of salted parts of each clip: rows(..., size)."""
    ks = list(range(2, max_k + 1))
    salts = F.ceil(F.col("size") / SALTED).cast("int")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("utt_id"), salts).cast("int"))
    key = ["video_id", "clip_index", "salt"]
    features = salted.select(*key, "utt_id", "embedding").repartition(*key).sortWithinPartitions(*key, "utt_id").mapInArrow(_featured, "video_id string, clip_index int, n double, total array<double>")
    leaves = features.repartition(*CLIP).sortWithinPartitions(*CLIP, "n", "total").mapInArrow(_leaves(ks), "video_id string, clip_index int, centre array<double>, labels array<int>")
    sizes = rows.groupBy(*CLIP).agg(F.first("size").alias("size"))
    visiting = leaves.join(sizes, list(CLIP)).select(*CLIP, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("utt_id"), F.col("centre").alias("vector"), "labels")
    own = salted.select(*key, F.lit(1).alias("kind"), "utt_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.lit(None).cast("array<int>").alias("labels"))
    placed = visiting.unionByName(own).repartition(*key).sortWithinPartitions(*key, "kind", "utt_id").mapInArrow(_placed, "video_id string, clip_index int, utt_id long, labels array<int>")
    return placed.select(*CLIP, "utt_id", F.posexplode("labels").alias("k", "cluster_id")).withColumn("k", F.col("k") + 2).select(*CLIP, "utt_id", "k", "cluster_id")


def cluster_utterances(embeddings: DataFrame, max_k: int = MAX_SPEAKERS) -> DataFrame:
    """A row per utterance and k = 2..max_k (at most one less than utterances) with its cluster_id.

    Average linkage under cosine distance.  Exact in clips of up to MAX_GROUP utterances.
    Larger ones are first summed up in at most LEAVES clustering features, built in salted
    parts and then put together: the mean distance of two features is exact, so only the
    leaves' width is approximate.  Each utterance gets the cluster of its nearest leaf.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("utt_id").reset_index(drop=True)
        ids, ks = frame[["video_id", "clip_index", "utt_id"]], list(range(2, min(max_k, len(frame) - 1) + 1))
        if not ks:
            return ids.iloc[:0].assign(k=0, cluster_id=0)
        unit = _unit(np.vstack(frame["embedding"].to_numpy()).astype(float))
        labels = _merges(1 - unit @ unit.T, np.ones(len(frame)), ks)
        return pd.concat([ids.assign(k=k, cluster_id=labels[k]) for k in ks])

    rows = embeddings.select("video_id", F.col("clip_index").cast("int").alias("clip_index"), F.col("utt_id").cast("long").alias("utt_id"), "embedding")
    sized = rows.join(rows.groupBy(*CLIP).agg(F.count("*").alias("size")), list(CLIP))
    small = sized.where(F.col("size") <= MAX_GROUP).drop("size").groupBy(*CLIP).applyInPandas(one, "video_id string, clip_index int, utt_id long, k int, cluster_id int")
    return small.unionByName(_cluster_large(sized.where(F.col("size") > MAX_GROUP), max_k))


def silhouette(labelled: DataFrame, keys: tuple[str, ...] = CLIP) -> DataFrame:
    """Mean cosine silhouette per key of labelled(keys, utt_id, cluster_id, embedding).

    The mean cosine of a row to a cluster is the product of its unit vector with the cluster's
    sum of unit vectors: each row meets the sums of its key's clusters, never other rows.
    """
    squares = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    normed = labelled.select(*keys, "utt_id", "cluster_id", "embedding", squares.alias("norm"))
    unit = F.transform("embedding", lambda x: F.when(F.col("norm") > 0, x.cast("double") / F.col("norm")).otherwise(0.0))
    rows = normed.select(*keys, "utt_id", "cluster_id", unit.alias("u"))
    parts = rows.select(*keys, "cluster_id", F.posexplode("u").alias("i", "x")).groupBy(*keys, "cluster_id", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = parts.groupBy(*keys, "cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("total"), F.max("n").alias("n"))
    clusters = sums.groupBy(*keys).agg(F.collect_list(F.struct("cluster_id", "n", "total")).alias("clusters"))

    def distance(c: Column) -> Column:
        own = c["cluster_id"] == F.col("cluster_id")
        dot = lambda v: F.aggregate(F.zip_with("u", v, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
        others, alike = c["n"] - own.cast("int"), dot(c["total"]) - F.when(own, dot(F.col("u"))).otherwise(0.0)
        return F.struct(own.alias("own"), F.when(others > 0, 1 - alike / others).alias("d"))

    met = rows.join(clusters, list(keys)).withColumn("d", F.transform("clusters", distance))
    inside = F.get(F.transform(F.filter("d", lambda x: x["own"]), lambda x: x["d"]), F.lit(0))
    outside = F.array_min(F.transform(F.filter("d", lambda x: ~x["own"]), lambda x: x["d"]))
    scored = met.select(*keys, inside.alias("a"), outside.alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return scored.groupBy(*keys).agg(F.avg(s).alias("score"))


def choose_k(scores: DataFrame) -> DataFrame:
    """k of each clip from scores(k, score): the best, smallest on ties; one cluster if it is poor."""
    best = scores.groupBy(*CLIP).agg(F.max_by("k", F.struct("score", -F.col("k"))).alias("k"), F.max("score").alias("score"))
    return best.withColumn("k", F.when(F.col("score") >= MIN_SILHOUETTE, F.col("k")).otherwise(1))


def speaker_clusters(embeddings: DataFrame, max_k: int = MAX_SPEAKERS) -> DataFrame:
    """video_id, clip_index, utt_id, cluster_id under the chosen k; one cluster for one or two utterances."""
    tried = cluster_utterances(embeddings, max_k)
    with_vectors = tried.join(embeddings.select(*CLIP, "utt_id", "embedding"), [*CLIP, "utt_id"])
    chosen = choose_k(silhouette(with_vectors, (*CLIP, "k")))
    labels = tried.join(chosen.select(*CLIP, "k"), [*CLIP, "k"]).select(*CLIP, "utt_id", "cluster_id")
    return embeddings.select(*CLIP, "utt_id").join(labels, [*CLIP, "utt_id"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0)))


def cluster_corpus(embeddings: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """Clusters of any number of rows(utt_id, embedding), by bisecting k-means under cosine distance.

    Approximate: the split depends on the seed.
    """
    vectors = embeddings.withColumn("features", array_to_vector("embedding"))
    model = BisectingKMeans(k=k, seed=seed, distanceMeasure="cosine").fit(vectors)
    return model.transform(vectors).withColumn("cluster_id", F.col("prediction")).drop("features", "prediction")


def relabelled(labels: DataFrame) -> DataFrame:
    """cluster_id renumbered from 0 by each clip's first member, so that partitions compare."""
    first = labels.groupBy(*CLIP, "cluster_id").agg(F.min("utt_id").alias("first"))
    number = first.withColumn("number", F.row_number().over(Window.partitionBy(*CLIP).orderBy("first")) - 1)
    return labels.join(number, [*CLIP, "cluster_id"]).select(*CLIP, "utt_id", F.col("number").alias("cluster_id"))
