"""Hard negatives by angular triangle filtering.

Every vector keeps its norm and its angles to a few reference directions.  Two angles to one
direction bound the angle between two vectors from both sides (triangle inequality on the
sphere), the tightest bounds over all directions give an interval of the cosine, and the norms
an interval of the score, widened so that rounding can't move the true score out of it.  Only
pairs whose interval overlaps the scores that are still wanted get an integer inner product:
for positives, what isn't below the fifth best so far; for negatives, the window of a positive
from its third best so far up.

Anchors are a stated set of queries.  Rows are dealt by a hash of their id into groups of at
most some GROUP rows, each anchor visits every group once: a task holds one group and lets
anchors pass, BLOCK at a time, in a stream that is sorted so that the group's rows come first.
It passes on at most five rows per anchor, or three per anchor and positive, and the best of
all groups follow by a ranking, which Spark limits before its shuffle.  Directions are chosen
from SAMPLE rows (those with the smallest hash of their id); they decide how much is filtered,
never what is found.

Defined results: rows with a null id or label, a null vector, or a null or non-finite
component take no part, nor do rows whose scaled vector is longer than 2^31 (scores then fit
64 bits, all sums are exact).  Shorter vectors count as filled up with zeros, an empty one
scores 0.  Rows with one vec_id count once, the least by label and vector.  A positive whose
window is empty, or without negatives in it, has no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.llm.shared import scratch, stored

#: Fixed values of the operator: scale of components, positives of an anchor, negatives of a positive, and percents of its score.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Rows of a group, anchors and rows that meet at a time, reference directions, and rows they are chosen from.
GROUP, BLOCK, SLICE, DIRECTIONS, SAMPLE = 65_536, 256, 2_048, 8, 2_048
#: Squared length up to which vectors take part; product of lengths up to which double sums are exact.
LONGEST, EXACT = 2.0**62, 2.0**53
#: Radians, and parts of the product of lengths, by which bounds are widened.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
NONE = np.iinfo(np.int64).min


def usable(embeddings: DataFrame, changed: Column) -> DataFrame:
    """vec_id, label, v (scaled integers) of the rows that take part; ``changed``: the label to use."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.coalesce(F.forall("x", lambda c: F.abs(c) < float("inf")), F.lit(False))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), changed.cast("long").alias("label"), x.alias("x")).where(finite)
    scaled = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * SCALE).cast("double")).alias("d"))
    short = scaled.where(F.aggregate("d", F.lit(0.0), lambda s, c: s + c * c) < LONGEST)
    kept = short.groupBy("vec_id").agg(F.min(F.struct("label", F.transform("d", lambda c: c.cast("long")).alias("v"))).alias("r"))
    return kept.select("vec_id", "r.label", "r.v")


def every_seventh_moved() -> Column:
    """The label, moved on by one (of ten) in rows whose id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def _matrix(vectors: list) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def directions(rows: DataFrame) -> np.ndarray:
    """Unit vectors far apart from each other, of a bounded sample: those with the smallest hashes of their ids."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    found = _matrix([r.v for r in sample]).astype(float)
    lengths = np.linalg.norm(found, axis=1)
    unit = found[lengths > 0] / lengths[lengths > 0][:, None]
    if not len(unit):
        return np.zeros((1, found.shape[1]))
    chosen = [unit[0]]
    nearest = unit @ unit[0]
    while len(chosen) < min(DIRECTIONS, len(unit)):
        chosen.append(unit[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, unit @ chosen[-1])
    return np.array(chosen)


class Vectors:
    """Some rows with their lengths and angles."""

    def __init__(self, ids: list, labels: list, vectors: list, axes: np.ndarray, extra: list | None = None):
        self.ids, self.labels, self.v = np.array(ids, dtype=np.int64), np.array(labels, dtype=np.int64), _matrix(vectors)
        floats = self.v.astype(float)
        self.length = np.sqrt((floats * floats).sum(axis=1))
        width = min(self.v.shape[1], axes.shape[1])
        cosine = floats[:, :width] @ axes[:, :width].T / np.where(self.length > 0, self.length, 1)[:, None]
        self.angle = np.arccos(np.clip(cosine, -1, 1))
        self.extra = extra

    def part(self, which) -> Vectors:
        out = object.__new__(Vectors)
        out.ids, out.labels, out.v, out.length, out.angle, out.extra = self.ids[which], self.labels[which], self.v[which], self.length[which], self.angle[which], None
        return out


def bounds(a: Vectors, b: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each pair."""
    apart = np.zeros((len(a.ids), len(b.ids)))
    around = np.full_like(apart, np.pi)
    for x, y in zip(a.angle.T, b.angle.T, strict=True):
        np.maximum(apart, np.abs(x[:, None] - y[None, :]), out=apart)
        both = x[:, None] + y[None, :]
        np.minimum(around, np.minimum(both, 2 * np.pi - both), out=around)
    size = a.length[:, None] * b.length[None, :]
    slack = SCORE_SLACK * size + 1
    high = np.cos(np.clip(apart - ANGLE_SLACK, 0, np.pi)) * size + slack
    low = np.cos(np.clip(around + ANGLE_SLACK, 0, np.pi)) * size - slack
    return low, high


def scores(a: Vectors, b: Vectors) -> np.ndarray:
    """Inner products as integers: by doubles where all sums are exact in them."""
    width = min(a.v.shape[1], b.v.shape[1])
    x, y = a.v[:, :width], b.v[:, :width]
    if a.length.max(initial=0) * b.length.max(initial=0) < EXACT:
        return (x.astype(float) @ y.T.astype(float)).astype(np.int64)
    return x @ y.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: high scores, then small ids."""
    return np.lexsort((ids, -score))[:k]


class _Search:
    """The best rows of a group for a block of anchors, one list for each anchor and wish."""

    def __init__(self, anchors: Vectors, wishes: int, k: int):
        self.anchors, self.k = anchors, k
        self.score = [[np.empty(0, dtype=np.int64)] * wishes for _ in anchors.ids]
        self.ids = [[np.empty(0, dtype=np.int64)] * wishes for _ in anchors.ids]
        self.floor = np.full((len(anchors.ids), wishes), NONE)

    def add(self, i: int, wish: int, score: np.ndarray, ids: np.ndarray) -> None:
        s, n = np.concatenate([self.score[i][wish], score]), np.concatenate([self.ids[i][wish], ids])
        best = _best(s, n, self.k)
        self.score[i][wish], self.ids[i][wish] = s[best], n[best]
        if len(best) == self.k:
            self.floor[i, wish] = s[best[-1]]

    def meet(self, rows: Vectors, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """``low``, ``high``: wanted scores of each anchor and wish, as integers."""
        wanted = np.maximum(low, self.floor).astype(float)
        least, most = bounds(self.anchors, rows)
        open_ = np.zeros(allowed.shape, dtype=bool)
        for wish in range(low.shape[1]):
            # Integers beyond 2^53 round by less than the slack of the bounds.
            open_ |= (most >= wanted[:, wish, None]) & (least <= high[:, wish, None].astype(float))
        open_ &= allowed
        at, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(at):
            return
        score, ids = scores(self.anchors.part(at), rows.part(cols)), rows.ids[cols]
        open_ = open_[np.ix_(at, cols)]
        for row, i in enumerate(at):
            for wish in range(low.shape[1]):
                floor = max(low[i, wish], self.floor[i, wish])
                fit = np.flatnonzero(open_[row] & (score[row] >= floor) & (score[row] <= high[i, wish]))
                if len(fit):
                    self.add(i, wish, score[row][fit], ids[fit])

    def found(self) -> Iterator[tuple[int, int, int, int]]:
        for i, anchor in enumerate(self.anchors.ids):
            for wish, (s, n) in enumerate(zip(self.score[i], self.ids[i], strict=True)):
                yield from ((int(anchor), wish, int(a), int(b)) for a, b in zip(n, s, strict=True))


def _windows(positive_scores: list) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of the negatives of each positive; the wish of a missing one is empty."""
    low, high = np.ones((len(positive_scores), POSITIVES), dtype=np.int64), np.zeros((len(positive_scores), POSITIVES), dtype=np.int64)
    for i, own in enumerate(positive_scores):
        for j, p in enumerate(own):
            low[i, j], high[i, j] = -(-LOW * p // 100), HIGH * p // 100
    return low, high


def _search(axes: np.ndarray):
    """Arrow batches of (g, kind, vec_id, label, v, positives), rows of a group before its anchors, to the best rows of each group."""
    schema = pa.schema([("anchor_id", pa.int64()), ("wish", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def result(found: Iterator[tuple]) -> pa.RecordBatch:
        rows = list(found)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)

    def searched(group: list[Vectors], block: list) -> pa.RecordBatch:
        ids, labels, vectors, positives = zip(*block, strict=True)
        anchors = Vectors(ids, labels, vectors, axes)
        first = positives[0] is None
        search = _Search(anchors, 1 if first else POSITIVES, POSITIVES if first else NEGATIVES)
        if first:
            low, high = np.full((len(ids), 1), NONE), np.full((len(ids), 1), np.iinfo(np.int64).max)
        else:
            low, high = _windows(positives)
        for rows in group:
            alike = anchors.labels[:, None] == rows.labels[None, :]
            allowed = alike & (anchors.ids[:, None] != rows.ids[None, :]) if first else ~alike
            if allowed.any():
                search.meet(rows, allowed, low, high)
        return result(search.found())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, group, block = None, [], [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for g, kind, *row in zip(*columns, strict=True):
                if g != current:
                    if block:
                        yield searched(group, block)
                    current, held, group, block = g, [], [], []
                if kind == 0:
                    held.append(row)
                    continue
                if held:
                    group = [Vectors(*list(zip(*held[i : i + SLICE], strict=True))[:3], axes) for i in range(0, len(held), SLICE)]
                    held = []
                block.append(row)
                if len(block) == BLOCK:
                    yield searched(group, block)
                    block = []
        if block:
            yield searched(group, block)

    return run


def _met(rows: DataFrame, anchors: DataFrame, groups: int, axes: np.ndarray) -> DataFrame:
    """anchor_id, wish, vec_id, score: the best of each group of rows for every anchor."""
    nothing = F.lit(None).cast("array<bigint>")
    own = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "vec_id", "label", "v", nothing.alias("positives"))
    visiting = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "vec_id", "label", "v", "positives")
    dealt = own.unionByName(visiting).repartition("g").sortWithinPartitions("g", "kind", "label", "vec_id")
    return dealt.mapInArrow(_search(axes), "anchor_id long, wish int, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "wish").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, groups: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows(vec_id, label, v).

    An anchor's positives are its POSITIVES best other rows of its label; each one's negatives
    the NEGATIVES best rows of other labels that score LOW to HIGH percent of it.
    """
    with scratch(rows.sparkSession):
        kept = stored(rows.select("vec_id", "label", "v"), "vectors")
        if groups is None:
            n = kept.count()
            groups = max(1, -(-n // GROUP), min(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // SLICE)))
        axes = directions(kept)
        anchors = kept.where(is_anchor)
        positives = stored(_ranked(_met(kept, anchors.withColumn("positives", F.lit(None).cast("array<bigint>")), groups, axes), POSITIVES), "positives")
        lists = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("own"))
        asked = lists.select(F.col("anchor_id").alias("vec_id"), F.transform("own", lambda p: p["score"]).alias("positives"))
        negatives = _ranked(_met(kept, anchors.join(asked, "vec_id"), groups, axes), NEGATIVES)
        pairs = positives.select("anchor_id", (F.col("rank") - 1).alias("wish"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = pairs.join(negatives.select("anchor_id", "wish", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "wish"])
        return stored(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives", result=True)


def mined(embeddings: DataFrame) -> DataFrame:
    """``hard_negatives`` of the embeddings table: anchors are rows with ids divisible by 50."""
    return hard_negatives(usable(embeddings, every_seventh_moved()), F.col("vec_id") % 50 == 0)
