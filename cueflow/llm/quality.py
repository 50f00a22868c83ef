"""Quality rules with robust multivariate outliers.

Every text gets plain statistics (words, symbols, repeated lines, repeated word windows).
Two fixed rules reject the obviously broken; of the rest, each language and source gets a
minimum-covariance-determinant estimate of the transformed statistics, and vectors whose
Mahalanobis distance is too large are rejected.

The estimate is made by Spark over all rows. Each cell begins from several starts: medians
and quartile ranges of binned values, two moments of rows pulled towards the medians (to a
sphere, by tanh), and RANDOM_STARTS times DRAWN rows that hashes of their vectors choose.
A concentration step is one aggregation: per cell and bin of the distance, the count and the
sums of x and xx'; cumulative sums over the bins, the last one in part, give mean and
covariance of the nearest half of the rows, so neither a hot cell's rows nor their order ever
meet in one task. After two steps the two starts of the smallest determinant go on until
their determinant stands still, and the smaller one is the estimate (as with any such search,
the smallest found: a few rows without structure may have a smaller half). It is then made
consistent for normal rows and taken once more over all rows within the 0.975 quantile.

Determinants are of the covariance plus FLOOR squared on the diagonal (counts that are mostly
zero have no variance of their own), as in the regularised form of the method.

Cells are a language and source, a language, and all rows; every row is in three. An
estimate of n rows is pooled with that of the wider cell as with PRIOR_ROWS rows of it, so a
small source is judged by its language, a small language by all, and nothing jumps at a size.

Defined results: null or blank text has zero counts and fails the base rules; null language
or source is a value of its own; repeated rows are judged alike; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueflow.llm import wordhash
from cueflow.llm.shared import scratch, stored

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = 5
#: Least standard deviation of each transformed statistic that an estimate may claim; of the logarithms of counts, a doubling.
FLOOR = (0.5, 0.35, math.log(2), math.log(2), math.log(2))
#: Starts by random rows and rows of each (few, so that some start is free of outliers; FLOOR makes their covariance regular).
RANDOM_STARTS, DRAWN = 10, 3
#: Starts that go on after WARM_STEPS steps, least fall of the log determinant that a further step is for.
GO_ON, WARM_STEPS, TOLERANCE = 2, 2, 1e-3
#: Rows of the wider cell that an estimate is pooled with.
PRIOR_ROWS = 40
#: Chi-square with 5 degrees of freedom: the quantiles 0.975 and 0.999, and what makes the covariance within its median and its 0.975 quantile that of all rows.
WITHIN, CUTOFF, HALF_FACTOR, WITHIN_FACTOR = 12.8325, 20.5150, 1.91221, 1.05553
#: Bins of the distance in a factor of e.
BINS = 16
PRIOR_WORDS, PRIOR_LENGTH = 20, 5.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five statistics of each row of a chunk."""
    rows = len(offsets) - 1
    starts, ends, first = wordhash.cut_words(data, offsets)
    solid = np.zeros(len(data) + 1, np.int32)
    np.add.at(solid, starts, 1)
    np.add.at(solid, ends, -1)
    in_word = np.cumsum(solid)[:-1].astype(bool)
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    letters, symbols = upto(in_word & ((data & 0xC0) != 0x80)), upto(_SYMBOL[data])

    # Lines: from a row's start or behind a newline, to a newline or the row's end.
    breaks = np.flatnonzero(data == 10)
    row_of = np.searchsorted(offsets, breaks, "right") - 1
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    line_row = np.concatenate([np.arange(rows), row_of])
    order = np.lexsort((line_start, line_row))
    line_start, line_row = line_start[order], line_row[order]
    line_end = np.empty_like(line_start)
    line_end[:-1] = line_start[1:] - 1
    is_last = np.append(line_row[1:] != line_row[:-1], True) if len(line_row) else np.zeros(0, bool)
    line_end[is_last] = offsets[1:][line_row[is_last]]
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    salt = wordhash.mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    lines = wordhash.span_hashes(data, line_start, line_end) ^ salt[line_row]
    kept_lines = np.unique(lines, return_index=True)[1]
    n_dup = np.bincount(line_row, minlength=rows) - np.bincount(line_row[kept_lines], minlength=rows)

    words = wordhash.span_hashes(data, starts, ends)
    n_words = np.diff(first)
    word_row = np.repeat(np.arange(rows), n_words)
    windows = wordhash.shingle_hashes(words, 5)
    at = np.flatnonzero(word_row[: len(windows)] == word_row[4:]) if len(windows) else np.zeros(0, int)
    _, inverse, counts = np.unique(windows[at] ^ salt[word_row[at]], return_inverse=True, return_counts=True)
    at = at[counts[inverse] > 1]
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, np.minimum(at + 5, len(words)), -1)
    covered = upto(np.cumsum(cover)[: len(words)] > 0)
    return {
        "n_words": n_words,
        "word_chars": letters[offsets[1:]] - letters[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": n_dup,
        "n_repeat_words": covered[first[1:]] - covered[first[:-1]],
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in wordhash.chunks(batches):
        stats = text_statistics(data, offsets)
        kept = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(stats[s].astype(np.int64)) for s in STATS)], names=[*kept.schema.names, *STATS])


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the statistics of every row."""
    source = documents.select("doc_id", "lang", "source", "text")
    return source.mapInArrow(_measure, "doc_id long, lang string, source string, " + ", ".join(f"{s} long" for s in STATS))


def transformed() -> list[Column]:
    """The vector that the estimates are made of."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(words.cast("double")),
        # Mean word length, drawn towards PRIOR_LENGTH as by PRIOR_WORDS more words: short texts vary more.
        (F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / (F.col("n_words") + PRIOR_WORDS),
        # A share of symbols in as many more characters: one symbol in a short text is none too many.
        F.log1p(F.lit(1000.0) * F.col("n_symbols") / (F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH)),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log1p(F.lit(100.0) * F.col("n_repeat_words") / words),
    ]


X = [f"x{i}" for i in range(DIM)]
SUMS = ["n", *(f"s{i}" for i in range(DIM)), *(f"s{i}{j}" for i in range(DIM) for j in range(i, DIM))]


def _distance() -> Column:
    """Squared Mahalanobis distance to the cell's ``mean`` under its ``inverse``."""
    gap = [F.col(x) - F.col("mean")[i] for i, x in enumerate(X)]
    return sum((gap[i] * gap[j] * F.col("inverse")[i * DIM + j] * (1 if i == j else 2) for i in range(DIM) for j in range(i, DIM)), F.lit(0.0))


def _bin(distance: Column) -> Column:
    return F.floor(F.log(F.greatest(distance, F.lit(1e-6))) * BINS).cast("int")


def _sums(x: list[Column]) -> list[Column]:
    """Count and sums of x and xx'."""
    products = [F.lit(1.0), *x, *(x[i] * x[j] for i in range(DIM) for j in range(i, DIM))]
    return [F.sum(p).alias(s) for p, s in zip(products, SUMS, strict=True)]


def moments(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from sums."""
    mean = np.array([row[f"s{i}"] for i in range(DIM)]) / row["n"]
    cov = np.zeros((DIM, DIM))
    for i in range(DIM):
        for j in range(i, DIM):
            cov[i, j] = cov[j, i] = row[f"s{i}{j}"] / row["n"] - mean[i] * mean[j]
    return mean, cov


ESTIMATE = "cell string, start int, n double, mean array<double>, cov array<double>, inverse array<double>, logdet double"


def _estimates(factor: float = 1.0):
    """Mean and covariance times ``factor``, its inverse and log determinant from sums, a row an estimate."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                mean, cov = moments(row)
                wide = cov * factor + np.diag(np.square(FLOOR))
                out.append((row["cell"], row["start"], row["n"], mean, (cov * factor).ravel(), np.linalg.inv(wide).ravel(), np.linalg.slogdet(wide)[1]))
            yield pd.DataFrame(out, columns=["cell", "start", "n", "mean", "cov", "inverse", "logdet"])

    return run


def _medians(rows: DataFrame) -> DataFrame:
    """Coordinate-wise medians and squared scales by quartiles, by exact counts of binned values."""
    bins = rows.select("cell", F.posexplode(F.array(*[F.floor(F.col(x) * 32).cast("long") for x in X])).alias("dim", "bin")).groupBy("cell", "dim", "bin").count()
    running = Window.partitionBy("cell", "dim").orderBy("bin")
    upto = bins.withColumn("upto", F.sum("count").over(running)).withColumn("all", F.sum("count").over(Window.partitionBy("cell", "dim")))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) / 32))
    quart = upto.groupBy("cell", "dim").agg(quartile(0.25).alias("low"), quartile(0.5).alias("mid"), quartile(0.75).alias("high"))
    floor = F.element_at(F.array(*[F.lit(x) for x in FLOOR]), F.col("dim") + 1)
    scale = F.pow((F.col("high") - F.col("low")) / 1.349, F.lit(2)) + floor * floor
    by_dim = quart.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("dim", F.struct("mid", scale.alias("scale"))))).alias("m"))
    return by_dim.select("cell", F.array(*[F.col("m")[i]["mid"] for i in range(DIM)]).alias("mid"), F.array(*[F.col("m")[i]["scale"] for i in range(DIM)]).alias("scale"))


def _starts(rows: DataFrame) -> DataFrame:
    """(cell, start, mean, inverse): where the concentration steps of each cell begin."""
    medians = stored(_medians(rows), "mcd-medians")
    diagonal = F.array(*[1 / F.col("scale")[i] if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM)])
    plain = medians.select("cell", F.lit(0).alias("start"), F.col("mid").alias("mean"), diagonal.alias("inverse"))

    z = [(F.col(x) - F.col("mid")[i]) / F.sqrt(F.col("scale")[i]) for i, x in enumerate(X)]
    length = F.greatest(F.sqrt(sum((c * c for c in z), F.lit(0.0))), F.lit(1e-9))
    back = lambda c, i: F.col("mid")[i] + c * F.sqrt(F.col("scale")[i])
    pulled = F.array(
        F.struct(F.lit(1).alias("start"), *[back(z[i] / length * math.sqrt(DIM), i).alias(x) for i, x in enumerate(X)]),
        F.struct(F.lit(2).alias("start"), *[back(F.tanh(z[i]), i).alias(x) for i, x in enumerate(X)]),
    )
    pulled = rows.join(medians, "cell").select("cell", F.inline(pulled)).groupBy("cell", "start").agg(*_sums([F.col(x) for x in X]))

    # The rows whose vectors have the smallest hashes: repeated rows count once, order doesn't matter.
    draws = [(3 + k // DRAWN, k) for k in range(RANDOM_STARTS * DRAWN)]
    smallest = rows.groupBy("cell").agg(*[F.min(F.struct(F.xxhash64(*X, F.lit(k)).alias("h"), *X)).alias(f"d{k}") for _, k in draws])
    drawn = smallest.select("cell", F.inline(F.array(*[F.struct(F.lit(start).alias("start"), *[F.col(f"d{k}")[x].alias(x) for x in X]) for start, k in draws])))
    drawn = drawn.groupBy("cell", "start").agg(*_sums([F.col(x) for x in X]))

    moved = pulled.unionByName(drawn).mapInPandas(_estimates(), ESTIMATE).select("cell", "start", "mean", "inverse")
    return plain.unionByName(moved)


def _nearest_half(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimates over the nearest half of their cell's rows: one concentration step."""
    binned = rows.join(estimates.select("cell", "start", "mean", "inverse"), "cell").groupBy("cell", "start", _bin(_distance()).alias("bin")).agg(*_sums([F.col(x) for x in X]))
    key = Window.partitionBy("cell", "start")
    before = F.coalesce(F.sum("n").over(key.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    everything = F.sum("n").over(key)
    half = F.ceil(everything / 2)
    near = binned.withColumn("part", F.least((half - before) / F.col("n"), F.lit(1.0))).where("part > 0")
    return near.groupBy("cell", "start").agg(*[F.sum(F.col(s) * F.col("part")).alias(s) for s in SUMS]).mapInPandas(_estimates(), ESTIMATE)


def minimum_determinants(rows: DataFrame) -> DataFrame:
    """(cell, start, n, mean, cov, inverse, logdet): the half of each cell's rows(cell, x0..x4) with the smallest determinant found."""
    going = stored(_starts(rows), "mcd-starts")
    for step in range(WARM_STEPS):
        going = stored(_nearest_half(rows, going), f"mcd-{step}")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("logdet", "start"))
    best = going.withColumn("rank", rank).where(F.col("rank") <= GO_ON).drop("rank")
    going, settled = stored(best, "mcd-best"), []
    while True:
        before = going.select("cell", "start", F.struct("n", "mean", "cov", "inverse", "logdet").alias("was"))
        both = _nearest_half(rows, going).join(before, ["cell", "start"]).withColumn("fell", F.col("logdet") < F.col("was.logdet") - TOLERANCE)
        both = stored(both, "mcd-step")
        settled.append(both.where("not fell").select("cell", "start", "was.*"))
        going = both.where("fell").drop("was", "fell")
        if going.isEmpty():
            break
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    first = F.row_number().over(Window.partitionBy("cell").orderBy("logdet", "start"))
    return stored(found.withColumn("rank", first).where("rank = 1").drop("rank"), "mcd")


def robust_cells(rows: DataFrame) -> DataFrame:
    """The reweighted estimate (cell, n, mean, cov) of each cell of rows(cell, x0..x4)."""
    halves = minimum_determinants(rows)
    sums = halves.select("cell", "start", "n", *[F.col("mean")[i].alias(f"s{i}") for i in range(DIM)], "cov").select(
        "cell", "start", F.lit(1.0).alias("n"), *[f"s{i}" for i in range(DIM)],
        *[(F.col("cov")[i * DIM + j] + F.col(f"s{i}") * F.col(f"s{j}")).alias(f"s{i}{j}") for i in range(DIM) for j in range(i, DIM)],
    )
    wide = stored(sums.mapInPandas(_estimates(HALF_FACTOR), ESTIMATE).select("cell", "start", "mean", "inverse"), "mcd-wide")
    within = rows.join(wide, "cell").where(_distance() <= WITHIN).groupBy("cell", "start").agg(*_sums([F.col(x) for x in X]))
    return stored(within.mapInPandas(_estimates(WITHIN_FACTOR), ESTIMATE).select("cell", "n", "mean", "cov"), "mcd-within")


LEVELS = ("own", "language", "all")


def _cell_keys(lang: str, source: str) -> list[Column]:
    """The cells of a row: its language and source, its language, all."""
    return [
        F.to_json(F.struct(F.lit(2).alias("level"), F.col(lang).alias("lang"), F.col(source).alias("source"))),
        F.to_json(F.struct(F.lit(1).alias("level"), F.col(lang).alias("lang"))),
        F.lit('{"level":0}'),
    ]


def _pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and inverse covariance of each language and source, pooled from the widest cell inwards."""
    for frame in frames:
        means, inverses = [], []
        for row in frame.to_dict("records"):
            mean, cov = np.asarray(row["all"]["mean"]), np.asarray(row["all"]["cov"]).reshape(DIM, DIM)
            for level in ("language", "own"):
                own = row[level]
                part = own["n"] / (own["n"] + PRIOR_ROWS)
                # Without what lies between the means: it would let a few rows far from all others pass as a source.
                cov = part * np.asarray(own["cov"]).reshape(DIM, DIM) + (1 - part) * cov
                mean = part * np.asarray(own["mean"]) + (1 - part) * mean
            means.append(mean)
            inverses.append(np.linalg.inv(cov + np.diag(np.square(FLOOR))).ravel())
        yield pd.DataFrame({"l": frame["l"], "s": frame["s"], "mean": means, "inverse": inverses})


def _source_estimates(rows: DataFrame) -> DataFrame:
    """(l, s, mean, inverse) of each language and source of rows with statistics and base_failed."""
    vectors = rows.where("not base_failed").select("lang", "source", *[x.alias(n) for x, n in zip(transformed(), X, strict=True)])
    vectors = stored(vectors.select(F.explode(F.array(*_cell_keys("lang", "source"))).alias("cell"), *X), "vectors")
    cells = robust_cells(vectors)
    keyed = rows.where("not base_failed").groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.lit(1).alias("one")).drop("one")
    keyed = keyed.withColumns(dict(zip([f"k_{x}" for x in LEVELS], _cell_keys("l", "s"), strict=True)))
    for level in LEVELS:
        keyed = keyed.join(cells.select(F.col("cell").alias(f"k_{level}"), F.struct("n", "mean", "cov").alias(level)), f"k_{level}")
    return keyed.select("l", "s", *LEVELS).mapInPandas(_pooled, "l string, s string, mean array<double>, inverse array<double>")


def _same_cell() -> Column:
    return F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def _estimates_by_source(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored statistics of all rows, and (l, s, mean, inverse) of each language and source."""
    with scratch(documents.sparkSession):
        rows = stored(measured(documents), "statistics", result=True)
        return rows, stored(_source_estimates(rows.withColumn("base_failed", F.expr(BASE_FAILED))), "estimates", result=True)


def _verdict(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with statistics, and base_failed, distance and kept."""
    vectors = rows.withColumn("base_failed", F.expr(BASE_FAILED)).withColumns({n: x for x, n in zip(transformed(), X, strict=True)})
    scored = vectors.join(estimates, _same_cell(), "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)).drop("l", "s", "mean", "inverse", *X)


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed, distance and kept of every row of ``documents``."""
    rows, estimates = _estimates_by_source(documents)
    return _verdict(rows, estimates).select("doc_id", "lang", "source", *STATS, "base_failed", "distance", "kept")


def quality_filter(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns.

    Statistics are taken again beside each text, which costs less than a shuffle of the texts.
    """
    _, estimates = _estimates_by_source(documents)
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    beside = documents.select(row, "lang", "source", "text")
    schema = T.StructType([f for f in beside.schema if f.name != "text"] + [T.StructField(s, T.LongType()) for s in STATS])
    return _verdict(beside.mapInArrow(_measure, schema), estimates).where("kept").select("row.*")
