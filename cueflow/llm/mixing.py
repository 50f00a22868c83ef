"""Mixing sources to target weights by blocks.

Each source's words, document after document in pseudorandom order, are packed into blocks
of BLOCK words.  Every output shard draws how many of its slots each source fills: the
draws are multinomial given that the sources' totals come out at their targets (a
multivariate hypergeometric matrix).  A source's slots run through pseudorandom
permutations of its block numbers, one permutation a pass; slots and packed documents join
on (source, block).  A pass takes no block twice and targets stop at REPEAT times the
source, so no document is taken more than REPEAT times.

Offsets are prefix sums in two levels, so a source that holds a third of all rows is no
single task's work.  What passes through the driver is one row per source.

Defined results: null or blank text has size 0 and is never taken; null source is a source
of its own, after all others; repeated rows are separate documents; an empty table gives an
empty result; further columns pass through ``mixed`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueflow.llm.draws import communication_matrix, permuted
from cueflow.llm.shared import scratch, stored, word_count

WEIGHTS, SHARE, REPEAT = (3, 1, 2), 1.5, 2
BLOCK, N_SHARDS, GROUP_ROWS = 32, 24, 2_000
#: Slots that one row of the plan unfolds to.
SLOTS_AT_ONCE = 4_096


def source_targets(sizes: DataFrame) -> DataFrame:
    """sid, source, source_size, weight, target for sizes(source, source_size).

    Targets are proportional to the weights, but at most REPEAT times the source's size; the
    excess goes to the others by weight.  In the order of REPEAT * size / weight, sources
    are at their limit up to the first whose limit exceeds the level of those that remain.
    """
    # One row per source from here on.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("sid", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    limited = numbered.withColumn("weight", weight).withColumn("most", F.lit(float(REPEAT)) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(SHARE)
    spent = F.coalesce(F.sum("most").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    levelled = limited.withColumn("level", (total - spent) / left).withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "sid", "level"))).over(Window.partitionBy())["level"]
    return levelled.withColumn("open_level", level).select(
        "sid", "source", "source_size", "weight", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("open_level")).alias("target")
    )


def _slots(seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            j, size = frame["j"].to_numpy(np.int64), frame["blocks"].to_numpy(np.int64)
            key = (frame["sid"].to_numpy(np.int64) * 1_000_003 + j // size) * 7919 + seed
            yield pd.DataFrame({"sid": frame["sid"], "shard": frame["shard"], "block": permuted(j % size, size, key)})

    return run


def packed(rows: DataFrame) -> DataFrame:
    """rows(source, size, _key) with ``sid``, targets and ``at``, the offset of their first word in their source."""
    totals = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("c")), "source-sizes")
    targets = stored(source_targets(totals.select("source", "source_size")), "targets")
    n_rows = totals.agg(F.sum("c")).first()[0] or 0
    groups = max(1, -(-n_rows // GROUP_ROWS))
    known = targets.select("sid", F.col("source").alias("_s"), "source_size", "target")
    grouped = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_group", F.pmod(F.xxhash64("_key", F.lit(5)), F.lit(groups)).cast("int"))
    sums = grouped.groupBy("sid", "_group").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("sid").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    starts = stored(sums.select("sid", "_group", F.coalesce(before, F.lit(0)).alias("_start")), "group-starts")
    inside = F.sum("size").over(Window.partitionBy("sid", "_group").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1))
    return grouped.withColumn("_in", F.coalesce(inside, F.lit(0))).join(starts, ["sid", "_group"]).withColumn("at", F.col("_start") + F.col("_in")).drop("_start", "_in", "_group")


def drawn_blocks(targets: DataFrame, seed: int = 23, n_shards: int = N_SHARDS, block: int = BLOCK) -> DataFrame:
    """sid, shard, block: the block that each slot of each shard takes, for targets(sid, source_size, target)."""
    spark = targets.sparkSession
    recipe = [(r.sid, -(-r.source_size // block), min(round(r.target / block), -(-r.source_size // block) * REPEAT)) for r in targets.orderBy("sid").collect()]
    total = sum(slots for *_, slots in recipe)
    shard_slots = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(shard_slots, [slots for *_, slots in recipe], seed)
    starts = np.vstack([np.zeros((1, len(recipe)), np.int64), matrix.cumsum(axis=0)[:-1]])
    plan = [
        (sid, shard, blocks, int(starts[shard, i]), int(matrix[shard, i]))
        for i, (sid, blocks, _) in enumerate(recipe) for shard in range(n_shards) if matrix[shard, i]
    ]
    plan = spark.createDataFrame(plan, "sid int, shard int, blocks long, start long, count long")
    # As many tasks as the slots need: a plan of few rows would be merged into one.
    tasks = max(1, -(-total // (SLOTS_AT_ONCE * 16)))
    pieces = plan.withColumn("piece", F.explode(F.expr(f"sequence(0L, (count - 1) div {SLOTS_AT_ONCE})"))).repartition(tasks, "sid", "shard", "piece")
    low = F.col("start") + F.col("piece") * SLOTS_AT_ONCE
    high = F.least(F.col("start") + F.col("count"), low + SLOTS_AT_ONCE) - 1
    slots = pieces.select("sid", "shard", "blocks", F.explode(F.sequence(low, high)).alias("j"))
    return slots.mapInPandas(_slots(seed), "sid int, shard int, block long")


def taken_words(rows: DataFrame, seed: int = 23, block: int = BLOCK) -> DataFrame:
    """rows(source, size, _key, ...) with source_size, target and taken."""
    with scratch(rows.sparkSession):
        placed = stored(packed(rows), "packed")
        targets = placed.select("sid", "source_size", "target").distinct()
        slots = stored(drawn_blocks(targets, seed, block=block).groupBy("sid", "block").agg(F.count("*").alias("times")), "slots")
        pieces = placed.where("size > 0").select("sid", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
        overlap = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)
        # Within a source, the first word's offset names a document of positive size.
        taken = pieces.join(slots, ["sid", "block"]).groupBy("sid", "at").agg(F.sum(overlap * F.col("times")).alias("words"))
        got = taken.withColumn("_some", F.lit(True))
        out = placed.withColumn("_some", F.col("size") > 0).join(got, ["sid", "at", "_some"], "left").withColumn("taken", F.coalesce("words", F.lit(0)).cast("long")).drop("_some", "words", "at", "sid")
        return stored(out, "taken", result=True)


def mixture(documents: DataFrame, seed: int = 23, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``documents``."""
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_key"))
    return taken_words(stored(rows, "mixing"), seed, block).select("doc_id", "size", "source_size", "target", "taken")


def mixed(documents: DataFrame, seed: int = 23, block: int = BLOCK) -> DataFrame:
    """The mixture as documents: each row as many times as its taken words make up its size.

    The fraction beyond whole copies becomes one more copy with that probability, by a hash
    of the row; rows of which nothing is taken go.
    """
    key = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = stored(documents.select("source", word_count(F.col("text")).alias("size"), key.alias("_key")), "mixing")
    share = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
    chance = F.pmod(F.xxhash64("_key", F.lit(6)), F.lit(1 << 20)) / float(1 << 20)
    copies = taken_words(rows, seed, block).withColumn("_copies", (F.floor(share) + (chance < share - F.floor(share)).cast("int")).cast("int"))
    # Repeated rows have one key: the mean number of their copies goes to each of them.
    by_key = stored(copies.groupBy("_key").agg(F.round(F.avg("_copies")).cast("int").alias("_copies")).where("_copies > 0"), "copies")
    carried = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), key.alias("_key"))
    return carried.join(by_key, "_key").select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")
