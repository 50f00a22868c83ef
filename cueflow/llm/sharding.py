"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows fall into parts by a hash of their identity.  The matrix of part-to-shard counts is
drawn as a uniform shuffle of all rows would give it, with shard sizes at most one apart
(law ``rows``).  Each part permutes its rows and cuts them along its counts; the rows go to
their shards, and every shard permutes what it got.  The second permutation works in ranges
of the random key, so that a shard needs no task of its own.

Reruns agree: parts, draws and permutations depend on the rows and the seed only.

Defined results: null text counts as no bytes and has the CRC of nothing; repeated rows are
separate rows; null doc_ids are values like others; an empty table gives an empty result;
further columns pass through (``shard``, ``slot`` are the operator's own and replace any).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueflow.llm.draws import communication_matrix
from cueflow.llm.shared import scratch, stored

#: Rows that a part or a range of a shard holds on average, least and most parts (the counts of
#: the parts go through the driver: at most MOST_PARTS numbers).
PART_ROWS, LEAST_PARTS, MOST_PARTS = 20_000, 64, 65_536
RANGE_ROWS, MOST_RANGES = 2_000, 65_536


def _unit(key: Column, salt: int, ranges: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(ranges)).cast("int")


def placements(keys: DataFrame, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """key, nth, shard and slot for keys(key), a stored table with a row for each row to place.

    Rows of one key are numbered (nth, from 0): which of them has which number makes no
    difference.  Shard sizes differ by one at most, slots are gapless.
    """
    spark = keys.sparkSession
    # Copies of a key are counted first and dealt by their number: one that repeats without end is no single part.
    copies = keys.groupBy("key").agg(F.count("*").alias("copies"))
    keyed = copies.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("nth")).withColumn("at", F.xxhash64("key", "nth", F.lit(seed)))
    total = keys.count()
    parts = min(MOST_PARTS, max(LEAST_PARTS, -(-total // PART_ROWS)))
    keyed = keyed.withColumn("part", _unit(F.col("at"), 1, parts))
    counts = dict(keyed.groupBy("part").count().collect())
    per_part = [counts.get(p, 0) for p in range(parts)]
    shards = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix(per_part, shards, seed).cumsum(axis=1)
    cuts = stored(spark.createDataFrame([(p, [int(x) for x in matrix[p]]) for p in range(parts)], "part int, cuts array<long>"), "cuts")

    # Permute each part, then cut it along its counts.
    local = Window.partitionBy("part").orderBy(F.xxhash64("at", F.lit(2)), "at")
    placed = keyed.withColumn("rank", F.row_number().over(local) - 1).join(cuts, "part")
    placed = placed.select("key", "nth", "at", F.expr("size(filter(cuts, c -> c <= rank))").cast("int").alias("shard"))

    # Permute each shard, range by range of a new random key.
    ranges = min(MOST_RANGES, max(1, -(-total // n_shards // RANGE_ROWS)))
    placed = placed.withColumn("range", _unit(F.col("at"), 3, ranges))
    sizes = placed.groupBy("shard", "range").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = stored(sizes.select("shard", "range", F.coalesce(before, F.lit(0)).alias("before")), "offsets")
    again = Window.partitionBy("shard", "range").orderBy(F.xxhash64("at", F.lit(4)), "at")
    slotted = placed.withColumn("nr", F.row_number().over(again) - 1).join(offsets, ["shard", "range"])
    return slotted.select("key", "nth", "shard", (F.col("before") + F.col("nr")).cast("long").alias("slot"))


def shuffled_into_shards(rows: DataFrame, identity: list[Column], n_shards: int = 24, seed: int = 17) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: keys are permuted first, so rows move once."""
    carried = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.xxhash64(*identity, F.lit(seed)).alias("key"))
    with scratch(rows.sparkSession):
        keys = stored(carried.select("key"), "shard-keys")
        placed = stored(placements(keys, n_shards, seed), "placements", result=True)
        repeated = not placed.where("nth > 0").isEmpty()
    if repeated:
        numbered = carried.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("key")).cast("long") - 1)
    else:
        numbered = carried.withColumn("nth", F.lit(0).cast("long"))
    columns = [F.col("row")[c].alias(c) for c in rows.columns if c not in ("shard", "slot")]
    return numbered.join(placed, ["key", "nth"]).select(*columns, "shard", "slot")


def document_shards(documents: DataFrame, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``documents``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("text").alias("_text"))
    rows = stored(rows, "sharding")
    placed = shuffled_into_shards(rows, [F.col("doc_id"), F.col("_text"), F.col("size")], n_shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(documents: DataFrame, n_shards: int = 24, seed: int = 17) -> DataFrame:
    """``documents`` with shard and slot."""
    return shuffled_into_shards(documents, [F.col("doc_id"), F.xxhash64("text"), F.length("text")], n_shards, seed)
