"""Helpers that several operators share: stored intermediate tables and components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only on a local master a temporary folder takes its place where it is unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="cueflow-"))
        folder = context.getCheckpointDir()
    return folder


#: Paths of stored tables, a list for each open ``scratch`` of this thread of control.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratches", default=())


def stored(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, cutting its lineage.

    Inside ``scratch`` the table goes when the block ends; a ``result`` belongs to the block
    around it, or stays where there is none.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cueflow-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_open.get()) > result:
        _open.get()[-1 - result].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables stored inside, but for results, when the block ends.

    What the block returns must read results only.
    """
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        for path in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of tables that are stored go now.

    Spark deletes them once the driver's collector has found their queries unused, which on a
    driver with much memory is long after the tables were written.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Slots of ``maybe_among``, a bit each.
SLOTS = 1 << 25


def maybe_among(rows: DataFrame, column: str, chosen: DataFrame) -> DataFrame:
    """The ``rows`` whose long ``column`` is in chosen(column), and a few others.

    A bit for each slot that is chosen, 4 MB of bits at most, is broadcast, so that rows that
    a join drops anyway stay out of its shuffle.
    """
    slot = F.pmod(F.xxhash64(column), F.lit(SLOTS))
    words = chosen.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    dealt = rows.withColumn("slot", slot).withColumn("word", F.shiftright("slot", 6))
    found = dealt.join(F.broadcast(words), "word").where("(shiftright(bits, cast(slot % 64 as int)) & 1) = 1")
    return found.select(*rows.columns)


def words_pattern() -> str:
    return r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(words_pattern())), F.lit(0)).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, contracts the trees by pointer
    jumping and keeps the edges between different trees.  At least half of the nodes of an
    unfinished component hook in each round, so the rounds grow with the logarithm of its
    size.  Every round is written to the shared folder; nothing goes through the driver but
    the question whether edges remain.
    """
    with scratch(edges.sparkSession):
        return stored(_components(edges.select("a", "b").where("a <> b")), "components", result=True)


def _components(edges: DataFrame) -> DataFrame:
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")), "hooks")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = stored(parent.join(up, "p").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "jumps")
            parent = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parent.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("a").alias("root"), "p")
            labels = stored(labels.join(step, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        left, right = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = stored(
            edges.join(left, "a").join(right, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        if edges.isEmpty():
            return labels
