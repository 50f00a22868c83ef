"""Where jobs put what they write for themselves."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder in the one that driver and executors share, ``spark.checkpoint.dir``.

    Only a local master may do without: there a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cueflow-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def emptied_mounted_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that ``path`` names for driver and executors alike, made anew; None in a store that only Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file":
        return None
    files.delete(where, True)
    files.mkdirs(where)
    return files.makeQualified(where).toUri().getPath()


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by as many tasks as shuffles have; by default each folder, up to 10,000, is a task."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        yield
    finally:
        spark.conf.set(name, before)
