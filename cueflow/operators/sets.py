"""Unions and differences of tracks and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def all_tracks(manual: DataFrame, automatic: DataFrame) -> DataFrame:
    """Manual and automatic tracks, tagged ``is_auto``."""
    return manual.withColumn("is_auto", F.lit(False)).unionByName(automatic.withColumn("is_auto", F.lit(True)))


def with_merged_row(results: DataFrame, merged: DataFrame) -> DataFrame:
    """Results and the rows of the merged outputs."""
    return results.unionByName(merged, allowMissingColumns=True)


def merge_only(results: DataFrame, merged: DataFrame) -> DataFrame:
    """Results without the clips that a successful merge took in."""
    won = merged.where("status = 'Done'").select("video_id", F.lit(True).alias("_won")).distinct()
    taken = (F.col("status") == "Done") & F.col("output_path").isNotNull() & F.col("_won")
    return results.join(won, "video_id", "left").where(~F.coalesce(taken, F.lit(False))).drop("_won")


def distinct_consecutive(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    window = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_before", F.lag(value).over(window)).withColumn("_first", F.row_number().over(window) == 1)
    return marked.where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_before", "_first")
