"""Row numbers over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.store import keep

ROW = "_row"


def with_row_index(df: DataFrame, *order: Column | str, name: str = ROW) -> DataFrame:
    """Adds each row's place from 0, in the given order (which must be total) or, without one, in the order of the table.

    Rows are sorted by ranges; a range's start is the number of rows in the ranges before it, which takes one small row each. The
    sorted rows are kept with their range, so that both readings of them agree.
    """
    placed = df.orderBy(*order) if order else df
    placed = keep(placed.withColumns({"_part": F.spark_partition_id(), "_mono": F.monotonically_increasing_id()}), "sorted")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", (before - F.col("_first")).alias("_shift"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_mono") + F.col("_shift")).drop("_part", "_mono", "_shift")
