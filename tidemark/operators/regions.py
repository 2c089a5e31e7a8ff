"""Stacked tables in one file: runs of rows of the same width."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import ROW

LEAST_ROWS, FEWEST, MOST = 10, 2, 5
BLOCK_BITS = 16


def stacked_regions(rows: DataFrame, width: str = "width") -> DataFrame:
    """first_row, rows, width of the runs of more than LEAST_ROWS rows. rows: _row (gapless) and width.

    Runs are found within blocks of indexes, so no task has the whole table; runs that meet at a border are joined again.
    """
    block = F.shiftright(ROW, BLOCK_BITS)
    w = Window.partitionBy("_block").orderBy(ROW)
    marked = rows.select(ROW, width, block.alias("_block")).withColumn("_new", (~F.col(width).eqNullSafe(F.lag(width).over(w))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("_block", "_run").agg(F.min(ROW).alias("first_row"), F.count("*").alias("rows"), F.first(width).alias(width))
    return joined_runs(runs, [width]).filter(F.col("rows") > LEAST_ROWS)


def joined_runs(runs: DataFrame, same: list[str]) -> DataFrame:
    """Runs of blocks, joined where one ends and the next starts: only those at a border take part."""
    at_border = (F.col("first_row") % (1 << BLOCK_BITS) == 0) | ((F.col("first_row") + F.col("rows")) % (1 << BLOCK_BITS) == 0)
    inner, border = runs.filter(~at_border), runs.filter(at_border)
    w = Window.partitionBy(F.lit(0)).orderBy("first_row")  # two rows a block at most
    follows = (F.lag(F.col("first_row") + F.col("rows")).over(w) == F.col("first_row"))
    for c in same:
        follows &= F.lag(c).over(w).eqNullSafe(F.col(c))
    grouped = border.withColumn("_g", F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("_g").agg(F.min("first_row").alias("first_row"), F.sum("rows").alias("rows"), *[F.first(c).alias(c) for c in same])
    return inner.select("first_row", "rows", *same).unionByName(merged.select("first_row", "rows", *same))
