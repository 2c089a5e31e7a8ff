"""Cell edits that only lose precision: suppressed, rounded, re-typed, or the same number written otherwise. edits: column, from, to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cells import SENTINELS, is_suppressed, numbers_equal, rounding_modulus


def suppressed(edits: DataFrame, sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """column, cells: edits of a present value to a sentinel."""
    return edits.filter(is_suppressed(F.col("from"), F.col("to"), sentinels)).groupBy("column").agg(F.count("*").alias("cells"))


def rounded(edits: DataFrame) -> DataFrame:
    """column, modulus, cells: edits that round to a power of ten, two or more of each."""
    found = edits.withColumn("modulus", rounding_modulus(F.col("from"), F.col("to"))).filter("modulus IS NOT NULL")
    return found.groupBy("column", "modulus").agg(F.count("*").alias("cells")).filter("cells >= 2")


def without_noops(edits: DataFrame) -> DataFrame:
    """Edits other than those between two texts of one number."""
    return edits.filter(~numbers_equal(F.col("from"), F.col("to")))


def type_only(edits: DataFrame) -> DataFrame:
    """edits: column, from and to as structs (t: type, v: text). column, from_type, to_type, cells of the columns all of whose edits
    change the type alone, and all in the same way. Only numbers and their texts can agree across types."""
    pair = F.struct(F.col("from.t").alias("from_type"), F.col("to.t").alias("to_type"))
    number_and_text = F.array_sort(F.array("from.t", "to.t")) == F.array(F.lit("number"), F.lit("string"))
    same = (F.col("from.v") == F.col("to.v")) & (F.col("from.t") != F.col("to.t")) & number_and_text
    grouped = edits.groupBy("column").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("same"), F.count_distinct(pair).alias("pairs"), F.min(pair).alias("p"), F.count("*").alias("cells"))
    return grouped.filter("same AND pairs = 1").select("column", "p.from_type", "p.to_type", "cells")
