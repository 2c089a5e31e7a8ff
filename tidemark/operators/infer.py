"""Inference: keys that nobody declared, tables that don't correspond, renamed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cells import is_blank, named
from tidemark.operators.order import ROW
from tidemark.operators.rows import common_columns, keyed_pairs

KEY_OVERLAP = 0.80
CHURN_LIMIT = 0.50
KEY_ROWS = 10_000
CANDIDATES = 8
RENAME_VALUES, RENAME_SHARE = 2, 0.10


def _values(df: DataFrame, columns: list[str], side: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).withColumn("side", F.lit(side))


def key_statistics(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """For each common column: unique (no blank, no repeated value on either side), common and all distinct values, bytes of the left
    values. One shuffle of (column, value) for all columns."""
    columns = columns or common_columns(left, right)
    both = _values(left, columns, "l").unionByName(_values(right, columns, "r"))
    counted = both.groupBy("column", "value").agg(F.count_if(F.col("side") == "l").alias("l"), F.count_if(F.col("side") == "r").alias("r"))
    return counted.groupBy("column").agg(
        (~F.bool_or(is_blank(F.col("value")) | (F.col("l") > 1) | (F.col("r") > 1))).alias("is_unique"),
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("common"),
        F.count("*").alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("l") > 0, F.octet_length("value"))), F.lit(0)).alias("bytes"),
    )


def key_candidates(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, common, distinct_values, bytes, place: columns that could be the key, best first: overlap, then names like an id, then
    fewest bytes, then name."""
    found = key_statistics(left, right, columns).filter(F.col("is_unique") & (F.col("common") * 100 >= F.col("distinct_values") * int(KEY_OVERLAP * 100)))
    name = F.lower("column")
    named = F.when(name == "id", 0).when(F.endswith(name, F.lit("_id")) | F.endswith(name, F.lit(" id")), 1).otherwise(2)
    # overlap as a fraction of integers orders exactly in whole millionths
    overlap = F.floor(F.col("common") * 1_000_000 / F.col("distinct_values"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(overlap), named, "bytes", "column"))  # one row a column
    return found.withColumn("place", place).filter(F.col("place") <= CANDIDATES).select("column", "common", "distinct_values", "bytes", "place")


def infer_key(left: DataFrame, right: DataFrame, most: int | None = KEY_ROWS) -> str | None:
    """The best candidate by overlap, then fewest bytes, then name. most: rows of a side beyond which none is looked for (None: any)."""
    if most is not None and (left.limit(most + 1).count() > most or right.limit(most + 1).count() > most):
        return None
    found = key_candidates(left, right).collect()  # at most CANDIDATES rows
    best = min(found, key=lambda r: (-r["common"] / r["distinct_values"], r["bytes"], r["column"]), default=None)
    return best["column"] if best else None


def rename_scores(left: DataFrame, right: DataFrame, by: list[str], removed: list[str], added: list[str]) -> DataFrame:
    """scores_of_pairs() of rows aligned by `by`."""
    pairs = keyed_pairs(left, right, by) if by != [ROW] else left.select(ROW, F.struct(*map(named, removed)).alias("l")).join(right.select(ROW, F.struct(*map(named, added)).alias("r")), ROW)
    return scores_of_pairs(pairs, removed, added)


def scores_of_pairs(pairs: DataFrame, removed: list[str], added: list[str]) -> DataFrame:
    """removed, added, equal, rows: equal non-blank values of each removed and added column in aligned rows (l, r); only pairs with
    RENAME_VALUES equal ones that are RENAME_SHARE of the rows."""
    both = pairs.filter("l IS NOT NULL AND r IS NOT NULL")
    cells = [
        F.struct(F.lit(a).alias("removed"), F.lit(b).alias("added"), (named(a, "l").cast("string").eqNullSafe(named(b, "r").cast("string")) & ~is_blank(named(a, "l"))).alias("same"))
        for a in removed
        for b in added
    ]
    scored = both.select(F.inline(F.array(*cells))).groupBy("removed", "added").agg(F.count_if("same").alias("equal"), F.count("*").alias("rows"))
    return scored.filter((F.col("equal") >= RENAME_VALUES) & (F.col("equal") * 100 >= F.col("rows") * int(RENAME_SHARE * 100)))


def assign(scored: list[tuple[float, str, str]]) -> list[tuple[str, str]]:
    """One-to-one pairs by falling score, then by names."""
    used_a: set[str] = set()
    used_b: set[str] = set()
    out = []
    for _, a, b in sorted(scored, key=lambda s: (-s[0], s[1], s[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((a, b))
    return out
