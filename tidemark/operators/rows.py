"""Row correspondence between two editions of a table, and the cells that differ. Everything stays a DataFrame: a keyed comparison is
one full outer join, and changed cells come from it in one pass, whatever the number of columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cells import as_text, is_blank, named
from tidemark.operators.order import ROW, with_row_index
from tidemark.operators.regions import BLOCK_BITS, joined_runs

LCS_ROWS = 512


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """In the left table's order, by exact name, without the row index."""
    return [c for c in left.columns if c in right.columns and c != ROW]


def text_keys(df: DataFrame, keys: list[str]) -> list[Column]:
    """Keys compare as texts."""
    return [named(k).cast("string").alias(k) for k in keys]


def key_quality(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, null_keys (rows with a blank component), duplicate_keys (keys found more than once), duplicate_rows."""
    blank = F.lit(False)
    for k in keys:
        blank |= is_blank(named(k))
    counted = df.select(*text_keys(df, keys)).withColumn("_blank", blank).groupBy(*map(named, keys), "_blank").agg(F.count("*").alias("n"))
    twice = ~F.col("_blank") & (F.col("n") > 1)
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_blank"), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if(twice).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(twice, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    )


def keys_complete(df: DataFrame, keys: list[str]) -> bool:
    row = key_quality(df, keys).first()
    return row["null_keys"] == 0 and row["duplicate_keys"] == 0


def keyed_pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys (as text), l and r (structs of all columns; null on the side where the row is missing)."""
    pack = lambda df, name: df.select(*text_keys(df, keys), F.struct(*map(named, df.columns)).alias(name))
    return pack(left, "l").join(pack(right, "r"), keys, "full_outer")


def rows_added(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return _only(right, left, keys)


def rows_removed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return _only(left, right, keys)


def _only(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    there = other.select(*[named(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)])
    on = [named(k).cast("string").eqNullSafe(there[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(there, on, "left_anti")


def changed_cells(pairs: DataFrame, columns: list[str], by: list[str], old_names: dict[str, str] | None = None) -> DataFrame:
    """by, column, from, to of the cells that differ in pairs that have both sides (l, r). old_names: how l calls columns renamed since."""
    old = old_names or {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), named(old.get(c, c), "l").cast("string").alias("from"), named(c, "r").cast("string").alias("to")) for c in columns])
    changed = F.filter(cells, lambda x: ~x["from"].eqNullSafe(x["to"]))
    both = pairs.filter(F.col("l").isNotNull() & F.col("r").isNotNull())
    return both.select(*map(named, by), F.inline(changed))


def keyed_cells(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    columns = columns or [c for c in common_columns(left, right) if c not in keys]
    return changed_cells(keyed_pairs(*(df.select(*map(named, [*keys, *columns])) for df in (left, right)), keys), columns, keys)


def keyed_summary(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows_added, rows_removed, rows_changed, rows_equal, cells_changed."""
    columns = [c for c in common_columns(left, right) if c not in keys]
    pairs = keyed_pairs(left, right, keys)
    changed = sum((F.when(~named(c, "l").cast("string").eqNullSafe(named(c, "r").cast("string")), 1).otherwise(0) for c in columns), F.lit(0))
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    marked = pairs.select(F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(both & (changed > 0), "changed").otherwise("equal").alias("kind"), F.when(both, changed).otherwise(0).alias("n"))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return marked.agg(count("added").alias("rows_added"), count("removed").alias("rows_removed"), count("changed").alias("rows_changed"), count("equal").alias("rows_equal"), F.coalesce(F.sum("n"), F.lit(0)).alias("cells_changed"))


def positional_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the same index: _row, l, r."""
    pack = lambda df, name: df.select(ROW, F.struct(*[named(c) for c in df.columns if c != ROW]).alias(name))
    return pack(left, "l").join(pack(right, "r"), ROW, "full_outer")


def positional_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    return changed_cells(positional_pairs(left, right), common_columns(left, right), [ROW])


def churn(left: DataFrame, right: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row: changed_cells, total_cells, changed_rows, total_rows. Without common columns rows count in place of cells."""
    columns = common_columns(left, right)
    pairs = positional_pairs(left, right) if pairs is None else pairs
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    changed = sum((F.when(~named(c, "l").cast("string").eqNullSafe(named(c, "r").cast("string")), 1).otherwise(0) for c in columns), F.lit(0))
    n = F.when(both, changed).otherwise(len(columns))
    return pairs.select(n.alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("changed_cells"), (F.count("*") * len(columns)).alias("total_cells"), F.count_if(F.col("n") > 0).alias("changed_rows"), F.count("*").alias("total_rows")
    )


def reordered(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, left_row, right_row of the rows whose place differs; both tables have a row index."""
    return keyed_pairs(left, right, keys).filter("l IS NOT NULL AND r IS NOT NULL").select(*map(named, keys), F.col(f"l.{ROW}").alias("left_row"), F.col(f"r.{ROW}").alias("right_row")).filter("left_row <> right_row")


def signature(columns: list[str]) -> Column:
    """A row's text form over some columns; length-prefixed, so that cells can't run into each other."""
    cell = lambda c: F.when(named(c).isNull(), F.lit("n;")).otherwise(F.concat(F.length(as_text(named(c))).cast("string"), F.lit(":"), as_text(named(c))))
    return F.concat(*[cell(c) for c in columns]) if columns else F.lit("")


def sorted_pairs(left: DataFrame, right: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows that have the same place once both tables are sorted by their common columns' texts, then by index: _rank, l, r."""
    columns = common_columns(left, right)

    def side(df: DataFrame, name: str) -> DataFrame:
        keys = [as_text(named(c)).alias(f"_s{i}") for i, c in enumerate(order or columns)]
        keyed = df.select(*keys, F.col(ROW), F.struct(*map(named, columns), ROW).alias(name))
        return with_row_index(keyed, *[f"_s{i}" for i in range(len(keys))], ROW, name="_rank").select("_rank", name)

    return side(left, "l").join(side(right, "r"), "_rank", "full_outer")


def sorted_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_row, right_row, column, from, to."""
    pairs = sorted_pairs(left, right).withColumns({"left_row": F.col(f"l.{ROW}"), "right_row": F.col(f"r.{ROW}")})
    return changed_cells(pairs, common_columns(left, right), ["left_row", "right_row"])


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """columns, left_count, right_count of the rows that aren't equally frequent."""
    columns = columns or common_columns(left, right)
    both = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return both.groupBy(*columns).agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count")).filter("left_count <> right_count")


def runs(rows: DataFrame, index: str = ROW, by: list[str] | None = None) -> DataFrame:
    """by, start, rows: runs of consecutive indexes within each `by`."""
    by = by or []
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(index)
    island = F.col(index) - F.row_number().over(w)
    return rows.select(*by, index, island.alias("_island")).groupBy(*by, "_island").agg(F.min(index).alias("start"), F.count("*").alias("rows")).drop("_island")


def runs_of(rows: DataFrame) -> DataFrame:
    """start, rows: runs of consecutive _row of a whole table. Each block of indexes is a group; runs over a border are joined again."""
    found = runs(rows.withColumn("_block", F.shiftright(ROW, BLOCK_BITS)), ROW, ["_block"])
    return joined_runs(found.select(F.col("start").alias("first_row"), "rows"), []).withColumnRenamed("first_row", "start")


def lcs_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places; of equal ones, the walk from the end steps back in `a` first."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def lcs_alignment(left: DataFrame, right: DataFrame, by: list[str], most: int = LCS_ROWS) -> DataFrame:
    """by, left_row, right_row: rows of small tables (one for each `by`) matched in order by their common columns' texts. A table of
    more than `most` rows on a side has no pairs; the longest common subsequence is quadratic."""
    columns = [c for c in common_columns(left, right) if c not in by]
    rows = lambda df, side: df.select(*by, ROW, F.lit(side).alias("_side"), F.sha2(signature(columns), 256).alias("_sig"))
    both = rows(left, "l").unionByName(rows(right, "r"))
    fits = F.max("_n").over(Window.partitionBy(*by)) <= most
    both = both.withColumn("_n", F.count("*").over(Window.partitionBy(*by, "_side"))).withColumn("_fits", fits).filter("_fits").drop("_n", "_fits")
    types = dict(left.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", left_row long, right_row long"

    def align(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ROW)
        a, b = (group[group["_side"] == s] for s in "lr")
        pairs = lcs_pairs(a["_sig"].tolist(), b["_sig"].tolist())
        out = pd.DataFrame({"left_row": [a[ROW].iloc[i] for i, _ in pairs], "right_row": [b[ROW].iloc[j] for _, j in pairs]}, dtype="int64")
        for c, v in zip(reversed(by), reversed(key), strict=True):
            out.insert(0, c, v)
        return out

    return both.groupBy(*by).applyInPandas(align, schema)
