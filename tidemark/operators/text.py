"""Differences of texts: what their line ends, marks, encodings and white space say, and which lines came and went."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sequences import matches

EXAMPLES = 8
BOM = "\ufeff"


def line_count(text: Column) -> Column:
    """Lines; a last one without an end counts."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(ends + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def line_ending(text: Column) -> Column:
    """none, lf, crlf, cr or mixed."""
    crlf = occurrences(text, "\r\n")
    lf, cr = occurrences(text, "\n") - crlf, occurrences(text, "\r") - crlf
    kinds = F.when(crlf > 0, 1).otherwise(0) + F.when(lf > 0, 1).otherwise(0) + F.when(cr > 0, 1).otherwise(0)
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").otherwise("cr")


def normal_ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def text_facts(text: Column) -> Column:
    """Struct of lines, line_ending, has_bom, ends_with_newline, trailing_spaces (lines that end in blanks or tabs)."""
    return F.struct(
        line_count(text).alias("lines"),
        line_ending(text).alias("line_ending"),
        F.startswith(text, F.lit(BOM)).alias("has_bom"),
        F.endswith(text, F.lit("\n")).alias("ends_with_newline"),
        F.regexp_count(text, F.lit(r"(?m)[ \t]+$")).cast("long").alias("trailing_spaces"),
    )


def change_kind(a: Column, b: Column) -> Column:
    """identical, bom_changed, line_endings_changed, whitespace_only_changed or lines_changed: the first that explains it."""
    bare = lambda t: F.regexp_replace(t, f"^{BOM}", "")
    return (
        F.when(a == b, "identical")
        .when(bare(a) == bare(b), "bom_changed")
        .when(normal_ends(bare(a)) == normal_ends(bare(b)), "line_endings_changed")
        .when(without_spaces(bare(a)) == without_spaces(bare(b)), "whitespace_only_changed")
        .otherwise("lines_changed")
    )


def lines_changed(a: str, b: str) -> tuple[int, int, list[str]]:
    """(added, removed, first examples): the fewest lines that turn one text into the other."""
    x, y = a.splitlines(), b.splitlines()
    i = j = common = 0
    examples: list[str] = []
    for p, q in (*matches(x, y), (len(x), len(y))):
        if len(examples) < EXAMPLES:
            examples += [f"-{line}" for line in x[i : min(p, i + EXAMPLES)]] + [f"+{line}" for line in y[j : min(q, j + EXAMPLES)]]
        i, j, common = p + 1, q + 1, common + 1
    common -= 1  # the ends
    return len(y) - common, len(x) - common, examples[:EXAMPLES]


def line_changes(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: by, l, r (texts). by, lines_added, lines_removed, examples of those whose lines changed. Each pair is on its own in Python."""
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", lines_added long, lines_removed long, examples array<string>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [lines_changed(a, b) for a, b in zip(part["l"], part["r"], strict=True)]
            out = part[by].copy()
            out["lines_added"], out["lines_removed"], out["examples"] = ([f[i] for f in found] for i in range(3))
            yield out

    return pairs.filter(change_kind(F.col("l"), F.col("r")) == "lines_changed").select(*by, "l", "r").mapInPandas(run, schema)


def line_multiset_changes(left: DataFrame, right: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, lines_added, lines_removed by how often each line occurs: order doesn't count, and nothing leaves the JVM."""
    lines = lambda df, n: df.select(key, F.explode(F.split(text, "\n")).alias("line"), F.lit(n).alias("d"))
    both = lines(left, -1).unionByName(lines(right, 1)).groupBy(key, "line").agg(F.sum("d").alias("d"))
    return both.groupBy(key).agg(F.sum(F.greatest("d", F.lit(0))).alias("lines_added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("lines_removed")).filter("lines_added + lines_removed > 0")
