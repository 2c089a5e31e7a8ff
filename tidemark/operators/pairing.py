"""Correspondence of items (files, tables) of two snapshots. Items: path, name, parent, ext, hash, size, is_dir; links: left, right
(paths), evidence. Each rule is joins over items and the links so far, so later rules see what earlier ones linked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.paths import captured_key
from tidemark.store import keep

VOTE_SHARE = 0.8
LINKS = "left string, right string, evidence string"


def _free(items: DataFrame, links: DataFrame | None, side: str) -> DataFrame:
    return items if links is None else items.join(links.select(F.col(side).alias("path")).distinct(), "path", "left_anti")


def same_content(left: DataFrame, right: DataFrame) -> DataFrame:
    """Same path and hash."""
    return left.select("path", "hash").join(right.select("path", "hash"), ["path", "hash"]).select(F.col("path").alias("left"), F.col("path").alias("right"), F.lit("same content").alias("evidence"))


def _by_place(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the same place by path within `by`: one to one, by joins on (by, place)."""
    w = Window.partitionBy(*by).orderBy("path")
    rank = lambda df, name: df.select(*by, F.col("path").alias(name), F.row_number().over(w).alias("_place"))
    return rank(left, "left").join(rank(right, "right"), [*by, "_place"]).select("left", "right")


def moved(left: DataFrame, right: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Unlinked items of the same hash, one to one: those of the same name first, then by path."""
    left, right = _free(left, links, "left"), _free(right, links, "right")
    named = _by_place(left, right, ["hash", "name"])
    rest = _by_place(_free(left, named, "left"), _free(right, named, "right"), ["hash"])
    return named.unionByName(rest).withColumn("evidence", F.lit("moved"))


def copied(left: DataFrame, right: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Unlinked right items with the hash of a left one, linked to the first of these by path."""
    first = left.groupBy("hash").agg(F.min("path").alias("left"))
    return _free(right, links, "right").join(first, "hash").select("left", F.col("path").alias("right"), F.lit("copy").alias("evidence"))


def declared(left: DataFrame, right: DataFrame, left_pattern: str, right_pattern: str, template: str, links: DataFrame | None = None) -> DataFrame:
    """Items whose paths give the same key, if no other item of either side gives it."""

    def keyed(items: DataFrame, side: str, pattern: str) -> DataFrame:
        keys = _free(items, links, side).select(F.col("path").alias(side), captured_key(F.col("path"), pattern, template).alias("key")).filter("key IS NOT NULL")
        return keys.groupBy("key").agg(F.count("*").alias("n"), F.min(side).alias(side)).filter("n = 1").drop("n")

    return keyed(left, "left", left_pattern).join(keyed(right, "right", right_pattern), "key").select("left", "right", F.concat(F.lit("declared: "), "key").alias("evidence"))


def declared_diagnostics(items: DataFrame, side: str, pattern: str, template: str) -> DataFrame:
    """(code, key, n): keys that several items of a side give."""
    keys = items.select(captured_key(F.col("path"), pattern, template).alias("key")).filter("key IS NOT NULL")
    return keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(f"declared_correspondence.duplicate_key.{side}").alias("code"), "key", "n")


def same_name_below(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """Unlinked children of linked parents that have the same name."""
    parents = links.select(F.col("left").alias("lp"), F.col("right").alias("rp")).distinct()
    a = _free(left, links, "left").select(F.col("path").alias("left"), F.col("parent").alias("lp"), "name", "is_dir")
    b = _free(right, links, "right").select(F.col("path").alias("right"), F.col("parent").alias("rp"), "name", F.col("is_dir").alias("_dir"))
    found = a.join(parents, "lp").join(b, ["rp", "name"]).filter("is_dir = _dir").select("left", "right")
    # a parent with several links could give a child several partners: the first by path
    w = lambda c, o: Window.partitionBy(c).orderBy(o)
    once = found.withColumn("_a", F.row_number().over(w("left", "right"))).filter("_a = 1").withColumn("_b", F.row_number().over(w("right", "left"))).filter("_b = 1")
    return once.select("left", "right", F.lit("same name").alias("evidence"))


def container_votes(left: DataFrame, right: DataFrame, links: DataFrame) -> DataFrame:
    """lp, rp, votes, share: linked children vote for their parents; share is of the children of the parent with fewer."""
    a = left.select(F.col("path").alias("left"), F.col("parent").alias("lp"))
    b = right.select(F.col("path").alias("right"), F.col("parent").alias("rp"))
    votes = links.select("left", "right").join(a, "left").join(b, "right").groupBy("lp", "rp").agg(F.count("*").alias("votes"))
    size = lambda items, name: items.groupBy(F.col("parent").alias(name)).agg(F.count("*").alias(f"n_{name}"))
    counted = votes.join(size(left, "lp"), "lp").join(size(right, "rp"), "rp")
    return counted.select("lp", "rp", "votes", F.least("n_lp", "n_rp").alias("children"))


def best_containers(votes: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Containers by their children's votes, one to one: of those with VOTE_SHARE or more, by falling votes, then by paths. Rounds in
    which each pair goes that is the best of both its sides, until none is left, give what one pass over the sorted pairs would."""
    fit = votes.filter(F.col("votes") * 100 >= F.col("children") * int(VOTE_SHARE * 100)).filter("lp <> '' AND rp <> ''")
    if links is not None:
        fit = fit.join(links.select(F.col("left").alias("lp")), "lp", "left_anti").join(links.select(F.col("right").alias("rp")), "rp", "left_anti")
    order = [F.desc("votes"), "children", "lp", "rp"]
    rest, out = keep(fit, "votes"), None
    while True:
        best = rest.withColumn("_a", F.row_number().over(Window.partitionBy("lp").orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy("rp").orderBy(*order)))
        chosen = keep(best.filter("_a = 1 AND _b = 1").select(F.col("lp").alias("left"), F.col("rp").alias("right"), F.lit("children").alias("evidence")), "containers")
        out = chosen if out is None else out.unionByName(chosen)
        if not chosen.take(1):
            return out
        rest = keep(rest.join(chosen.select(F.col("left").alias("lp")), "lp", "left_anti").join(chosen.select(F.col("right").alias("rp")), "rp", "left_anti"), "votes")


# --- row sets: split and merge -------------------------------------------------------------------------------------------


def exact_cover(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """whole: (whole, token); parts: (part, token), a token for each row. For each whole: parts, covered, residual, foreign, shared.

    parts: how many share a token with it; covered: its rows that parts make up; residual: the others; foreign: rows of these parts that
    it lacks; shared: its tokens that several parts have. A clean split has parts >= 2 and residual = foreign = shared = 0.
    """
    w = whole.groupBy("whole", "token").agg(F.count("*").alias("n"))
    p = parts.groupBy("part", "token").agg(F.count("*").alias("m"))
    owned = w.join(p, "token")
    taking = owned.select("whole", "part").distinct()
    by_token = w.join(p, "token", "left").groupBy("whole", "token").agg(F.first("n").alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.count("part").alias("owners"))
    of_whole = by_token.groupBy("whole").agg(
        F.sum(F.least("n", "m")).alias("covered"), F.sum(F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("residual"), F.count_if(F.col("owners") > 1).alias("shared"), F.sum(F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("over")
    )
    beyond = taking.join(p, "part").join(w.select("whole", "token"), ["whole", "token"], "left_anti").groupBy("whole").agg(F.sum("m").alias("beyond"))
    counts = taking.groupBy("whole").agg(F.count("*").alias("parts"))
    out = of_whole.join(counts, "whole").join(beyond, "whole", "left")
    return out.select("whole", "parts", "covered", "residual", (F.col("over") + F.coalesce("beyond", F.lit(0))).alias("foreign"), "shared")


def clean_splits(cover: DataFrame) -> DataFrame:
    return cover.filter("parts >= 2 AND residual = 0 AND `foreign` = 0 AND shared = 0")


def near_splits(cover: DataFrame) -> DataFrame:
    """Suggestions: several parts make up most of the whole, but not all."""
    return cover.filter("parts >= 2 AND NOT (residual = 0 AND `foreign` = 0 AND shared = 0) AND covered * 2 > covered + residual")
