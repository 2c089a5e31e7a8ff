"""A pipeline from raw documents to packed sequences. Each stage works on what the one before it kept.

STAGES: (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with the columns of
documents. run() applies them to the documents of sf_dir, each result written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, mixing, ngram_join, packing, substring
from tidemark.llm.common import documents, free_name, small, stored
from tidemark.llm.queries import tokenizer_file

#: Documents whose language has a smaller score are rejected.
LEAST_LANGUAGE_SCORE = 0.5

#: A trained network, components, chains and a genetic algorithm: SQL can't express run()'s rows.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows. Null and empty texts, and those without a letter, are in none. Texts of any
    length count whole, repeated rows stay or go together, and an empty table stays empty. Columns of any name are kept."""
    return langid.with_known_language(docs, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest doc_id. Of rows that repeat it the one whose columns have the smallest
    hash stays. Rows without an id, and those without words, are in no group. An empty table stays empty. Columns of any name are kept."""
    linked = ngram_join.jaccard_components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(small(linked, "linked"), "doc_id", "left_anti").select(*docs.columns)
    repeated = small(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    again = kept.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
    once = again.groupBy("row.doc_id").agg(F.min_by("row", F.struct(F.xxhash64(F.to_json("row")), F.to_json("row"))).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one (a smaller doc_id) has; one of which nothing is left goes. Null texts and ids
    have no passages. Texts of any length are searched whole. An empty table stays empty. Columns of any name are kept."""
    return substring.without_passages(docs, stored(substring.shared_passages(docs), "passages"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the mix; one that it cuts counts if it takes half of it or more, so a
    source is off its target by half a document at most. Null and empty texts are never taken. Rows that repeat an id, or have none,
    are taken as often as that of them which is taken most. An empty table stays empty. Columns of any name are kept."""
    key, times, start = (free_name(docs, name) for name in ("id", "times", "start"))
    copies = mixing.mix(docs).filter("taken > 0").select(F.col("doc_id").alias(key), F.slice("starts", F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int")).alias(times))
    copies = copies.groupBy(key).agg(F.max_by(times, F.struct(F.size(times), times)).alias(times)).filter(F.size(times) > 0)
    taken = docs.join(small(copies, "copies"), docs["doc_id"].eqNullSafe(F.col(key)))
    mixed = taken.select(*[docs[c] for c in docs.columns], F.explode(times).alias(start))
    return mixed.repartitionByRange(start).sortWithinPartitions(start).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences. A null or empty text is its closing id alone; each row is packed on
    its own, however often it is repeated; an empty table gives no pieces. Other columns are ignored."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
