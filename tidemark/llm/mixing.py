"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

A queue serves all sources at once, each in proportion to its target, and an over-drawn source repeats its documents. A document
finishes at the virtual time at which its source's words up to its end have been served: these words over the source's target. The
mix is the one sequence of all documents by finish time, cut off where the total budget is spent; `taken` is what lies before the
cut. At virtual time 1 every source has been served its target. The document that a source has in service then is queued in
packets of PACKET words, so that the cut leaves no source further than a packet from its target, however long its documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import running, stored

#: Weights of sources by their place in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: How often a source may be used at most.
MOST = 3
#: Words of a packet of the document that a source has in service when its target is reached.
PACKET = 64
WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(seed: int) -> Column:
    """A number of 62 bits, at least 0, from the id and the text's hash: the order of documents within their source."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("_text", F.lit(""))).cast("binary"))
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long") * 4


def source_ranks(sources: DataFrame) -> DataFrame:
    """Adds `place` in code point order, null last, from 0. Sources are sorted by ranges and counted by range, so none is the only task."""
    spread = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    spread = stored(spread, "sources")
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return spread.join(before, "_part").withColumn("place", F.col("_before") + inner - 1).drop("_part", "_before")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target). The total of all sizes is dealt out by weight; what is beyond `most` times a source's size is
    dealt to the others by weight, until none is above."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = source_ranks(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = stored(placed.withColumns({"weight": weight, "limit": F.col("source_size") * float(most)}), "targets")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = None, -1
    while True:  # each turn fills some sources up, so there are few; only four numbers come to the driver
        above = F.lit(False) if level is None else F.lit(level) * F.col("weight") > F.col("limit")
        row = table.agg(F.sum(F.when(above, F.col("limit")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.count_if(above), F.count("*")).first()
        if row[2] == full or row[2] == row[3]:
            break
        full = row[2]
        level = (total - row[0]) / row[1]
    share = F.least("limit", F.lit(level or 0.0) * F.col("weight"))
    return table.select("source", "source_size", share.alias("target"))


def mix_schedule(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule). documents: doc_id, row, size, source, source_size, target, first, where `row` tells documents apart and
    `first` is the source's words before it in its shuffled order. schedule: row, epoch, packet, finish, mix_start, taken, all that is
    queued, in one order by finish time; mix_start is the words queued before it, taken those of its words that the budget reaches."""
    sized = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"), F.md5(docs["text"].cast("binary")).alias("_text")
    )
    sized = stored(sized, "sizes")
    rows, budget = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = source_targets(sized)
    # null-safe: null sources get a key that no other source has
    keyed = lambda df: df.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    shuffled = running(keyed(sized), ["_source"], shuffle_key(seed), [F.col("doc_id"), F.col("_text")], F.col("size"), rows, "first")
    everything = shuffled.join(keyed(targets).drop("source"), "_source").withColumn("row", F.monotonically_increasing_id())
    everything = stored(everything.select("row", "doc_id", "_text", "size", "source", "source_size", "target", "first"), "queue")
    epochs = everything.filter((F.col("size") > 0) & (F.col("target") > 0)).select("row", "doc_id", "_text", "size", "source_size", "target", "first")
    last = F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1
    epochs = epochs.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)))))
    # in service before virtual time 1; one document of a source at most is still in service then
    epochs = epochs.withColumn("start", F.col("epoch") * F.col("source_size") + F.col("first")).filter("start < target")
    packets = F.when(F.col("start") + F.col("size") > F.col("target"), F.ceil(F.col("size") / PACKET)).otherwise(1).cast("int")
    queued = epochs.withColumn("_packets", packets).withColumn("packet", F.explode(F.sequence(F.lit(0), F.col("_packets") - 1)))
    words = F.when(F.col("_packets") == 1, F.col("size")).otherwise(F.least(F.lit(PACKET), F.col("size") - F.col("packet") * PACKET))
    queued = queued.withColumn("words", words.cast("long")).withColumn("finish", (F.col("start") + F.col("packet") * PACKET + F.col("words")) / F.col("target"))
    queued = stored(queued.select("row", "doc_id", "_text", "epoch", "packet", "words", "finish"), "queued")
    # finish is at most 1 but for what is in service at the end, so equal ranges of it hold about as many words each
    key = (F.least("finish", F.lit(1.0)) * float((1 << 62) - 1024)).cast("long")
    ties = [F.col("finish"), F.col("doc_id"), F.col("_text"), F.col("epoch"), F.col("packet"), F.col("row")]
    mixed = running(queued.withColumn("_all", F.lit(0)), ["_all"], key, ties, F.col("words"), 2 * rows, "mix_start")
    taken = F.least("words", F.greatest(F.lit(budget) - F.col("mix_start"), F.lit(0))).cast("long")
    return everything, mixed.select("row", "epoch", "packet", "words", "finish", "mix_start", taken.alias("taken"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, mix_start (where the mix first takes it; null if it doesn't),
    starts (where each time that it is taken begins, in order).

    A null text has size 0, a null source is one like others, the last. Documents of size 0 are never taken; nor is anything of
    a table without words, and an empty table gives no rows. A very long document is one row like others; only its place at the cut
    is worked out in packets. The order within a source goes by the hash of id and text, then id and text, so reruns agree; rows that
    agree in these are interchangeable. Other columns are ignored.
    """
    everything, schedule = mix_schedule(docs, seed)
    begun = schedule.filter("taken > 0").groupBy("row", "epoch").agg(F.sum("taken").alias("taken"), F.min("mix_start").alias("mix_start"))
    # at most MOST epochs, rounded up, of a document
    sums = begun.groupBy("row").agg(F.sum("taken").alias("taken"), F.min("mix_start").alias("mix_start"), F.sort_array(F.collect_list("mix_start")).alias("starts"))
    out = everything.join(sums, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "mix_start", F.coalesce("starts", F.array().cast("array<bigint>")).alias("starts"))
