"""More than two snapshots: what changed from each to the next, as a batch over all of them or as snapshots arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.rows import keyed_summary


def key_changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: snapshot, keys. from_snapshot, to_snapshot, added, removed for each snapshot and the next.

    One pass for all snapshots: each key's own snapshots are ordered, and a key comes or goes where its previous or next snapshot
    is not the table's. The window is by key, so no task has a snapshot.
    """
    order = rows.select("snapshot").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("snapshot")  # one row for each snapshot
    steps = order.select("snapshot", F.lag("snapshot").over(w).alias("before"), F.lead("snapshot").over(w).alias("after"))
    own = Window.partitionBy(*keys).orderBy("snapshot")
    marked = rows.select("snapshot", *keys).distinct().withColumns({"_last": F.lag("snapshot").over(own), "_next": F.lead("snapshot").over(own)}).join(F.broadcast(steps), "snapshot")
    came = marked.filter(F.col("before").isNotNull() & ~F.col("_last").eqNullSafe(F.col("before"))).groupBy("before", "snapshot").agg(F.count("*").alias("added"))
    went = marked.filter(F.col("after").isNotNull() & ~F.col("_next").eqNullSafe(F.col("after"))).groupBy("snapshot", "after").agg(F.count("*").alias("removed"))
    pairs = steps.filter("after IS NOT NULL").select(F.col("snapshot").alias("from_snapshot"), F.col("after").alias("to_snapshot"))
    came = came.select(F.col("before").alias("from_snapshot"), F.col("snapshot").alias("to_snapshot"), "added")
    went = went.select(F.col("snapshot").alias("from_snapshot"), F.col("after").alias("to_snapshot"), "removed")
    by = ["from_snapshot", "to_snapshot"]
    return pairs.join(came, by, "left").join(went, by, "left").select(*by, F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("removed", F.lit(0)).alias("removed"))


def follow(stream: DataFrame, keys: list[str], state: str, sink: str, checkpoint: str):
    """Starts a stream in which each micro-batch is a snapshot: it is compared with the last one, which is kept at `state`, and the
    summary is appended at `sink` (Parquet). State goes to a new folder for each batch, so a batch that is tried again starts from
    the same snapshot."""

    def compare(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{state}/{batch_id}")
        if batch_id:
            before = spark.read.schema(batch.schema).parquet(f"{state}/{batch_id - 1}")
            keyed_summary(before, batch, keys).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint).start()
