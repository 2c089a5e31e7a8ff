"""Sharding by balanced label propagation: iterative joins move linked documents to the shard of most of their neighbours,
under quotas that keep the shards' document counts within one of each other. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import KEY_BITS, key_of, ranked, stored

SHARDS = 8
ROUNDS = 8
LAW = "rows"
#: A hot group's shard is full if it has this share of the shard's rows.
FULL = 0.97
#: A group of this share of a shard's rows is large: rows of smaller groups move first.
LARGE = 0.02


def hot_groups(there: DataFrame, room: float, shards: int) -> dict[int, tuple[list[int], int]]:
    """{grp: (shards of its own, where its other rows wish to be)} of groups that fill whole shards; there: grp, shard, n.

    There are at most `shards` of them. The largest group chooses first, the shards that hold most of it. Its other rows wish for
    the fullest of its own that isn't full, then for the fullest shard that belongs to none.
    """
    hot = there.groupBy("grp").agg(F.sum("n").alias("total")).filter(F.col("total") >= room)
    rows = there.join(F.broadcast(hot), "grp").collect()  # at most `shards` groups, a row for each shard
    total = {r["grp"]: r["total"] for r in rows}
    order = sorted(total, key=lambda g: (-total[g], g))
    held = {g: sorted(range(shards), key=lambda s: (-count[s], s)) for g in order for count in [{s: 0 for s in range(shards)} | {r["shard"]: r["n"] for r in rows if r["grp"] == g}]}
    n = {(r["grp"], r["shard"]): r["n"] for r in rows}
    own: dict[int, list[int]] = {}
    for g in order:
        own[g] = [s for s in held[g] if not any(s in o for o in own.values())][: int(total[g] // room)]
    common = [s for s in range(shards) if not any(s in o for o in own.values())]
    return {g: (own[g], next((s for s in own[g] if n.get((g, s), 0) < FULL * room), next((s for s in held[g] if s in common), own[g][0]))) for g in order}


def _pair(df: DataFrame) -> DataFrame:
    return df.withColumn("_pair", F.col("shard") * 4096 + F.col("wish"))


def propagate(nodes: DataFrame, rows: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """nodes: row, grp, linked (whether the group has several rows), shard. Returns them with new shards; each shard keeps its count.

    In a round a linked row wishes to be where most of its group is. Groups that fill whole shards have these for themselves, and
    others don't wish for them. As many rows go from one shard to another as come back: first those that wish to, small groups'
    before large groups', then rows without links, which cut no edge wherever they are. So counts never change.
    """
    room = rows / shards
    for turn in range(rounds):
        linked, free = nodes.filter("linked"), nodes.filter("NOT linked")
        there = stored(linked.groupBy("grp", "shard").agg(F.count("*").alias("n")), "there")
        hot = hot_groups(there, room, shards)
        closed = [s for own, _ in hot.values() for s in own]
        # the fullest shard; of equal ones another for each group, so that groups don't all meet in the first
        place = F.struct(F.when(F.col("shard").isin(closed), F.lit(-1)).otherwise(F.col("n")), F.pmod(F.xxhash64("grp", "shard"), F.lit(1 << 20)))
        best = there.groupBy("grp").agg(F.max_by("shard", place).alias("wish"), (F.sum("n") >= LARGE * room).alias("large"))
        for grp, (_, wish) in hot.items():
            best = best.withColumn("wish", F.when(F.col("grp") == grp, wish).otherwise(F.col("wish")))
        best = stored(best, "best")  # so that the join deals out both sides and Spark can split a hot group
        stays = F.lit(False)
        for grp, (own, _) in hot.items():
            stays |= (F.col("grp") == grp) & F.col("shard").isin(own)
        movers = linked.join(best, "grp").filter(~stays & (F.col("shard") != F.col("wish"))).select("row", "shard", "wish", "large")
        counts = movers.groupBy("shard", "wish").agg(F.count("*").alias("n"))
        idle = free.groupBy("shard").agg(F.floor(F.count("*") / (shards - 1)).alias("idle"))
        # at most `shards` squared rows from here: how many go from a to b
        grid = nodes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).withColumn("wish", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> wish")
        grid = grid.join(F.broadcast(counts), ["shard", "wish"], "left")
        grid = grid.join(F.broadcast(counts.select(F.col("shard").alias("wish"), F.col("wish").alias("shard"), F.col("n").alias("back"))), ["shard", "wish"], "left")
        grid = grid.join(F.broadcast(idle), "shard", "left").join(F.broadcast(idle.select(F.col("shard").alias("wish"), F.col("idle").alias("idle_there"))), "wish", "left").na.fill(0)
        grid = grid.withColumn("go", F.least("n", F.col("back") + F.col("idle_there")))
        grid = grid.withColumn("return", F.least("back", F.col("n") + F.col("idle")))
        # rows without links that go from here to there, to make up for those that come
        grid = grid.withColumn("fill", F.greatest(F.col("return") - F.col("go"), F.lit(0)))
        quota = stored(grid.select("shard", "wish", "go", "fill"), "quota")
        if not quota.filter("go > 0").take(1):
            return nodes
        turns = F.shiftright(key_of("row", F.lit(turn)), 1) + F.when(F.col("large"), F.lit(1 << KEY_BITS - 1)).otherwise(F.lit(0))
        going = ranked(_pair(movers), ["_pair"], turns, [F.col("row")], rows, "_rank").join(F.broadcast(quota), ["shard", "wish"]).filter("_rank < go").select("row", F.col("wish").alias("to"))
        w = Window.partitionBy("shard").orderBy("wish").rowsBetween(Window.unboundedPreceding, -1)
        fills = quota.filter("fill > 0").select("shard", "wish", F.coalesce(F.sum("fill").over(w), F.lit(0)).alias("_from"), "fill")
        filling = ranked(free.select("row", "shard"), ["shard"], key_of("row", F.lit(turn)), [F.col("row")], rows, "_rank").join(F.broadcast(fills), "shard").filter("_rank >= _from AND _rank < _from + fill").select("row", F.col("wish").alias("to"))
        moved = going.unionByName(filling)
        nodes = stored(nodes.join(moved, "row", "left").select("row", "grp", "linked", F.coalesce("to", "shard").alias("shard")), "shards")
    return nodes


def cut_edges(sharded: DataFrame) -> DataFrame:
    """One row: groups of several equal texts, groups in more than one shard, and the rows of these that are not in their group's fullest shard.
    sharded: as from shard()."""
    there = sharded.groupBy("size", "text_crc32", "shard").agg(F.count("*").alias("n"))
    groups = there.groupBy("size", "text_crc32").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("shards")).filter("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.count_if(F.col("shards") > 1).alias("split"), F.sum("n").alias("rows"), F.sum(F.col("n") - F.col("most")).alias("apart"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `rows`).

    Equal texts are linked; a null text links with nothing and counts as empty otherwise. The first shards deal rows out in
    the order of hashed ids and texts, which makes counts at most one apart; moves keep them. slot goes by the same hash. Repeated rows
    are rows of their own, very long texts are rows like others, and an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(docs["text"]), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(docs["text"].isNotNull(), F.xxhash64(docs["text"], F.lit(0))).alias("_text"),
        F.when(docs["text"].isNotNull(), F.xxhash64(docs["text"], F.lit(1))).alias("_text2"),
    ).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "rows")
    n = rows.count()
    dealt = ranked(rows.withColumn("_all", F.lit(0)), ["_all"], key_of("doc_id", "_text"), [F.col("doc_id"), F.col("text_crc32"), F.col("row")], n, "_deal")
    group = F.coalesce(F.xxhash64("_text", "_text2", "text_crc32", "size"), F.lit(0))
    dealt = stored(dealt.select("row", group.alias("grp"), F.col("_text").isNotNull().alias("_some"), (F.col("_deal") % shards).cast("int").alias("shard")), "dealt")
    several = dealt.filter("_some").groupBy("grp").agg(F.count("*").alias("_n")).filter("_n > 1").select("grp", F.lit(True).alias("linked"))
    several = stored(several, "several")
    nodes = stored(dealt.join(several, "grp", "left").select("row", "grp", (F.coalesce("linked", F.lit(False)) & F.col("_some")).alias("linked"), "shard"), "nodes")
    placed = rows.join(propagate(nodes, n, shards, rounds).select("row", "shard"), "row")
    out = ranked(placed, ["shard"], key_of("doc_id", "_text"), [F.col("doc_id"), F.col("text_crc32"), F.col("row")], n, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
