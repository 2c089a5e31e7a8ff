"""MinHash near-dedup with HyperMinHash sketches: documents whose sets of three-word shingles have a Jaccard similarity of 0.85 or more.

1. Documents with equal sets are one class; its smallest doc_id stands for it.
2. Sketch: a shingle's hash names a bucket by its top bits; of a bucket's smallest hash the number of leading zeros and ten bits behind
   them are kept: a register of 16 bits. A bucket without a shingle takes the register of a bucket that has one, found by hashes that
   depend on the bucket alone, so small sets fill their sketch too, and two sets still agree in a bucket as often as they are similar.
3. Banding: four registers are a band. Two linked sets agree in none of the 32 bands with a probability below 1e-10. Documents that
   share bands are a block; documents of one component don't meet again, so a group of near copies is not expanded into pairs.
4. Estimate: the share of equal registers, less the collisions that sets of these sizes have by chance. It is compared with 0.85 less
   six standard deviations, so that it drops what is hopeless and nothing else.
5. In blocks, what the estimate leaves is counted on samples of the sets: all shingles of a set of up to SAMPLE, of larger ones those
   whose hash ends in enough zeros. So unlinked near copies of a large group, whose number of pairs may be large, stay in their task.
6. Every pair that is left is confirmed on the full sets of both whole texts.

Pairs are sought as in the n-gram join: first each document with those that lead its blocks (linear in a group's size), then, in
blocks that still hold several components, a forest of candidates, then all that is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, arrow_schema, drop_table, mix64, signed, slices, stored, table_rows
from tidemark.llm.ngram_join import GROUP_TOKENS, block_table, components, open_blocks, seed_pairs, shingle_sets, tested, tree_parts

WORDS = 3
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Registers are of 6 bits for leading zeros and MANTISSA behind them; BUCKETS is a power of two.
BUCKETS, MANTISSA, BAND = 128, 10, 4
BUCKET_BITS = BUCKETS.bit_length() - 1
#: Hashed buckets that an empty one tries before it takes the next filled one.
PROBES = 1024
#: Shingles of a sample, about, and at most as many times more.
SAMPLE = 4096
#: Estimates from here on are followed.
LEAST = PERCENT / 100 - 6 * (PERCENT / 100 * (1 - PERCENT / 100) / BUCKETS) ** 0.5


def _probes() -> np.ndarray:
    """By try and bucket: where an empty bucket looks."""
    n = np.arange(PROBES * BUCKETS, dtype=np.uint64)
    return (mix64(n + np.uint64(0x1234_5678_9ABC)) >> np.uint64(40)).astype(np.int64).reshape(PROBES, BUCKETS) % BUCKETS


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BUCKETS registers for each sorted set of hashes; all zeros for an empty set."""
    sizes = np.array([len(x) for x in sets], np.int64)
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    if not sizes.sum():
        return out
    tokens = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    bucket = (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(row * BUCKETS + bucket, prepend=-1))  # sets are sorted, so this is a bucket's smallest hash
    value = tokens[first] << np.uint64(BUCKET_BITS)
    length = np.frexp((value >> np.uint64(11)).astype(float))[1]  # 53 bits, so the float is exact
    zeros = (53 - length).astype(np.uint64)
    shifted = np.where(length > 0, value << np.minimum(zeros + np.uint64(1), np.uint64(63)), 0)
    out[row[first], bucket[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (shifted >> np.uint64(64 - MANTISSA)).astype(np.uint16)
    filled = np.zeros(out.shape, bool)
    filled[row[first], bucket[first]] = True
    rows, places = np.nonzero(~filled & (sizes > 0)[:, None])
    for probe in _probes():
        if not len(rows):
            return out
        at = probe[places]
        good = filled[rows, at]
        out[rows[good], places[good]] = out[rows[good], at[good]]
        rows, places = rows[~good], places[~good]
    for r, p in zip(rows, places, strict=True):
        near = np.flatnonzero(filled[r])
        out[r, p] = out[r, near[np.searchsorted(near, p) % len(near)]]
    return out


def bands(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    packed = np.ascontiguousarray(sketch).view(np.uint64)
    return mix64(packed + mix64(np.arange(1, packed.shape[1] + 1, dtype=np.uint64)))


@lru_cache(maxsize=4096)
def _collisions(steps_a: int, steps_b: int) -> float:
    """The chance that registers of two disjoint sets of 2 ** (steps / 2) shingles are equal: over all registers, the product of the
    chances that a bucket's smallest hash falls on it in each."""
    zeros = np.arange(64 - BUCKET_BITS)[:, None]
    low = 2.0**-(zeros + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1 + MANTISSA)
    chance = 1.0
    for steps in (steps_a, steps_b):
        n = max(1.0, 2.0 ** (steps / 2) / BUCKETS)  # shingles of a filled bucket
        chance = chance * (np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-16))))
    return float(chance.sum())


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity by the number of equal registers, corrected for chance: of those that aren't the same shingle's, a share
    collides."""
    steps = [np.rint(2 * np.log2(np.maximum(n, 1))).astype(int) for n in (n_a, n_b)]
    pairs, at = np.unique(np.stack(steps, 1), axis=0, return_inverse=True)
    chance = np.array([_collisions(int(a), int(b)) for a, b in pairs])[at.ravel()] if len(pairs) else np.zeros(0)
    return np.maximum(0.0, (equal / BUCKETS - chance) / (1 - chance))


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, n, ha, hb (which tell sets apart), sketch (registers), prefix (band keys, 8 bytes each), core (0) of every document."""
    schema = "doc_id long, n long, ha long, hb long, sketch binary, prefix binary, core int"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            sets = shingle_sets(data, offsets, WORDS)
            made = registers(sets)
            keys = bands(made)
            digest = lambda salt, sets=sets: [int(signed(mix64(x ^ np.uint64(salt)).sum(keepdims=True, dtype=np.uint64))[0]) for x in sets]
            full = [len(x) > 0 for x in sets]
            columns = {"sketch": [x.tobytes() if f else b"" for x, f in zip(made, full, strict=True)], "prefix": [x.tobytes() if f else b"" for x, f in zip(keys, full, strict=True)]}
            yield table_rows({"doc_id": part.column(0), "n": [len(x) for x in sets], "ha": digest(0), "hb": digest(0x5DEECE66D1234567), **columns, "core": [0] * len(sets)}, kind)

    return stored(docs.mapInArrow(run, schema), "sketches")


def plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    kind = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (3, 5))
            n, m = (batch.column(k).to_numpy() for k in (2, 4))
            good = pa.array(estimate((x == y).sum(1), n, m) >= LEAST)
            yield table_rows({"a": batch.column(0).filter(good), "b": batch.column(1).filter(good)}, kind)

    return joined.select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(run, "a long, b long")


def sample_of(tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """32 bits of the shingles whose last `level` bits are zero, and the level."""
    level = max(0, (max(1, len(tokens) // SAMPLE)).bit_length() - 1)
    values = (mix64(tokens) >> np.uint64(32)).astype(np.uint32)
    return np.unique(values[values & np.uint32((1 << level) - 1) == 0]), level


def samples(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, sample, level of some documents; ids: doc_id, stored."""
    schema = "doc_id long, sample binary, level int"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            made = [sample_of(x) for x in shingle_sets(data, offsets, WORDS)]
            yield table_rows({"doc_id": part.column(0), "sample": [x.tobytes() for x, _ in made], "level": [level for _, level in made]}, kind)

    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi").mapInArrow(run, schema)


class Samples:
    """The samples of a group's documents, as numbers of its shingles, so that one pass counts a document's overlaps with all others."""

    def __init__(self, raw: list[bytes], levels: list[int]):
        self.level = np.array(levels)
        values = np.concatenate([np.frombuffer(x, np.uint32) for x in raw])
        self.ends = np.cumsum([len(x) // 4 for x in raw])
        self.starts = self.ends - [len(x) // 4 for x in raw]
        distinct, self.number = np.unique(values, return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)
        # by level: how many of each document's shingles are in a sample of that level
        self.count = {level: self._sums((values & np.uint32((1 << level) - 1)) == 0) for level in set(levels)}

    def _sums(self, marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[self.ends] - total[self.starts]

    def may_link(self, k: int, others: np.ndarray) -> np.ndarray:
        """Whether the samples of k and of others allow a link."""
        own = self.number[self.starts[k] : self.ends[k]]
        self.mark[own] = True
        lengths = self.ends[others] - self.starts[others]
        before = np.cumsum(lengths) - lengths
        places = np.repeat(self.starts[others] - before, lengths) + np.arange(lengths.sum())
        total = np.concatenate([[0], np.cumsum(self.mark[self.number[places]])])
        both = total[before + lengths] - total[before]
        self.mark[own] = False
        level = np.maximum(self.level[others], self.level[k])
        sizes = np.zeros(len(others), np.int64)
        for one in np.unique(level):
            at = level == one
            sizes[at] = self.count[int(one)][others[at]] + self.count[int(one)][k]
        union = np.maximum(sizes - both, 1)
        margin = np.where(level > 0, 6 * np.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / union), 1e-9)
        return both / union >= PERCENT / 100 - margin


def block_pairs(rows: DataFrame, reps: DataFrame, docs: DataFrame, forest: bool) -> DataFrame:
    """(a, b, more) that the sketches and samples of open blocks' documents leave over; pairs of parts of a block are dealt out as in the
    n-gram join.

    forest: a group gives no candidate that its others make needless, should they be links; `more` tells that it held some back."""
    schema = "a long, b long, more boolean"
    kind = arrow_schema(schema)
    by = ["block", "sub", "i", "j"]
    ids = stored(rows.select("doc_id").distinct(), "open_ids")
    facts = stored(samples(docs, ids).join(reps.select("doc_id", "sketch"), "doc_id"), "samples")
    rows = tree_parts(rows).join(facts, "doc_id").select(*by, "own", "doc_id", "n", "comp", "sketch", "sample", "level")
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "doc_id")

    def of_group(group: list[dict]) -> tuple[list[int], list[int], bool]:
        sketch = np.frombuffer(b"".join(r["sketch"] for r in group), np.uint16).reshape(-1, BUCKETS)
        ids, n, comp, own = (np.array([r[k] for r in group], np.int64) for k in ("doc_id", "n", "comp", "own"))
        within = group[0]["i"] == group[0]["j"]
        sampled = None
        a, b, more = [], [], False
        above = {int(c): int(c) for c in comp}  # components, as far as this group's candidates would join them

        def top(c: int) -> int:
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        for k in range(len(group)):
            rest = np.arange(k + 1, len(group))
            may = (comp[rest] != comp[k]) & (100 * np.minimum(n[rest], n[k]) >= PERCENT * np.maximum(n[rest], n[k]))
            rest = rest[may if within else may & (own[rest] != own[k])]
            if not len(rest):
                continue
            equal = (sketch[rest] == sketch[k]).sum(1)
            rest = rest[estimate(equal, n[rest], np.full(len(rest), n[k])) >= LEAST]
            if not len(rest):
                continue
            sampled = sampled or Samples([r["sample"] for r in group], [r["level"] for r in group])
            for other in rest[sampled.may_link(k, rest)].tolist():
                if forest:
                    c, d = top(int(comp[k])), top(int(comp[other]))
                    if c == d:
                        more = True
                        continue
                    above[max(c, d)] = min(c, d)
                a.append(int(min(ids[k], ids[other])))
                b.append(int(max(ids[k], ids[other])))
        return a, b, more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def given() -> Iterator[pa.RecordBatch]:
            a, b, more = of_group(held)
            if a:
                yield table_rows({"a": a, "b": b, "more": [more] * len(a)}, kind)

        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in by):
                    yield from given()
                    held = []
                held.append(row)
        if held:
            yield from given()

    return dealt.mapInArrow(run, schema).groupBy("a", "b").agg(F.bool_or("more").alias("more"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, the document's own included), kept
    (it is its component's smallest).

    Documents without words, or with a null text, link with nothing and are kept. A null doc_id is left with a null component, links with
    nothing and is kept. Rows that repeat a doc_id are one node of the graph, linked with whatever any of them is, and are kept or not
    together. Equal texts are one class, very long ones are compared whole. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    sketches = sketch_table(docs)
    filled = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(filled.groupBy("n", "ha", "hb").agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes, ["n", "ha", "hb"]).filter("doc_id = rep").select("doc_id", "n", "ha", "hb", "sketch", "prefix", "core")
    members = stored(sketches.select("doc_id", "n", "ha", "hb").join(classes, ["n", "ha", "hb"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")), "members")
    # rows that repeat a doc_id may stand for several classes, or one of them several times
    reps = stored(reps.dropDuplicates(["doc_id", "n", "ha", "hb"]).drop("ha", "hb"), "reps")
    drop_table(spark, sketches.tidemark_path)
    keys = (reps.count() + 1) * (BUCKETS // BAND)
    blocks = block_table(reps, max(64, keys // GROUP_TOKENS + 1))
    done = tested(stored(plausible(seed_pairs(blocks), reps), "seeds"), docs, WORDS, PERCENT)
    for forest in (True, False):
        labels = components(done.filter("linked"))
        found = stored(block_pairs(stored(open_blocks(blocks, labels), "open_rows"), reps, docs, forest), "candidates")
        fresh = stored(found.join(done.select("a", "b"), ["a", "b"], "left_anti"), "fresh")
        if fresh.take(1):
            done = stored(done.unionByName(tested(fresh, docs, WORDS, PERCENT)), "tested")
        # what was held back is joined already if all candidates are links
        if not found.filter("more").take(1) or not found.join(done.filter("NOT linked"), ["a", "b"], "left_semi").take(1):
            break
    repeated = members.filter("rep IS NOT NULL AND rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    edges = done.filter("linked").select("a", "b").unionByName(repeated.join(reps.select(F.col("doc_id").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
    labels = components(edges)
    out = members.join(labels, members["rep"] == labels["node"], "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
