"""Quartile bucket digest: counts of hashed byte triplets, each bucket reduced to its quartile, with the length; digests compare by a bounded score."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, stored, table_rows

#: Buckets of a digest; each takes two bits.
BUCKETS = 128
#: Weight of a step of the length code against a step of a bucket, and the largest number of length steps that count.
LENGTH_WEIGHT, LENGTH_MOST = 4, 12
#: Differences by which likeness reaches 0. Unlike texts differ by about BUCKETS.
DIFFERENCE_MOST = 160
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digest(data: bytes) -> str:
    """Hex: 2 digits of the length code, 64 of the buckets' quartiles. Fewer than 3 bytes are counted as one triplet padded with zeros."""
    x = np.frombuffer(data if len(data) >= 3 else data.ljust(3, b"\0"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for a in range(0, len(x) - 2, 1 << 20):  # long texts in parts
        y = x[a : a + (1 << 20) + 2].astype(np.uint32)
        t = y[:-2] * np.uint32(0x9E3779B1) + y[1:-1] * np.uint32(0x85EBCA6B) + y[2:] * np.uint32(0xC2B2AE35)
        t ^= t >> np.uint32(15)
        t *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(t >> np.uint32(25), minlength=BUCKETS)
    ordered = np.sort(counts)
    quartiles = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = np.searchsorted(quartiles, counts, "left").astype(np.uint8)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    return f"{length_code(len(data)):02x}{packed.tobytes().hex()}"


def length_code(n: int) -> int:
    """Eight steps for each doubling, at most 255."""
    return min(255, int(8 * np.log2(n + 1)))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from DIFFERENCE_MOST on. A bucket differs by the distance of its quartiles, the widest by 6."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(d[2:]), np.uint8) for d in (a, b))
    away = np.zeros(4, np.int64)
    for shift in (0, 2, 4, 6):
        away += np.bincount(np.abs((x >> shift & 3).astype(np.int8) - (y >> shift & 3).astype(np.int8)), minlength=4)
    length = min(LENGTH_MOST, abs(int(a[:2], 16) - int(b[:2], 16)))
    return max(0.0, 1 - (away[1] + 2 * away[2] + 6 * away[3] + LENGTH_WEIGHT * max(0, length - 1)) / DIFFERENCE_MOST)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id: int | None, text: str, mark: str, following: str, next_mark: str) -> tuple:
    new = edited(text, following).encode()
    new_mark = digest(new)
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), mark, new_mark, likeness(mark, new_mark), likeness(mark, next_mark)


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, in ascending order of doc_id.

    One range shuffle brings neighbours together; each partition works on rows as they stream by and keeps one of them. Its
    first and last row go to a small table, where the last row of a partition meets the first of the next one with rows (after
    the last partition: of the first one). Null texts are empty, very long ones are digested part by part. Null ids come first; rows
    with the same id go by their texts' hashes; the only row of a table is its own next. An empty table gives no rows. Other columns
    are ignored.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    ends = ", part int, head string, tail string"
    kind = arrow_schema(SCHEMA + ends)
    names = kind.names

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: tuple[int | None, str, str] | None = None
        for batch in batches:
            done = []
            for i, following in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mark = digest(following.encode())
                if held is None:
                    done.append((i, *[None] * 6, part, following, None))
                else:
                    done.append((*_row(*held, following, mark), None, None, None))
                held = i, following, mark
            if done:
                yield table_rows(dict(zip(names, zip(*done, strict=True), strict=True)), kind)
        if held:
            yield table_rows(dict(zip(names, zip((held[0], *[None] * 6, part, None, held[1]), strict=True), strict=True)), kind)

    # the text's hash parts rows of one id (or of none)
    keyed = docs.withColumn("_hash", F.xxhash64("text")).repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    walked = stored(keyed.select("doc_id", "text").mapInArrow(walk, SCHEMA + ends), "fingerprint")
    heads, tails = walked.filter("head IS NOT NULL").select("part", "head"), walked.filter("tail IS NOT NULL").select("part", "doc_id", "tail")
    # two rows for each partition, without texts
    everywhere = Window.partitionBy(F.lit(0)).orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("part").over(everywhere), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("_after"))
    last = tails.join(after, "part").join(heads.select(F.col("part").alias("_after"), "head"), "_after").select("doc_id", "tail", "head")
    done = arrow_schema(SCHEMA)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(i, a, digest(a.encode()), b, digest(b.encode())) for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield table_rows(dict(zip(done.names, zip(*rows, strict=True), strict=True)), done)

    middle = walked.filter("part IS NULL").select(*done.names)
    return middle.unionByName(last.mapInArrow(close, SCHEMA))
