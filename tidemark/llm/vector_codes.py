"""Vector code compression: each vector becomes the numbers of the nearest entries of small codebooks, one for each part of it.

Components are whole numbers, so codebooks and errors are exact and don't depend on the order of rows. A round is one pass over the
vectors: tasks assign their parts and send sums by entry, which Spark adds up; what comes to the driver has the size of the codebooks.

The nearest entry is found in an annulus. Entries are sorted by norm. An entry that is no further from a part than the best one so far
has a norm within that distance of the part's norm (triangle inequality), so a binary search gives the interval of entries that may
be as near. These alone are evaluated, exactly, and the interval shrinks as the best distance falls. Its ends are included, so ties
are seen, and go to the lower index.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, arrow_schema, shared_folder, stored, table_rows

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this, in parts of up to NARROW, have squared distances in 64 bits; larger ones are Python's own integers.
SAFE, NARROW = 1 << 27, 32
#: Sums travel in pieces of so many bits, so adding them up can't overflow a long.
LIMB = 40
#: Rows of a label from which its sum is sent to every task instead of being joined by a shuffle, where labels are many.
HOT_LABEL = 100_000


@dataclass
class Codebooks:
    """Integer entries by part: arrays of entries x width, of 64-bit or Python integers."""

    entries: list[np.ndarray]
    scale: int = SCALE

    @property
    def width(self) -> int:
        return self.entries[0].shape[1]

    def sha256(self) -> str:
        """Of all entries' components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.entries for x in book.ravel()).encode()).hexdigest()


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers if all are small, else Python's."""
    if not x.size or np.abs(x).max() < SAFE / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([int(v) * scale if abs(v) >= 1 << 53 else floor(v * scale) for v in x.ravel().tolist()], object).reshape(x.shape)


def _narrow(x: np.ndarray) -> bool:
    return x.dtype == np.int64 and x.shape[1] <= NARROW and (not x.size or int(np.abs(x).max()) < SAFE)


def nearest(x: np.ndarray, book: np.ndarray, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of `book` for each row of x, and the squared distance. `seen`, if given, gets the number of
    distances that were evaluated."""
    if not (_narrow(x) and _narrow(book)):
        return _nearest_large(x, book)
    norms = np.sqrt((book * book).sum(1).astype(float))
    order = np.lexsort((np.arange(len(book)), norms))
    ring, inner = norms[order], np.sqrt((x * x).sum(1).astype(float))
    slack = 1e-3  # norms are below 2 ** 31, so their rounding is far smaller

    def distances(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        gap = x[rows] - book[order[places]]
        return (gap * gap).sum(1)

    above = np.minimum(np.searchsorted(ring, inner), len(ring) - 1)
    below = np.maximum(above - 1, 0)
    start = np.where(np.abs(ring[above] - inner) < np.abs(inner - ring[below]), above, below)
    best, index = distances(np.arange(len(x)), start), order[start]
    evaluated = len(x)
    radius = np.sqrt(best.astype(float)) + slack
    low, high = np.searchsorted(ring, inner - radius, "left"), np.searchsorted(ring, inner + radius, "right")
    for step in range(1, len(ring)):
        for place in (start - step, start + step):
            rows = np.flatnonzero((place >= low) & (place < high))
            if not len(rows):
                continue
            evaluated += len(rows)
            d, i = distances(rows, place[rows]), order[place[rows]]
            better = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
            at = rows[better]
            best[at], index[at] = d[better], i[better]
            radius = np.sqrt(best[at].astype(float)) + slack
            low[at], high[at] = np.searchsorted(ring, inner[at] - radius, "left"), np.searchsorted(ring, inner[at] + radius, "right")
    if seen is not None:
        seen.append(evaluated)
    return index, best


def _nearest_large(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() in Python's integers. Roots are rounded down, so the annulus is one wider on each side."""
    square = lambda v: sum(int(c) * int(c) for c in v)
    by_norm = sorted((isqrt(square(e)), i) for i, e in enumerate(book))
    ring = [n for n, _ in by_norm]
    index, best = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for row, part in enumerate(x):
        inner = isqrt(square(part))
        at = min(bisect_left(ring, inner), len(ring) - 1)
        away = lambda place: square([int(a) - int(b) for a, b in zip(part, book[by_norm[place][1]], strict=True)])
        first = (away(at), by_norm[at][1])
        reach = isqrt(first[0]) + 1
        found = [first, *((away(k), by_norm[k][1]) for k in range(bisect_left(ring, inner - reach), bisect_right(ring, inner + reach)) if k != at)]
        best[row], index[row] = min(found)
    return index, best


def _parts(batch: pa.RecordBatch, parts: int, scale: int) -> list[np.ndarray]:
    """The batch's vectors (its column `vector`, all of one length) cut into parts, as whole numbers."""
    column = batch.column(batch.schema.get_field_index("vector"))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return np.split(whole(x, scale), parts, axis=1)


def valid(vectors: DataFrame, vector: str, vec_id: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """vec_id, label, vector of the rows that have a usable vector, and its length: that of the smallest vec_id's."""
    x = F.col("vector")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.select(vectors[vec_id].alias("vec_id"), vectors[label].alias("label"), vectors[vector].alias("vector"))
    kept = kept.filter(x.isNotNull()).filter(usable & (F.size(x) % parts == 0) & (F.size(x) > 0))
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.size(x)).first()
    length = first[0] if first else 0
    return kept.filter(F.size(x) == length), length


def _limbs(value: int) -> list[int]:
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks that start as the vectors of the smallest vec_ids (fewer if there are fewer), moved `rounds` times to the floored means
    of what is nearest to them. kept: vec_id, vector, all of one length."""
    seeds = [r["vector"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()]
    if not seeds:
        return None
    books = Codebooks(np.split(whole(np.array(seeds, float), scale), parts, axis=1), scale)
    schema = "part int, entry int, place int, limb int, total long"
    kind = arrow_schema(schema)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int, int], int] = defaultdict(int)
            for batch in batches:
                if not len(batch):
                    continue
                for p, (x, book) in enumerate(zip(_parts(batch, parts, scale), books.entries, strict=True)):
                    index, _ = nearest(x, book)
                    for e in np.unique(index):
                        own = x[index == e]
                        total[p, int(e), -1] += len(own)
                        for place, value in enumerate(own.sum(0)):
                            total[p, int(e), place] += int(value)
            rows = [(*key, limb, piece) for key, value in total.items() for limb, piece in enumerate(_limbs(value))]
            if rows:
                yield table_rows(dict(zip(kind.names, map(list, zip(*rows, strict=True)), strict=True)), kind)

        added = kept.select("vector").mapInArrow(sums, schema).groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total"))
        found: dict[tuple[int, int, int], int] = defaultdict(int)
        for r in added.collect():  # as large as the codebooks
            found[r["part"], r["entry"], r["place"]] += r["total"] << (LIMB * r["limb"])
        moved = []
        for p, book in enumerate(books.entries):
            rows = [[found[p, e, i] // n for i in range(books.width)] if (n := found.get((p, e, -1))) else book[e].tolist() for e in range(len(book))]
            small = all(abs(v) < SAFE for row in rows for v in row)
            moved.append(np.array(rows, np.int64 if small else object).reshape(len(rows), -1))
        books = Codebooks(moved, scale)
    return books


def assign(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (entries' numbers, a byte each in hex), error (squared distances summed; null beyond a long)."""
    types = dict(kept.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    kind = arrow_schema(schema)
    parts = len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            found = [nearest(x, book) for x, book in zip(_parts(batch, parts, books.scale), books.entries, strict=True)]
            digits = np.stack([i for i, _ in found], 1).astype(np.uint8).tobytes().hex()
            error = [e if e < 1 << 63 else None for e in map(int, sum(d.astype(object) for _, d in found))]
            code = [digits[2 * parts * k : 2 * parts * (k + 1)] for k in range(len(batch))]
            yield table_rows({"vec_id": batch.column(0), "label": batch.column(1), "code": code, "error": error}, kind)

    return kept.select("vec_id", "label", "vector").mapInArrow(run, schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: error summed over equal labels, nulls together (null beyond a long). Sums are pre-aggregated; few labels are
    sent to every task, of many the hot ones, and the others meet their rows by a shuffle."""
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint"))
    sums = stored(coded.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("_n")), "label_sums")
    on = lambda other: coded["label"].eqNullSafe(other["_label"])
    named = sums.withColumnRenamed("label", "_label")
    if sums.count() <= BROADCAST_ROWS:
        return coded.join(F.broadcast(named.drop("_n")), on(named)).drop("_label")
    hot = named.filter(F.col("_n") > HOT_LABEL).drop("_n")
    rest = named.filter(F.col("_n") <= HOT_LABEL).drop("_n")
    one = coded.join(F.broadcast(hot), on(hot)).drop("_label")
    cold = coded.join(F.broadcast(hot.select("_label")), on(hot), "left_anti")
    return one.unionByName(cold.join(rest, cold["label"].eqNullSafe(rest["_label"])).drop("_label"))


def compress(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, code (two hex digits for each part), error, label_error, codebooks_sha256.

    Rows whose vector is null, empty or holds null or non-finite components are dropped; so are those of another length than the
    smallest vec_id's, and lengths that don't divide into parts. With fewer vectors than entries each is an entry. Null vec_ids come
    last among the smallest, ties go by the vector's components. Repeated rows all count. Equal distances go to the lower entry.
    Components of any finite size are exact; errors that don't fit a long are null. An empty table gives no rows. Other columns are
    ignored.
    """
    shared_folder(vectors.sparkSession)
    kept, _ = valid(vectors, vector, vec_id, label, PARTS)
    books = train(kept)
    if books is None:
        empty = kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.filter("false").withColumn("codebooks_sha256", F.lit(""))
    coded = stored(assign(kept, books), "coded")
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
