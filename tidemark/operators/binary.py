"""Differences of bytes: chunks whose ends the content sets, and printable strings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LEAST, USUAL, MOST = 4 << 10, 16 << 10, 64 << 10
WINDOW = 48
REGIONS, STRINGS = 32, 32
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 8 << 20


def chunk_ends(data: bytes) -> list[int]:
    """Ends of content-defined chunks: where a rolling sum of hashed bytes has its low bits zero, between LEAST and MOST apart."""
    if not data:
        return []
    table = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    sums = np.cumsum(table[np.frombuffer(data, np.uint8)] >> np.uint64(8), dtype=np.uint64)
    rolled = sums.copy()
    rolled[WINDOW:] -= sums[:-WINDOW]
    marks = np.flatnonzero((rolled * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - USUAL.bit_length() + 1) == 0) + 1
    out, start = [], 0
    while start < len(data):
        at = int(np.searchsorted(marks, start + LEAST))
        end = int(marks[at]) if at < len(marks) else len(data)
        start = min(end, start + MOST, len(data))
        out.append(start)
    return out


def chunks(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, digest)."""
    ends = chunk_ends(data)
    return [(a, b, hashlib.sha256(data[a:b]).hexdigest()) for a, b in zip([0, *ends], ends, strict=False)]


def changed_regions(a: bytes, b: bytes) -> dict:
    """Regions of both that no equal chunks cover, walking both in order; sizes, unchanged bytes and their share."""
    x, y = chunks(a), chunks(b)
    places: dict[str, list[int]] = {}
    for j, (_, _, digest) in enumerate(y):
        places.setdefault(digest, []).append(j)
    matched, last = [], -1
    for i, (_, _, digest) in enumerate(x):
        j = next((j for j in places.get(digest, ()) if j > last), None)
        if j is not None:
            matched.append((i, j))
            last = j
    unchanged = sum(x[i][1] - x[i][0] for i, _ in matched)
    regions, at_a, at_b = [], 0, 0
    for i, j in [*matched, (None, None)]:
        to_a, to_b = (x[i][0], y[j][0]) if i is not None else (len(a), len(b))
        if to_a > at_a or to_b > at_b:
            regions.append((at_a, to_a, at_b, to_b))
        if i is not None:
            at_a, at_b = x[i][1], y[j][1]
    return {"left_size": len(a), "right_size": len(b), "unchanged": unchanged, "share": 2 * unchanged / max(1, len(a) + len(b)), "regions": regions}


_ASCII = re.compile(rb"[\x20-\x7e]{4,}")
_WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){4,}")


def strings(data: bytes) -> set[str]:
    """Printable runs of four characters or more, one or two bytes each."""
    return {m[0].decode("ascii") for m in _ASCII.finditer(data)} | {m[0][::2].decode("ascii") for m in _WIDE.finditer(data)}


def string_count(a: bytes, b: bytes) -> tuple[int, int]:
    """How many of strings() only b has, and only a."""
    x, y = strings(a), strings(b)
    return len(y - x), len(x - y)


def string_changes(a: bytes, b: bytes) -> tuple[list[str], list[str]]:
    """(added, removed), sorted, the first STRINGS of each."""
    x, y = strings(a), strings(b)
    return sorted(y - x)[:STRINGS], sorted(x - y)[:STRINGS]


def byte_changes(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: by, l, r (binary). Sizes, unchanged bytes, number of changed regions, strings added and removed. A null side is empty."""
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", left_size long, right_size long, unchanged long, regions long, strings_added array<string>, strings_removed array<string>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for a, b in zip(part["l"], part["r"], strict=True):
                a, b = bytes(a or b""), bytes(b or b"")
                found, (added, removed) = changed_regions(a, b), string_changes(a, b)
                rows.append((found["left_size"], found["right_size"], found["unchanged"], len(found["regions"]), added, removed))
            out = part[by].copy()
            for name, values in zip(["left_size", "right_size", "unchanged", "regions", "strings_added", "strings_removed"], zip(*rows, strict=True) if rows else [[]] * 6, strict=True):
                out[name] = list(values)
            yield out

    return pairs.select(*by, "l", "r").mapInPandas(run, schema)


def string_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: by, l, r (binary). by, added, removed: how many printable runs only one side has. A null side is empty.

    A task holds the runs of one pair at a time, and the bytes of a batch, which Spark cuts by rows and, from here on, by size."""
    pairs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", added long, removed long"

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [string_count(a.as_py() or b"", b.as_py() or b"") for a, b in zip(batch.column(len(by)), batch.column(len(by) + 1), strict=True)]
            added, removed = zip(*counts, strict=True) if counts else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], pa.array(added, pa.int64()), pa.array(removed, pa.int64())], schema=kind)

    return pairs.select(*by, "l", "r").mapInArrow(run, schema)
