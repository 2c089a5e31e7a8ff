"""What the text operators share: tables in the shared folder, ranks and running sums without a single task, and hashed words."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import store

#: Bytes of text that one numpy step handles; a longer text is a step of its own.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 8 << 20
#: Rows that a bucket of `running` and `ranked` should hold, and bits of a bucket's number at least and at most: the sums of a group's
#: buckets are added up in one task, so they stay few beside the rows.
BUCKET_ROWS, LEAST_BITS, MOST_BITS = 200, 6, 22
KEY_BITS = 62


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- tables in the shared folder -------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir (see store); texts are long, so batches of rows go by their bytes from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return store.shared_folder(spark)


def drop_table(spark: SparkSession, path: str) -> None:
    store.drop(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back: lineage ends here and lost executors lose nothing.

    `.tidemark_path` of the result is its folder; it goes when Python ends, or earlier with drop_table().
    """
    shared_folder(df.sparkSession)
    return store.keep(df, name)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


#: Rows of ids, with a number each at most, that are sent to the executors; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, name: str) -> DataFrame:
    """df, stored, with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


# --- order without a single task ------------------------------------------------------------------------------------


def key_of(*columns: Column | str) -> Column:
    """A 62-bit number that is at least 0, evenly spread."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - KEY_BITS)


def bucket_bits(rows: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, rows / BUCKET_ROWS))), LEAST_BITS, MOST_BITS))


def running(df: DataFrame, group: list[str], key: Column, ties: list[Column], value: Column, rows: int, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same group that come before this one by (key, ties).

    The key's top bits make buckets of a bounded number of rows. Bucket sums are added up over the few buckets of a group,
    so no task sees a whole group, however hot. Columns in `group` must not be null.
    """
    bits = bucket_bits(rows)
    df = df.withColumns({"_key": key, "_value": value}).withColumn("_bucket", F.shiftright(F.col("_key"), KEY_BITS - bits))
    by = [*group, "_bucket"]
    sums = df.groupBy(*by).agg(F.sum("_value").alias("_sum"))
    w = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*by).orderBy("_key", *ties).rowsBetween(Window.unboundedPreceding, -1)
    df = df.join(sums.hint("shuffle_merge"), by)
    return df.withColumn(out, F.col("_before") + F.coalesce(F.sum("_value").over(w), F.lit(0))).drop("_key", "_value", "_bucket", "_before")


def ranked(df: DataFrame, group: list[str], key: Column, ties: list[Column], rows: int, out: str) -> DataFrame:
    """Adds `out`: the row's place in its group by (key, ties), from 0 without gaps."""
    return running(df, group, key, ties, F.lit(1).cast("long"), rows, out)


# --- texts in Arrow batches -----------------------------------------------------------------------------------------


def worker_state() -> dict:
    """A dict that lives as long as the Python worker."""
    return sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Splits batches so that the texts of each part take about `size` bytes: (part, UTF-8 bytes, n + 1 offsets). A null text is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        if not len(column):
            continue
        if column.null_count:
            column = column.fill_null(b"")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + size, "right")) - 1)
            yield batch.slice(a, b - a), data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            a = b
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


#: Bytes whose words are hashed at a time: what that takes (some 40 bytes for each) doesn't grow with a text.
HASHED_BYTES = SLICE_BYTES


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """HASHED_BYTES + 1 powers of an odd base and of its inverse modulo 2 ** 64."""
    state = worker_state()
    if "powers" not in state:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            with np.errstate(over="ignore"):
                out.append(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(HASHED_BYTES, base, np.uint64))]))
        state["powers"] = tuple(out)
    return state["powers"]


def _run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes of the runs from starts to ends, part by part; a run that is longer than a part is hashed in pieces."""
    power, inverse = _powers()
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + HASHED_BYTES, "right")))
        high = int(ends[j - 1])
        if high - low <= HASHED_BYTES:
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(table[data[low:high]] * power[: high - low], out=sums[1:])
            out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * inverse[starts[i:j] - low]
        else:
            shift = np.uint64(1)
            for a in range(low, high, HASHED_BYTES):
                part = table[data[a : min(high, a + HASHED_BYTES)]]
                out[i] += (part * power[: len(part)]).sum(dtype=np.uint64) * shift
                shift *= power[HASHED_BYTES]
        i = j
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, separator: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts in `data`: 64-bit hashes, first bytes, ends, and n + 1 offsets into these by text.

    Words are runs of bytes outside `separator`; A-Z counts as a-z if `lower`. Texts end words.
    """
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    edges = inside[1:] != inside[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    cut = bounds[(inside[bounds] == 1) & (inside[bounds + 1] == 1)]  # a word would run over the end of a text
    at = np.flatnonzero(edges)
    if len(cut):
        cut = np.repeat(np.unique(cut), 2)
        at = np.insert(at, np.searchsorted(at, cut), cut)
    starts, ends = at[::2], at[1::2]
    table = mix64(np.arange(1, 257, dtype=np.uint64))
    if lower:
        table[65:91] = table[97:123]
    with np.errstate(over="ignore"):
        hashes = mix64(_run_hashes(data, starts, ends, table) + (ends - starts).astype(np.uint64))
    return hashes, starts, ends, np.searchsorted(starts, offsets, "left")


#: Windows of more numbers are hashed by running sums.
SUMMED_WINDOW = 8


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive numbers."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    if k <= SUMMED_WINDOW:
        for j in range(k):
            out += hashes[j : j + n] * np.uint64(pow(_BASE, 2 * j + 3, 1 << 64))
        return mix64(out)
    power, inverse = _powers()  # the same by differences of running sums, part by part
    power, inverse, first = power[::2], inverse[::2], np.uint64(pow(_BASE, 3, 1 << 64))
    step = len(power) - k
    for a in range(0, n, step):
        part = hashes[a : min(a + step, n) + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        here = len(part) - k + 1
        out[a : a + here] = (sums[k:] - sums[:-k]) * inverse[:here] * first
    return mix64(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table_rows(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in columns.items()], schema=schema)


def arrow_schema(spark_schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(spark_schema))


def map_text(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, object]], text: str = "text") -> DataFrame:
    """Applies step(part, bytes, offsets) -> columns to the texts of df, part by part, as an Arrow map without a shuffle."""
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield table_rows(step(*part), kind)

    return df.mapInArrow(run, schema)
