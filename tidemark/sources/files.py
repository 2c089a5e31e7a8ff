"""Items of a snapshot: its files with size, hash and bytes, what is inside archives, and the folders that hold them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import paths
from tidemark.sources.archives import Limits, archive_kind, expanded
from tidemark.store import keep

ITEMS = "path string, size long, hash string, content binary, container boolean, is_dir boolean, physical string, problem string"
_SNIFF, _CONTROL = 8192, 0.02


def listed(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """path, length, content, physical of the files below a root that aren't excluded."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(where)
    top = status.getPath().toString()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if status.isDirectory() and not fs.getContentSummary(where).getFileCount():
        files = spark.createDataFrame([], "path string, length long, content binary, physical string")
    else:
        raw = reader.load(top if not status.isDirectory() else root)
        cut = len(top.removeprefix("file:").lstrip("/")) if status.isDirectory() else None
        plain = F.ltrim(F.regexp_replace(F.col("_metadata.file_path"), "^file:", ""), F.lit("/")) if top.startswith("file:") else F.col("_metadata.file_path")
        decoded = F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
        relative = F.ltrim(F.substring(decoded, (cut if top.startswith("file:") else len(top)) + 1, 1 << 30), F.lit("/")) if cut is not None else F.lit(status.getPath().getName())
        files = raw.select(relative.alias("path"), "length", "content", F.col("_metadata.file_path").alias("physical"))
    for glob in config.exclude:
        files = files.filter(~paths.matches_glob(F.col("path"), glob))
    return files


ARCHIVE = r"\.(zip|tar|tgz|gz)$"


def closed_archives(spark: SparkSession, left: str, right: str, config: Config) -> tuple[DataFrame | None, DataFrame | None]:
    """Paths of each side's archives that need not be opened, as nothing below them can be told apart or is to be told: those of the
    same path and bytes on both sides and, if renamed ones aren't to be expanded, those whose bytes each side has once."""
    if config.pairs or config.rules:  # may link an archive with another one, to be compared inside
        return None, None
    hashes = lambda root, side: listed(spark, root, config).filter(F.regexp_like(F.lower("path"), F.lit(ARCHIVE))).select(F.lit(side).alias("side"), "path", F.sha2("content", 256).alias("hash"))
    both = keep(hashes(left, "left").unionByName(hashes(right, "right")))
    if not both.take(1):
        return None, None
    same = both.groupBy("path", "hash").agg(F.count("*").alias("n")).filter("n = 2").select("path", "path").toDF("left", "right")
    if not config.expand_renamed:
        once = both.groupBy("hash").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("left", "right")], *[F.min(F.when(F.col("side") == s, F.col("path"))).alias(s) for s in ("left", "right")])
        same = same.unionByName(once.filter("n_left = 1 AND n_right = 1").select("left", "right"))
    same = keep(same)
    return same.select(F.col("left").alias("path")).distinct(), same.select(F.col("right").alias("path")).distinct()


def scan(spark: SparkSession, root: str, config: Config | None = None, closed: DataFrame | None = None) -> DataFrame:
    """path, name, parent, ext, size, hash, content, container, is_dir, physical, problem. A root that is a file has one item.

    Excluded paths are dropped before any hashing. The bytes of files beyond the large-table limit stay where they are. Archives in
    `closed` (path) are items without anything in them.
    """
    config = config or Config()
    files = listed(spark, root, config)
    limits = (config.entry_bytes, config.total_bytes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, data, physical in zip(part["path"], part["content"], part["physical"], strict=True):
                state = Limits(*limits)
                try:
                    found = list(expanded(path, bytes(data), state))
                    problem = f"archive_entry_skipped: {state.skipped}" if state.skipped else None
                except Exception as e:
                    found, problem = [(path, bytes(data), False)], f"rule.expand_failed: {e}"
                for name, content, container in found:
                    rows.append((name, len(content), hashlib.sha256(content).hexdigest(), content, container, False, physical, problem if name == path else None))
            yield pd.DataFrame(rows, columns=["path", "size", "hash", "content", "container", "is_dir", "physical", "problem"])

    archive = F.regexp_like(F.lower("path"), F.lit(ARCHIVE))
    large = F.col("length") > config.large_table_bytes
    files = files.withColumn("closed", F.lit(False)) if closed is None else files.join(closed.withColumn("closed", F.lit(True)), "path", "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    plain = files.filter(~archive | F.col("closed")).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.when(~large, F.col("content")).alias("content"), F.col("closed").alias("container"), F.lit(False).alias("is_dir"), "physical", F.lit(None).cast("string").alias("problem"))
    inside = files.filter(archive & ~F.col("closed")).select("path", "content", "physical").mapInPandas(run, ITEMS)
    for glob in config.exclude:
        inside = inside.filter(~paths.matches_glob(F.col("path"), glob))
    items = plain.unionByName(inside)
    parts = F.split("path", "/")
    above = items.filter(F.contains("path", F.lit("/"))).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).distinct()
    folders = above.join(items.filter("container").select("path"), "path", "left_anti")
    empty = {"size": "long", "hash": "string", "content": "binary", "physical": "string", "problem": "string"}
    folders = folders.select("path", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], F.lit(False).alias("container"), F.lit(True).alias("is_dir"))
    out = items.unionByName(folders)
    c = F.col("path")
    return out.withColumns({"name": paths.file_name(c), "parent": paths.parent_path(c), "ext": paths.extension(c)})


def looks_like_text(data: bytes, cut: bool = False) -> bool:
    """No NUL, UTF-8 (a character may be cut off at the end), few control characters."""
    data = data[:_SNIFF]
    if not data or b"\0" in data:
        return False
    for drop in range(4 if cut or len(data) == _SNIFF else 1):
        try:
            text = data[: len(data) - drop].decode("utf-8")
            break
        except UnicodeDecodeError:
            continue
    else:
        return False
    return sum(c < " " and c not in "\t\n\r\f" for c in text) <= _CONTROL * len(text)


def is_archive(path: str) -> bool:
    return archive_kind(path) is not None
