"""Tables of files: what is one, how it is parsed, and a single file's tables as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import plugins
from tidemark.config import PathConfig
from tidemark.operators.order import ROW
from tidemark.sources import large
from tidemark.sources.delimited import rows_of, sniff, stacked, with_header
from tidemark.sources.formats import tables as binary_tables
from tidemark.sources.large import DELIMITED
from tidemark.sources.records import json_table

JSON = {".json", ".jsonl", ".ndjson", ".geojson"}
BINARY = {".sqlite", ".sqlite3", ".db", ".parquet", ".arrow", ".feather", ".ipc", ".xlsx", ".xlsm", ".ods", ".avro", ".dta", ".sas7bdat", ".dbf", ".xpt"}
CONTAINERS = {".sqlite", ".sqlite3", ".db", ".xlsx", ".xlsm", ".ods", ".xpt"}


@dataclass
class Table:
    name: str
    columns: list[str]
    df: DataFrame
    meta: dict = field(default_factory=dict)
    inferred_dialect: bool = False


def is_tabular(ext: str, config: PathConfig, own: dict | None = None) -> bool:
    return ext in (plugins.PARSERS if own is None else own) or ext in DELIMITED | JSON | BINARY or config.content_type in ("text/csv", "text/tab-separated-values") or bool(config.dialect.get("delimiter"))


def parse_file(data: bytes, path: str, ext: str, config: PathConfig, own: dict) -> list[tuple[str, list[str], list[list[str | None]], dict, bool]]:
    """(name, columns, rows, metadata, dialect was inferred) of each table of a file; none if it is no table."""
    if ext in own:
        return [(name, columns, found, {}, False) for name, columns, found in own[ext](data)]
    if ext in BINARY:
        return [(name, columns, found, {}, False) for name, columns, found in binary_tables(data, ext) or []]
    if ext in JSON:
        found = json_table(data, path, config.records_path)
        return [("", *found, False)] if found else []
    dialect = sniff(data, path, config.dialect)
    raw = rows_of(data.decode("utf-8-sig", "replace"), dialect)
    regions = stacked(raw) if config.has_header and not config.header_line and not config.skip_lines else []
    if regions:
        return [(f"table_{i}", *with_header(raw[a:b], PathConfig()), {}, dialect.inferred) for i, (a, b) in enumerate(regions, 1)]
    return [("", *with_header(raw, config), {}, dialect.inferred)]


def read_tables(items: DataFrame, path: str, ext: str, physical: str | None, config: PathConfig) -> list[Table]:
    """The tables of an item. Its bytes are parsed where they are; a file too large to be held as an item is cut (sources.large)."""
    parsers = {k: v for k, v in plugins.PARSERS.items() if k == ext}  # goes along to the executors
    row = items.filter(F.col("path") == path).select("content").withColumn("held", F.col("content").isNotNull())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                for name, columns, found, meta, inferred in parse_file(bytes(content), path, ext, config, parsers):
                    head = [(name, -1, list(columns), json.dumps([meta, inferred]))]
                    yield pd.DataFrame(head + [(name, i, list(r), None) for i, r in enumerate(found)], columns=["table", ROW, "cells", "meta"])

    if not row.select("held").first()["held"]:
        found, tables = large.read_large(items.sparkSession, [f for f in [large.File(0, "", path, ext, physical, config)] if f.kind])
        at = lambda t: found.filter(F.col("name") == t.name).select(ROW, *[F.try_element_at("cells", F.lit(i + 1)).alias(c) for i, c in enumerate(t.columns)])
        return [Table(t.name, t.columns, at(t), {}, t.inferred) for t in tables.get((0, ""), [])]
    parsed = row.select("content").mapInPandas(run, f"table string, {ROW} long, cells array<string>, meta string").cache()
    out = []
    for head in parsed.filter(f"{ROW} = -1").orderBy("table").collect():
        meta, inferred = json.loads(head["meta"])
        cells = [F.try_element_at("cells", F.lit(i + 1)).alias(c) for i, c in enumerate(head["cells"])]
        out.append(Table(head["table"], list(head["cells"]), parsed.filter((F.col("table") == head["table"]) & (F.col(ROW) >= 0)).select(ROW, *cells), meta, inferred))
    return out
