"""Tables in files that are too large for one task: delimited text, JSON Lines, arrays of JSON objects and Parquet, cut exactly.

Spark's text reader cuts a file at line ends (for an array: at closing braces), wherever they are. Whether such a place ends a record
depends on all text before it, but only through a small state: whether a quote is open, and for JSON how deep the place is. So a first
pass tells for each part of a file how it changes the state, for each state that it may be entered in; composing these gives each part
its state; and a second pass cuts its records. A record that crosses a border is put together from its pieces.

Records are parsed by the same functions as those of small files, so a table is the same whichever way it was read.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import PathConfig
from tidemark.operators.documents import parse
from tidemark.operators.order import ROW
from tidemark.operators.regions import FEWEST, LEAST_ROWS, MOST
from tidemark.operators.schema import complete_headers
from tidemark.sources.delimited import SAMPLE, Dialect, rows_of, sniff
from tidemark.sources.formats import _cell
from tidemark.sources.records import tagged
from tidemark.store import keep, local

DELIMITED = {".csv", ".tsv", ".tab"}
FOUND = "kind string, file string, start long, seq long, rank long, width int, names array<string>, cells array<string>, body string"
#: Rows that are handed on together.
HANDED = 20_000
#: Places of headers that are looked up by place.
PLACES = 100


@dataclass
class File:
    """A large file: where it is, how it is cut, and for delimited text its dialect."""

    id: int
    side: str
    path: str
    ext: str
    physical: str
    config: PathConfig
    kind: str = ""  # delimited, lines, array, parquet
    dialect: Dialect | None = None

    def __post_init__(self):
        if self.ext in DELIMITED or self.config.dialect.get("delimiter") or self.config.content_type in ("text/csv", "text/tab-separated-values"):
            self.kind = "delimited"
        elif self.ext in (".jsonl", ".ndjson"):
            self.kind = "lines"
        elif self.ext == ".json" and not self.config.records_path:
            self.kind = "array"
        elif self.ext == ".parquet":
            self.kind = "parquet"


@dataclass
class LargeTable:
    name: str
    columns: list[str]
    rows: int
    inferred: bool = False


def reader_paths(physical: list[str]) -> list[str]:
    """Paths of files as the reader takes them: not encoded, and without patterns."""
    return [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(p)) for p in physical]


def _text(spark: SparkSession, files: list[File], separator: str) -> DataFrame:
    read = spark.read.option("lineSep", separator).text(reader_paths([f.physical for f in files]))
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start, values) of each run of a batch's rows that are of one part of a file, in order."""
    for b in batches:
        file, start, n = b.column(0), b.column(1), len(b)
        if not n:
            continue
        differ = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(start.slice(1), start.slice(0, n - 1)))
        cuts = [0, *(np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield file[i].as_py(), start[i].as_py(), b.column(2).slice(i, j - i)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[pa.Array]]]:
    """(file, start, arrays of values) of each part of a file, in order. Arrays must be used up before the next part."""
    found = _stretches(batches)
    held = next(found, None)
    while held:
        file, start, _ = held

        def values() -> Iterator[pa.Array]:
            nonlocal held
            while held and held[:2] == (file, start):  # noqa: B023
                yield held[2]
                held = next(found, None)

        yield file, start, values()


def _each(arrays: Iterator[pa.Array]) -> Iterator[bytes]:
    return (v for a in arrays for v in a.to_pylist())


# --- how text changes the state ----------------------------------------------------------------------------------------------


def _lines(value: bytes, first: bool) -> list[str]:
    """A line, with its end; lines that end in a lone carriage return are lines too."""
    line = value.decode("utf-8-sig" if first else "utf-8", "replace") + "\n"
    return [line] if "\r" not in line[:-2] else list(io.StringIO(line, newline=""))


def _left_open(text: str, dialect: Dialect) -> bool:
    """Whether a record that starts with this line goes on in the next one."""
    asked = False
    csv.field_size_limit(1 << 30)

    def lines() -> Iterator[str]:
        nonlocal asked
        yield text
        asked = True

    next(csv.reader(lines(), delimiter=dialect.delimiter, quotechar=dialect.quote, escapechar=dialect.escape, doublequote=dialect.escape is None, strict=False), None)
    return asked


def delimited_state(line: str, inside: bool, dialect: Dialect) -> bool:
    """Whether a quoted cell is open after the line."""
    if dialect.quote not in line:
        return inside
    return _left_open(dialect.quote + line if inside else line, dialect)


_ESCAPED, _STRING = re.compile(r"\\."), re.compile(r'"[^"]*"')


def json_state(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after the piece and the brace behind it, and by how much the depth changes."""
    bare = _STRING.sub("", ('"' if inside else "") + _ESCAPED.sub("", piece))
    opened = '"' in bare
    bare = bare.partition('"')[0]
    depth = bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
    return opened, depth if opened else depth - 1


def _changes(text: DataFrame, files: dict[str, File]) -> dict[str, list[tuple]]:
    """By file, for each part: (start, change of state if entered outside of quotes, and inside)."""
    kinds = {k: (f.kind, f.dialect) for k, f in files.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, values in _parts(batches):
            kind, dialect = kinds[file]
            states, depths = [False, True], [0, 0]
            for n, value in enumerate(_each(values)):
                if kind == "array":
                    piece = value.decode("utf-8", "replace")
                    after = {s: json_state(piece, s) for s in set(states)}
                    depths = [d + after[s][1] for d, s in zip(depths, states, strict=True)]
                    states = [after[s][0] for s in states]
                    continue
                for line in _lines(value, not start and not n):
                    if states[0] == states[1]:
                        states = [delimited_state(line, states[0], dialect)] * 2
                    else:
                        states = [delimited_state(line, s, dialect) for s in states]
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "body": json.dumps([states, depths])}])

    out: dict[str, list[tuple]] = defaultdict(list)
    for r in text.mapInArrow(run, "file string, start long, body string").collect():  # a row for each part of a file
        out[r["file"]].append((r["start"], *json.loads(r["body"])))
    return {k: sorted(v) for k, v in out.items()}


def _quoting(text: DataFrame, files: list[File]) -> list[File]:
    """The files of which a line may change the state: all but JSON Lines and delimited files without any quote."""
    quotes = sorted({f.dialect.quote for f in files if f.kind == "delimited"})
    found = set()
    if quotes:
        some = text.filter(reduce(or_, (F.contains("value", F.lit(q.encode())) for q in quotes))).select("file").distinct()
        found = {r["file"] for r in some.collect()}  # a row for each file
    return [f for f in files if f.kind == "array" or (f.kind == "delimited" and f.physical in found)]


def entry_states(changes: dict[str, list[tuple]]) -> dict[tuple[str, int], tuple[bool, int]]:
    """(inside of quotes, depth) at the start of each part."""
    out = {}
    for file, parts in changes.items():
        inside, depth = False, 0
        for start, states, depths in parts:
            out[file, start] = inside, depth
            inside, depth = states[inside], depth + depths[inside]
    return out


# --- records ----------------------------------------------------------------------------------------------------------------------


def _json_record(text: str) -> tuple[list[str], list[str | None]]:
    value = parse(text)
    if not isinstance(value, dict):
        raise ValueError("not an object")
    return list(value), [tagged(v) for v in value.values()]


def _width(cells: list[str]) -> int:
    n = len(cells)
    while n and not cells[n - 1].strip():
        n -= 1
    return n


def _parser(kind: str, dialect: Dialect | None) -> Callable[[str], tuple[list[str] | None, list[str | None]]]:
    def cells(text: str) -> tuple[None, list[str | None]]:
        if dialect.quote not in text and not dialect.escape:
            text = text.rstrip("\r\n")
            return None, text.split(dialect.delimiter) if text else []
        return None, next(iter(rows_of(text, dialect)), [])

    return cells if kind == "delimited" else _json_record


def plain_records(values: pa.Array, dialect: Dialect) -> tuple[pa.Array, np.ndarray, pa.Array] | None:
    """Lines without their ends, their widths and numbers of cells, if each line is a record that is only to be split at its delimiters;
    else None."""
    try:
        text = values.cast(pa.string())
    except pa.ArrowInvalid:  # no UTF-8
        return None
    has = lambda a, what: pc.any(pc.match_substring(a, what)).as_py()
    if dialect.escape or has(text, dialect.quote):
        return None
    if has(text, "\r"):
        cut = pc.utf8_rtrim(text, "\r")
        if has(cut, "\r") or pc.max(pc.subtract(pc.binary_length(text), pc.binary_length(cut))).as_py() > 1:
            return None
        text = cut
    if pc.min(pc.binary_length(text)).as_py() == 0:  # a blank line has no cells
        return None
    cells = pc.add(pc.count_substring(text, dialect.delimiter), 1)
    widths = cells.to_numpy(zero_copy_only=False).copy()
    full = pc.and_not(pc.match_substring_regex(text, "[!-~]$"), pc.ends_with(text, dialect.delimiter))  # the last cell isn't blank
    for i in np.flatnonzero(~full.to_numpy(zero_copy_only=False)).tolist():
        widths[i] = _width(text[i].as_py().split(dialect.delimiter))
    return text, widths, cells


def _runs_of(widths: np.ndarray, seq: int) -> Iterator[tuple[int, int, int, int]]:
    """(width, first place, end, number) of the runs of rows of one width; rows without any end no run."""
    at = np.flatnonzero(widths)
    own = widths[at]
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(at)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            yield int(own[i]), seq + int(at[i]), seq + int(at[j - 1]) + 1, j - i


def _records(text: DataFrame, files: dict[str, File], states: dict[tuple[str, int], tuple[bool, int]]) -> DataFrame:
    """Kept rows of FOUND: `row` (seq: its place among the records that start in the part, rank: among those that aren't empty, width: number of its cells,
    body: its line, if that is only to be split), `open` and `tail` (body: pieces of a record over a border), and for each part `part` (seq and rank: how many; names; body: runs of widths)."""
    kinds = {k: (f.kind, f.dialect) for k, f in files.items()}

    def of_part(file: str, start: int, arrays: Iterator[pa.Array]) -> Iterator[tuple | pa.RecordBatch]:
        kind, dialect = kinds[file]
        read = _parser(kind, dialect)
        inside, depth = states.get((file, start), (False, 0))
        tail = inside or (kind == "array" and depth > 1)
        held: list[str] = []
        seq = rank = 0
        names: dict[str, None] = {}
        runs: list[list[int]] = []

        def ended() -> tuple | None:
            nonlocal seq, rank, tail
            text = "".join(held)
            held.clear()
            if tail:
                tail = False
                return ("tail", file, start, None, None, None, None, None, text)
            own, cells = read(text.lstrip(" \t\r\n,[﻿") if kind == "array" else text)
            names.update(dict.fromkeys(own or ()))
            if kind == "delimited" and (w := _width(cells)):
                noted(w, seq, seq + 1, 1)
            out = ("row", file, start, seq, rank if cells or own is not None else None, len(cells), own, cells, None)
            seq, rank = seq + 1, rank + (out[4] is not None)
            return out

        def noted(w: int, first: int, end: int, n: int) -> None:
            if len(runs) > MOST + 1:
                return
            if runs and runs[-1][0] == w:
                runs[-1][2:] = [end, runs[-1][3] + n]
            else:
                runs.append([w, first, end, n])

        def lines() -> Iterator[bytes | pa.Array]:
            """Lines; where records neither cross them nor need a parser, many at once."""
            first = not start
            for values in arrays:
                if first:
                    yield values[0].as_py()
                    values, first = values.slice(1), False
                if len(values) and kind == "delimited" and not (inside or held or tail) and (found := plain_records(values, dialect)):
                    yield found
                else:
                    yield from values.to_pylist()

        for n, value in enumerate(lines()):
            if isinstance(value, tuple):
                text, widths, cells = value
                for run in _runs_of(widths, seq):
                    noted(*run)
                many = len(text)
                none = lambda t: pa.nulls(many, t)  # noqa: B023, E731
                place = lambda at: pa.array(np.arange(at, at + many))  # noqa: B023, E731
                same = lambda x: pa.repeat(x, many)  # noqa: B023, E731
                columns_ = [same("row"), same(file), same(start), place(seq), place(rank), cells, none(pa.list_(pa.string())), none(pa.list_(pa.string())), text]
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns_, kinds_of, strict=True)], names=columns)
                seq, rank = seq + many, rank + many
                continue
            if kind == "array":
                piece = value.decode("utf-8", "replace")
                at = depth
                inside, change = json_state(piece, inside)
                depth += change
                if at == 1 and not held and not tail and piece.strip() == "]":
                    continue  # the end of the array
                held.append(piece + "}")
                if depth == 1 and not inside:
                    yield ended()
                continue
            for line in _lines(value, not start and not n):
                inside = delimited_state(line, inside, dialect) if dialect else False
                held.append(line)
                if inside:
                    continue
                if dialect is None and not line.strip():
                    held.clear()  # blank lines of JSON Lines are none
                    continue
                yield ended()
        if held and not (kind == "array" and depth < 1):
            if tail:
                yield ("tail", file, start, None, None, None, None, None, "".join(held))
            else:
                yield ("open", file, start, seq, rank, None, None, None, "".join(held))
                seq, rank = seq + 1, rank + 1
        yield ("part", file, start, seq, rank, None, list(names), None, json.dumps(runs))

    kinds_of = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    columns = ["kind", "file", "start", "seq", "rank", "width", "names", "cells", "body"]
    handed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_of, strict=True)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for file, start, values in _parts(batches):
            try:
                for row in of_part(file, start, values):
                    if isinstance(row, pa.RecordBatch):
                        yield row
                        continue
                    rows.append(row)
                    if len(rows) >= HANDED:
                        yield handed(rows)
                        rows = []
            except (ValueError, csv.Error) as e:
                rows.append(("bad", file, start, None, None, None, None, None, str(e)))
                for _ in values:
                    pass
        if rows:
            yield handed(rows)

    return keep(text.mapInArrow(run, FOUND), "records")


def _joined(found: DataFrame, offsets: DataFrame, files: dict[str, File]) -> DataFrame:
    """file, raw, rank, names, cells of the records over borders. A tail belongs to the record that was open before its part."""
    kinds = {k: (f.kind, f.dialect) for k, f in files.items()}
    pieces = found.filter(F.col("kind").isin("open", "tail")).join(offsets, ["file", "start"])
    raw = F.when(F.col("kind") == "open", F.col("raw_before") + F.col("seq")).otherwise(F.col("raw_before") - 1)
    place = F.when(F.col("kind") == "open", F.col("rank_before") + F.col("rank")).otherwise(F.col("rank_before") - 1)
    whole = pieces.select("file", "start", raw.alias("raw"), place.alias("rank"), "body").groupBy("file", "raw", "rank").agg(F.sort_array(F.collect_list(F.struct("start", "body"))).alias("p"))
    schema = "file string, raw long, rank long, names array<string>, cells array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                kind, dialect = kinds[r["file"]]
                text = "".join(r["texts"])
                names, cells = _parser(kind, dialect)(text.lstrip(" \t\r\n,[﻿") if kind == "array" else text)
                rows.append((r["file"], r["raw"], r["rank"], names, cells))
            if rows:
                kinds_of = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_of, strict=True)], names=["file", "raw", "rank", "names", "cells"])

    return whole.select("file", "raw", "rank", F.transform("p", lambda x: x["body"]).alias("texts")).mapInArrow(run, schema)


# --- tables ---------------------------------------------------------------------------------------------------------------------------


def _regions(parts: list[tuple[int, list]]) -> list[tuple[int, int]]:
    """(first, end) raw places of stacked tables, from the runs of widths of all parts: (raw_before, runs) in order."""
    whole: list[list[int]] = []
    for before, runs in parts:
        for w, first, end, n in runs:
            if whole and whole[-1][0] == w:
                whole[-1][2:] = [before + end, whole[-1][3] + n]
            else:
                whole.append([w, before + first, before + end, n])
        if len(whole) > MOST:
            return []
    return [(a, b) for _, a, b, _ in whole] if FEWEST <= len(whole) and all(n > LEAST_ROWS for *_, n in whole) else []


def _sniffed(spark: SparkSession, files: list[File]) -> dict[str, bytes]:
    """The first bytes of each file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out = {}
    for f in files:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f.physical))
        stream, codec = where.getFileSystem(conf).open(where), codecs.getCodec(where)  # the text reader unpacks by the same codecs
        stream = codec.createInputStream(stream) if codec else stream
        try:
            out[f.physical] = bytes(stream.readNBytes(4 * SAMPLE))
        finally:
            stream.close()
    return out


def _text_tables(spark: SparkSession, files: list[File], separator: str) -> tuple[list[DataFrame], dict[tuple[int, str], list[LargeTable]]]:
    by_path = {f.physical: f for f in files}
    text = _text(spark, files, separator)
    quoting = {f.physical: f for f in _quoting(text, files)}
    found = _records(text, by_path, entry_states(_changes(_text(spark, list(quoting.values()), separator), quoting)) if quoting else {})
    parts: dict[str, list] = defaultdict(list)
    bad = set()
    for r in found.filter(F.col("kind").isin("part", "bad")).select("kind", "file", "start", "seq", "rank", "names", "body").collect():  # a row for each part
        parts[r["file"]].append(r)
        if r["kind"] == "bad":
            bad.add(r["file"])
    offsets, totals = [], {}
    for path, own in parts.items():
        raw = rank = 0
        for r in sorted(own, key=lambda r: r["start"]):
            offsets.append((path, r["start"], raw, rank, re.escape(by_path[path].dialect.delimiter) if by_path[path].dialect else None))
            raw, rank = raw + (r["seq"] or 0), rank + (r["rank"] or 0)
        totals[path] = rank
    before = local(spark, offsets, "file string, start long, raw_before long, rank_before long, cut string")
    crossed = keep(_joined(found, before, by_path).filter(~F.col("file").isin(sorted(bad))), "crossed")
    cells = F.coalesce("cells", F.split("body", F.col("cut")))
    within = found.filter("kind = 'row'").join(before, ["file", "start"]).select("file", "seq", (F.col("raw_before") + F.col("seq")).alias("raw"), (F.col("rank_before") + F.col("rank")).alias("rank"), "width", "names", cells.alias("cells"))
    records = within.unionByName(crossed.withColumns({"width": F.size("cells"), "seq": F.lit(None).cast("long")})).filter("rank IS NOT NULL")
    seams = defaultdict(list)
    for r in crossed.select("file", "raw", "names", "cells").collect() if any(len(p) > 1 for p in parts.values()) else []:  # at most one for each border
        seams[r["file"]].append(r)
    start_of = {(p, s): (raw, rank) for p, s, raw, rank, _ in offsets}
    # what of each file is a table: raw places, and where its header is
    wanted: list[tuple] = []  # file, table, first raw, end raw, raw place of the header (or -1)
    for path, own in parts.items():
        f = by_path[path]
        if path in bad or f.kind != "delimited":
            continue
        c = f.config
        runs = [(start_of[path, r["start"]][0], json.loads(r["body"])) for r in own]
        runs += [(r["raw"], [[_width(r["cells"]), 0, 1, 1]]) for r in seams[path] if _width(r["cells"])]
        regions = _regions(sorted(runs, key=lambda x: x[0] + (x[1][0][1] if x[1] else 0))) if c.has_header and not c.header_line and not c.skip_lines else []
        if regions:
            wanted += [(path, f"table_{i}", a, b, a) for i, (a, b) in enumerate(regions, 1)]
        else:
            header = c.skip_lines + c.header_line - 1 if c.header_line else c.skip_lines if c.has_header else -1
            wanted.append((path, "", header + 1 if header >= 0 else c.skip_lines, 1 << 62, header))
    frames: list[DataFrame] = []
    tables: dict[tuple[int, str], list[LargeTable]] = defaultdict(list)
    if wanted:
        spec = local(spark, [(by_path[w[0]].id, by_path[w[0]].side, *w) for w in wanted], "id int, side string, file string, name string, first long, end long, header long")
        met = records.join(spec, "file").filter((F.col("raw") >= F.least("first", "header")) & (F.col("raw") < F.col("end")))
        body = (F.col("raw") >= F.col("first")) & (F.col("raw") != F.col("header"))
        facts = met.groupBy("file", "name").agg(F.max(F.when(body, F.col("width"))).alias("width"), F.min(F.when(body, F.col("rank"))).alias("low"), F.count_if(body).alias("n"))
        lows = []
        shapes = {(r["file"], r["name"]): r for r in facts.collect()}
        places = {raw - before for path, _, _, _, raw in wanted for p, _, before, *_ in offsets if p == path and before <= raw}  # within their parts, so that few are read
        few = F.col("seq").isNull() | F.col("seq").isin(sorted(places)) if len(places) <= PLACES else F.lit(True)
        headers = {(r["file"], r["name"]): r["cells"] for r in met.filter(few & (F.col("raw") == F.col("header"))).select("file", "name", "cells").collect()}
        for path, name, *_ in wanted:
            f, r = by_path[path], shapes.get((path, name))
            names = list(headers.get((path, name), []))
            columns = complete_headers(names, max(len(names), (r["width"] or 0) if r else 0))
            tables[f.id, f.side].append(LargeTable(name, columns, r["n"] if r else 0, f.dialect.inferred))
            lows.append((path, name, (r["low"] or 0) if r else 0))
        low = local(spark, lows, "file string, name string, low long")
        rows = met.filter(body).join(low, ["file", "name"])
        frames.append(rows.select("id", "side", "name", (F.col("rank") - F.col("low")).alias(ROW), "cells"))
    columns_of = []
    for path, own in parts.items():
        f = by_path[path]
        if path in bad or f.kind == "delimited":
            continue
        order = [(start_of[path, r["start"]][0], r["names"]) for r in own] + [(r["raw"], r["names"]) for r in seams[path]]
        names = list(dict.fromkeys(n for _, names in sorted(order, key=lambda x: x[0]) for n in names))
        if names:
            tables[f.id, f.side].append(LargeTable("", names, totals[path]))
            columns_of.append((f.id, f.side, path, names))
    if columns_of:
        spec = local(spark, columns_of, "id int, side string, file string, columns array<string>")
        rows = records.join(spec, "file").withColumn("m", F.map_from_arrays("names", "cells"))
        frames.append(rows.select("id", "side", F.lit("").alias("name"), F.col("rank").alias(ROW), F.transform("columns", lambda c: F.try_element_at("m", c)).alias("cells")))
    return frames, tables


def _parquet_rows(spark: SparkSession, f: File) -> tuple[DataFrame, LargeTable]:
    df = spark.read.parquet(*reader_paths([f.physical]))
    columns = df.columns
    utc = lambda c: c.cast(pa.timestamp(c.type.unit, "UTC")) if pa.types.is_timestamp(c.type) and c.type.tz else c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [[_cell(v) for v in utc(batch.column(k)).to_pylist()] for k in range(1, batch.num_columns)]
            rows = [list(r) for r in zip(*cells, strict=True)] if cells else [[] for _ in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], names=[ROW, "cells"])

    indexed = df.select(F.col("_metadata.row_index").alias(ROW), *[F.col(f"`{c}`") for c in columns])
    rows = keep(indexed.mapInArrow(run, f"{ROW} long, cells array<string>"), "parquet")
    return rows.select(F.lit(f.id).alias("id"), F.lit(f.side).alias("side"), F.lit("").alias("name"), ROW, "cells"), LargeTable("", columns, df.count())


def read_large(spark: SparkSession, files: list[File]) -> tuple[DataFrame | None, dict[tuple[int, str], list[LargeTable]]]:
    """id, side, name, _row, cells, and by (id, side) the tables of large files. A file that is none of the kinds that can be cut has none."""
    frames: list[DataFrame] = []
    tables: dict[tuple[int, str], list[LargeTable]] = {}
    texts = [f for f in files if f.kind in ("delimited", "lines")]
    arrays = [f for f in files if f.kind == "array"]
    if texts or arrays:
        heads = _sniffed(spark, texts + arrays)
        for f in texts:
            if f.kind == "delimited":
                f.dialect = sniff(heads.get(f.physical, b""), f.path, f.config.dialect)
        arrays = [f for f in arrays if re.match(rb"(\xef\xbb\xbf)?\s*\[\s*\{", heads.get(f.physical, b""))]
    for group, separator in ((texts, "\n"), (arrays, "}")):
        if group:
            more, own = _text_tables(spark, group, separator)
            frames += more
            tables |= own
    for f in files:
        if f.kind == "parquet":
            rows, table = _parquet_rows(spark, f)
            frames.append(rows)
            tables[f.id, f.side] = [table]
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out, tables
