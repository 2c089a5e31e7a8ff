"""Changed pairs of files, all at once: both contents meet in one join, and tasks either parse them to rows of tables or, where they are
no tables, work out the edits of the pair. What comes to the driver are heads of tables and edits; rows stay where they are."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import plugins
from tidemark.config import Config, Diagnostic, PathConfig, diagnostic
from tidemark.operators import binary, documents, text
from tidemark.operators.compact import Edit, edit
from tidemark.operators.nodes import pruned
from tidemark.operators.order import ROW
from tidemark.plans.tables import is_tabular, parse_file
from tidemark.sources.files import looks_like_text
from tidemark.sources.formats import BINARY_DOCUMENTS, binary_document
from tidemark.sources.records import document, tagged
from tidemark.store import keep, local

TEXT = {".txt", ".md", ".vcf", ""}
DOCUMENTS = {".json", ".jsonld", ".geojson", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".xml", ".plist"}
#: Bytes of an Arrow batch of contents; a larger file is a batch of its own. Rows of parsed tables that are handed on together.
CONTENT_BYTES, HANDED_ROWS = 64 << 20, 20_000
READ = f"kind string, id int, side string, name string, {ROW} long, cells array<string>, body string"
SPEC = "id int, left string, right string, left_ext string, right_ext string, left_config int, right_config int"


@dataclass
class Head:
    """A table's columns, what its file says about it, and its number of rows."""

    columns: list[str]
    meta: dict = field(default_factory=dict)
    inferred_dialect: bool = False
    rows: int = 0


@contextmanager
def content_batches(spark: SparkSession):
    """Batches of files go by their bytes while this lasts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, CONTENT_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# --- edits of a pair that is no table ------------------------------------------------------------------------------------


def document_edits(a: bytes, b: bytes, ext: str, key: str | None) -> list[Edit] | None:
    """Edits between two documents; None if they can't be read as such."""
    try:
        x, y = (binary_document(d, ext) if ext in BINARY_DOCUMENTS else document(d, ext) for d in (a, b))
    except Exception:
        return None
    if x is None and y is None:
        return None
    if documents.canonical(x) == documents.canonical(y):
        kinds = documents.serialization_kinds(a.decode("utf-8", "replace"), b.decode("utf-8", "replace")) if ext in (".json", ".jsonld", ".geojson") else ["serialization"]
        return [edit("document.serialization_change", {"kinds": kinds}, ("serialization-change", "document-serialization-change"))]
    edits: list[Edit] = []
    cut = lambda changes: {"changes": changes[: documents.CHANGES], "examples_truncated": len(changes) > documents.CHANGES}
    if key:
        p, q = ({k: (path, node) for k, path, node in documents.keyed_nodes(v, key)} for v in (x, y))
        for k in sorted(p.keys() | q.keys()):
            if k not in q:
                edits.append(edit("document.remove_node", {"key_attribute": key, "key": k, "path": p[k][0]}, ("content-changed", "document-node-removal")))
            elif k not in p:
                edits.append(edit("document.add_node", {"key_attribute": key, "key": k, "path": q[k][0], "value": pruned(q[k][1], key)}, ("content-changed", "document-node-addition")))
            elif changes := list(documents.value_changes(pruned(p[k][1], key), pruned(q[k][1], key))):
                edits.append(edit("document.edit_node", {"key_attribute": key, "key": k, "path": q[k][0], **cut(changes)}, ("content-changed", "document-node-edit")))
        x, y = pruned(x, key), pruned(y, key)
    if changes := list(documents.value_changes(x, y)):
        edits.append(edit("document.value_change", cut(changes), ("content-changed", "document-value-change")))
    return edits


def text_edits(a: bytes, b: bytes) -> list[Edit]:
    def decoded(d: bytes) -> tuple[str, str]:
        try:
            return d.decode("utf-8"), "utf-8"
        except UnicodeDecodeError:
            return d.decode("latin-1"), "other"

    (x, ex), (y, ey) = decoded(a), decoded(b)
    out = []
    if ex != ey:
        out.append(edit("text.encoding_changed", {"from": ex, "to": ey}, ("encoding-change",)))
    bom = [t.startswith(text.BOM) for t in (x, y)]
    if bom[0] != bom[1]:
        out.append(edit("text.bom_changed", {"from": bom[0], "to": bom[1]}, ("bom-change", "encoding-change")))
    x, y = x.removeprefix(text.BOM), y.removeprefix(text.BOM)

    def ends(t: str) -> str:
        crlf = t.count("\r\n")
        kinds = [k for k, n in (("crlf", crlf), ("lf", t.count("\n") - crlf), ("cr", t.count("\r") - crlf)) if n]
        return kinds[0] if len(kinds) == 1 else "mixed" if kinds else "none"

    if ends(x) != ends(y):
        out.append(edit("text.line_endings_changed", {"from": ends(x), "to": ends(y)}, ("line-ending-change",)))
    x, y = (t.replace("\r\n", "\n").replace("\r", "\n") for t in (x, y))
    if x != y and "".join(x.split()) == "".join(y.split()):
        out.append(edit("text.whitespace_only_changed", {"lines": y.count("\n") + 1}, ("whitespace-only-change",)))
    elif x != y:
        added, removed, examples = text.lines_changed(x, y)
        tags = ["content-changed", *(["lines-added"] if added else []), *(["lines-removed"] if removed else [])]
        out.append(edit("text.replace_lines", {"lines_added": added, "lines_removed": removed, "examples": examples}, tuple(tags)))
    return out


def byte_edits(a: bytes, b: bytes) -> list[Edit]:
    found = binary.changed_regions(a, b)
    if found["unchanged"]:
        params = {k: found[k] for k in ("left_size", "right_size", "unchanged")} | {"regions": [list(r) for r in found["regions"][: binary.REGIONS]], "region_count": len(found["regions"])}
        return [edit("binary.byte_ranges_changed", params, ("content-changed", "binary-byte-range-change"))]
    added, removed = binary.string_changes(a, b)
    params = {"strings": {"added": added, "removed": removed}} if added or removed else {}
    return [edit("binary.contents-differ", params, ("content-changed", *(["strings-changed"] if params else [])))]


def _sendable(value):
    """Params as JSON can hold them: numbers of documents as tagged texts, so that they are numbers again for the reader."""
    if isinstance(value, documents.Number):
        return tagged(value)
    if isinstance(value, dict):
        return {k: _sendable(v) for k, v in value.items()}
    return [_sendable(v) for v in value] if isinstance(value, (list, tuple)) else value


def pair_edits(a: bytes, b: bytes, left_ext: str, ext: str, cfg: PathConfig, writers: dict) -> dict:
    """item_type, tags and edits of a pair that gives no tables."""
    if ext in writers and (own := writers[ext](a, b)) is not None:
        return {"item_type": "file", "tags": [], "edits": own}
    tags = ["serialization-change"] if left_ext != ext else []
    forced = {"text": TEXT, "binary": set()}.get(cfg.rule or "")
    found, item_type = None, "file"
    if forced is None and (ext in DOCUMENTS or ext in BINARY_DOCUMENTS):
        found, item_type = document_edits(a, b, ext, cfg.node_key), "document"
    if found is None:
        if (ext in TEXT or cfg.content_type == "text/plain" or forced or ext not in DOCUMENTS) and looks_like_text(a) and looks_like_text(b):
            item_type = "text"
            if ext not in TEXT - {""} and cfg.content_type != "text/plain" and not forced:
                tags.append("inference.content-sniffed-type")
            found = text_edits(a, b)
        else:
            found = byte_edits(a, b)
    return {"item_type": item_type, "tags": tags, "edits": [e | {"params": _sendable(e["params"])} for e in found]}


# --- all pairs -------------------------------------------------------------------------------------------------------------


def _handed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "id", "side", "name", ROW, "cells", "body"])


def _table_rows(i: int, side: str, found: list) -> Iterator[tuple]:
    for name, columns, rows, meta, inferred in found:
        yield ("head", i, side, name, len(rows), list(columns), json.dumps([meta, inferred]))
        for n, r in enumerate(rows):
            yield ("row", i, side, name, n, [None if c is None else str(c) for c in r], None)


def read_pairs(left: DataFrame, right: DataFrame, jobs: list[tuple], config: Config) -> DataFrame:
    """jobs: rows of SPEC; configs are numbers into [defaults, *paths]. Kept: heads and rows of the pairs that are tables on both sides,
    and for each other pair a row `pair` with its edits as JSON. What can't be parsed becomes a diagnostic, and is compared as it is."""
    spark = left.sparkSession
    spec = local(spark, jobs, SPEC)
    configs, parsers, writers = [config.defaults, *config.paths], dict(plugins.PARSERS), dict(plugins.WRITERS)

    def of_pair(i: int, a: bytes, b: bytes, lp: str, rp: str, le: str, re: str, lc: int, rc: int) -> Iterator[tuple]:
        one, two = configs[lc], configs[rc]
        problems: list[Diagnostic] = []
        tabular = re not in writers and {"text", "binary"}.isdisjoint({two.rule}) and is_tabular(re, two, parsers) and is_tabular(le, one, parsers)
        if tabular:
            try:
                x, y = parse_file(a, lp, le, one, parsers), parse_file(b, rp, re, two, parsers)
            except Exception as e:
                x = y = []
                problems.append(diagnostic("error", "rule.parse_failed", (str(e).splitlines() or [repr(e)])[-1][:300], rp))
            if x and y:
                yield from _table_rows(i, "l", x)
                yield from _table_rows(i, "r", y)
                return
        try:
            found = pair_edits(a, b, le, re, two, writers)
        except Exception as e:
            found = {"item_type": "file", "tags": [], "edits": []}
            problems.append(diagnostic("error", "rule.write_failed", (str(e).splitlines() or [repr(e)])[-1][:300], rp))
        yield ("pair", i, None, None, None, None, json.dumps(found | {"diagnostics": problems}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for n in range(len(batch)):
                i, lp, rp, le, re, lc, rc, a, b = (c[n].as_py() for c in columns)
                for row in of_pair(i, a, b, lp, rp, le, re, lc, rc):
                    out.append(row)
                    if len(out) >= HANDED_ROWS:
                        yield _handed(out)
                        out = []
        if out:
            yield _handed(out)

    a = spec.join(left.select(F.col("path").alias("left"), F.col("content").alias("_a")), "left").select(*spec.columns, "_a")
    b = spec.select("id", "right").join(right.select(F.col("path").alias("right"), F.col("content").alias("_b")), "right").select("id", "_b")
    return keep(a.join(b, "id").select(*spec.columns, "_a", "_b").mapInArrow(run, READ), "pairs")


def read_files(items: DataFrame, jobs: list[tuple], config: Config) -> DataFrame:
    """Heads and rows of single files, kept. jobs: (id, path, ext, config). Files that can't be parsed have none."""
    spark = items.sparkSession
    spec = local(spark, jobs, "id int, path string, ext string, config int")
    configs, parsers = [config.defaults, *config.paths], dict(plugins.PARSERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for n in range(len(batch)):
                i, path, ext, c, content = (batch.column(k)[n].as_py() for k in range(5))
                try:
                    found = parse_file(content, path, ext, configs[c], parsers)
                except Exception:
                    continue
                for row in _table_rows(i, "", found):
                    out.append(row)
                    if len(out) >= HANDED_ROWS:
                        yield _handed(out)
                        out = []
        if out:
            yield _handed(out)

    contents = items.filter("content IS NOT NULL").select("path", "content")
    return keep(spec.join(contents, "path").select("id", "path", "ext", "config", "content").mapInArrow(run, READ), "files")


def heads_of(read: DataFrame) -> dict[tuple[int, str, str], Head]:
    """By (id, side, name)."""
    out = {}
    for r in read.filter("kind = 'head'").collect():  # a row for each table
        meta, inferred = json.loads(r["body"])
        out[r["id"], r["side"], r["name"]] = Head(list(r["cells"]), meta, inferred, r[ROW])
    return out
