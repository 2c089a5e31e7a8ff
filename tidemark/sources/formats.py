"""Binary formats: SQLite, Excel, OpenDocument, Parquet, Arrow, Avro, DBF, Stata, SAS, CBOR, MessagePack, BSON and shapefile headers."""

from __future__ import annotations

import io
import re
import sqlite3
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from tidemark.operators.documents import Number
from tidemark.operators.schema import complete_headers
from tidemark.sources.records import MARK, _plain, tagged

Table = tuple[str, list[str], list[list[str | None]]]


def _cell(value) -> str | None:
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return tagged(_plain(value))


def sqlite_tables(data: bytes) -> Iterator[Table]:
    """Tables by name, without SQLite's own. Blobs appear by their size."""
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
    for name in names:
        found = db.execute(f'SELECT * FROM "{name.replace(chr(34), chr(34) * 2)}"')
        columns = [c[0] for c in found.description]
        yield name, columns, [[f"<blob {len(v)} bytes>" if isinstance(v, bytes) else _cell(v) for v in row] for row in found]


def arrow_table(data: bytes, ext: str) -> Table:
    import pyarrow as pa
    import pyarrow.parquet as pq

    if ext == ".parquet":
        table = pq.read_table(io.BytesIO(data))
    else:
        try:
            table = pa.ipc.open_file(io.BytesIO(data)).read_all()
        except pa.ArrowInvalid:
            table = pa.ipc.open_stream(io.BytesIO(data)).read_all()
    columns = [c.to_pylist() for c in table.columns]
    return "", table.column_names, [[_cell(c[i]) for c in columns] for i in range(table.num_rows)]


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_sheets(data: bytes) -> Iterator[Table]:
    """Sheets that aren't empty; the first row has the names."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows: list[list[str | None]] = []
            for row in root.iter(f"{_NS}row"):
                cells: dict[int, str | None] = {}
                for c in row.iter(f"{_NS}c"):
                    letters = re.match("[A-Z]+", c.get("r", "A")).group()
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1
                    v, kind = c.find(f"{_NS}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif v is None or kind == "e":
                        cells[at] = None
                    elif kind == "s":
                        cells[at] = shared[int(v.text)]
                    elif kind == "b":
                        cells[at] = _cell(v.text == "1")
                    else:
                        cells[at] = v.text if kind == "str" else tagged(Number(v.text))
                rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
            if rows:
                width = max(map(len, rows))
                yield sheet.get("name"), complete_headers([(h or "").removeprefix(MARK) for h in rows[0]], width), rows[1:]


def dbf_table(data: bytes) -> Table:
    count, header, size = struct.unpack("<IHH", data[4:12])
    fields = []
    at = 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    rows = []
    for i in range(count):
        record = data[header + i * size : header + (i + 1) * size]
        cells, at = [], 1
        for _, kind, length, _ in fields:
            raw = record[at : at + length].decode("latin-1")
            at += length
            text = raw.strip()
            if kind in "NF":
                cells.append(tagged(Number(text)) if re.match(r"^-?\d+(\.\d+)?$", text) else None)
            elif kind == "L":
                cells.append(_cell(text in "YyTt") if text and text != "?" else None)
            elif kind == "D":
                cells.append(f"{text[:4]}-{text[4:6]}-{text[6:]}" if len(text) == 8 else None)
            else:
                cells.append(raw.rstrip())
        rows.append(cells)
    return "", [f[0] for f in fields], rows


def _ibm(raw: bytes) -> float | None:
    """A SAS transport number: IBM floating point, cut short; None if missing."""
    raw = raw.ljust(8, b"\0")
    if raw[0] in b"._ABCDEFGHIJKLMNOPQRSTUVWXYZ" and not any(raw[1:]):
        return None
    fraction = int.from_bytes(raw[1:8], "big") / (1 << 56)
    return (-1 if raw[0] & 0x80 else 1) * fraction * 16.0 ** ((raw[0] & 0x7F) - 64)


def xport_members(data: bytes) -> Iterator[Table]:
    """Member datasets of a SAS transport file; numbers as texts."""
    starts = [m.start() for m in re.finditer(rb"HEADER RECORD\*{7}MEMBER  HEADER RECORD!{7}", data)]
    used: dict[str, int] = {}
    for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
        part = data[a:b]
        name = part[168:176].decode("ascii", "replace").strip()
        used[name] = used.get(name, 0) + 1
        names = part.index(b"NAMESTR HEADER RECORD") - 20
        count, at, fields = int(part[names + 54 : names + 58]), names + 80, []
        for i in range(count):
            f = part[at + i * 140 : at + (i + 1) * 140]
            fields.append((f[8:16].decode("ascii", "replace").strip(), struct.unpack(">H", f[0:2])[0], struct.unpack(">H", f[4:6])[0]))
        start = part.index(b"OBS     HEADER RECORD") - 20 + 80
        width = sum(f[2] for f in fields)
        rows = []
        while width and start + width <= len(part) and part[start : start + width].strip():
            cells, x = [], start
            for _, kind, length in fields:
                raw = part[x : x + length]
                x += length
                if kind == 1:
                    value = _ibm(raw)
                    cells.append("." if value is None else str(int(value)) if value == int(value) else repr(value))
                else:
                    cells.append(raw.decode("latin-1").rstrip())
            rows.append(cells)
            start += width
        yield name if used[name] == 1 else f"{name}_{used[name]}", [f[0] for f in fields], rows


def shape_header(data: bytes) -> dict:
    """Feature count, geometry type and bounds of a .shp file."""
    if struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("no shapefile")
    kind = struct.unpack("<i", data[32:36])[0]
    at, n = 100, 0
    while at + 8 <= len(data):
        at += 8 + 2 * struct.unpack(">i", data[at + 4 : at + 8])[0]
        n += 1
    names = {0: "Null", 1: "Point", 3: "PolyLine", 5: "Polygon", 8: "MultiPoint"}
    return {"feature_count": n, "geometry_type": names.get(kind % 10, str(kind)), "bbox": list(struct.unpack("<4d", data[36:68]))}


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, kind: str):
        return struct.unpack(kind, self.take(struct.calcsize(kind)))[0]


def cbor(data: bytes):
    r = _Bytes(data)

    def item():
        first = r.number("B")
        major, info = first >> 5, first & 31
        if info == 31:
            if major in (2, 3):
                pieces = []
                while r.data[r.at] != 0xFF:
                    pieces.append(item())
                r.take(1)
                return ("" if major == 3 else b"").join(pieces)
            out: list = []
            while r.data[r.at] != 0xFF:
                out.append((item(), item()) if major == 5 else item())
            r.take(1)
            return dict(out) if major == 5 else out
        if major == 7 and info in (25, 26, 27):
            return r.number({25: ">e", 26: ">f", 27: ">d"}[info])
        n = info if info < 24 else r.number({24: ">B", 25: ">H", 26: ">I", 27: ">Q"}[info])
        if major == 0:
            return n
        if major == 1:
            return -1 - n
        if major in (2, 3):
            raw = r.take(n)
            return raw if major == 2 else raw.decode()
        if major == 4:
            return [item() for _ in range(n)]
        if major == 5:
            return {item(): item() for _ in range(n)}
        if major == 6:
            return item()
        return {20: False, 21: True}.get(n)

    return item()


def msgpack(data: bytes):
    r = _Bytes(data)

    def item():
        b = r.number("B")
        if b < 0x80:
            return b
        if b >= 0xE0:
            return b - 256
        if b < 0x90:
            return {item(): item() for _ in range(b & 15)}
        if b < 0xA0:
            return [item() for _ in range(b & 15)]
        if b < 0xC0:
            return r.take(b & 31).decode()
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if 0xC4 <= b <= 0xC6:
            return r.take(r.number({0xC4: ">B", 0xC5: ">H", 0xC6: ">I"}[b]))
        if b in (0xCA, 0xCB):
            return r.number(">f" if b == 0xCA else ">d")
        if 0xCC <= b <= 0xD3:
            return r.number([">B", ">H", ">I", ">Q", ">b", ">h", ">i", ">q"][b - 0xCC])
        if 0xD9 <= b <= 0xDB:
            return r.take(r.number({0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}[b])).decode()
        if b in (0xDC, 0xDD):
            return [item() for _ in range(r.number(">H" if b == 0xDC else ">I"))]
        if b in (0xDE, 0xDF):
            return {item(): item() for _ in range(r.number(">H" if b == 0xDE else ">I"))}
        size = {0xD4: 1, 0xD5: 2, 0xD6: 4, 0xD7: 8, 0xD8: 16}.get(b) or r.number({0xC7: ">B", 0xC8: ">H", 0xC9: ">I"}[b])
        return f"ext({r.number('b')}, {r.take(size).hex()})"

    return item()


def bson(data: bytes):
    r = _Bytes(data)

    def name() -> str:
        end = r.data.index(b"\0", r.at)
        out = r.take(end - r.at).decode()
        r.take(1)
        return out

    def text() -> str:
        return r.take(r.number("<i"))[:-1].decode()

    def document(array: bool = False):
        r.number("<i")
        out = {}
        while kind := r.number("B"):
            key = name()
            if kind == 1:
                value = r.number("<d")
            elif kind in (2, 13, 14):
                value = text()
            elif kind in (3, 4):
                value = document(kind == 4)
            elif kind == 5:
                n = r.number("<i")
                r.take(1)
                value = r.take(n)
            elif kind == 7:
                value = r.take(12).hex()
            elif kind == 8:
                value = bool(r.number("B"))
            elif kind in (9, 17, 18):
                value = r.number("<q")
            elif kind in (6, 10):
                value = None
            elif kind == 11:
                value = f"/{name()}/{name()}"
            elif kind == 16:
                value = r.number("<i")
            elif kind == 19:
                value = r.take(16).hex()
            else:
                raise ValueError(f"unknown kind {kind}")
            out[key] = value
        return list(out.values()) if array else out

    return document()


def avro_table(data: bytes) -> Table:
    """Records of an Avro container file, cells in the order of the writer's schema."""
    import json
    import zlib

    r = _Bytes(data)
    if r.take(4) != b"Obj\x01":
        raise ValueError("no Avro file")

    def number() -> int:
        n = shift = 0
        while True:
            b = r.number("B")
            n |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return (n >> 1) ^ -(n & 1)

    def blocks(item):
        out = []
        while n := number():
            if n < 0:
                n = -n
                number()
            out += [item() for _ in range(n)]
        return out

    named: dict[str, dict] = {}

    def value(schema):
        kind = schema
        if isinstance(schema, list):
            return value(schema[number()])
        if isinstance(schema, dict):
            kind = schema["type"]
            if "name" in schema:
                named[schema["name"]] = schema
        if isinstance(kind, (dict, list)):
            return value(kind)
        if kind in named and not isinstance(schema, dict):
            return value(named[kind])
        if kind == "null":
            return None
        if kind == "boolean":
            return bool(r.number("B"))
        if kind in ("int", "long"):
            return number()
        if kind in ("float", "double"):
            return r.number("<f" if kind == "float" else "<d")
        if kind == "bytes":
            return list(r.take(number()))
        if kind == "string":
            return r.take(number()).decode()
        if kind == "fixed":
            return list(r.take(schema["size"]))
        if kind == "enum":
            return schema["symbols"][number()]
        if kind == "array":
            return blocks(lambda: value(schema["items"]))
        if kind == "map":
            return dict(blocks(lambda: (value("string"), value(schema["values"]))))
        return {f["name"]: value(f["type"]) for f in schema["fields"]}

    meta = dict(blocks(lambda: (value("string"), bytes(value("bytes")))))
    schema = json.loads(meta["avro.schema"])
    if not isinstance(schema, dict) or schema.get("type") != "record":
        raise ValueError("the writer's schema is no record")
    marker, rows = r.take(16), []
    while r.at < len(r.data):
        count, body = number(), r.take(number())
        if meta.get("avro.codec", b"null") == b"deflate":
            body = zlib.decompress(body, -15)
        outer, r = r, _Bytes(body)
        rows += [value(schema) for _ in range(count)]
        r = outer
        if r.take(16) != marker:
            raise ValueError("a block ends wrongly")
    columns = [f["name"] for f in schema["fields"]]
    return "", columns, [[_cell(row[c]) for c in columns] for row in rows]


def stat_table(data: bytes, ext: str) -> Table:
    """Stata and SAS7BDAT through pandas; all cells are texts, whole numbers without decimals, missing ones a dot."""
    import pandas as pd

    if ext == ".dta":
        df = pd.read_stata(io.BytesIO(data), convert_categoricals=False, convert_dates=False)
    else:
        df = pd.read_sas(io.BytesIO(data), format="sas7bdat", encoding="latin-1")

    def text(v) -> str:
        if isinstance(v, float):
            return "." if v != v else str(int(v)) if v == int(v) else repr(v)
        return "." if v is None else str(v)

    return "", list(map(str, df.columns)), [[text(v) for v in row] for row in df.astype(object).itertuples(index=False)]


_ODS = {"table": "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}", "office": "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}", "text": "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"}


def ods_sheets(data: bytes) -> Iterator[Table]:
    """Sheets of an OpenDocument file that aren't empty."""
    t, o = _ODS["table"], _ODS["office"]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("content.xml"))
    for sheet in root.iter(f"{t}table"):
        rows: list[list[str | None]] = []
        for row in sheet.iter(f"{t}table-row"):
            cells: list[str | None] = []
            for c in row.iter(f"{t}table-cell"):
                kind = c.get(f"{o}value-type")
                texts = "\n".join("".join(p.itertext()) for p in c.iter(f"{_ODS['text']}p"))
                v = tagged(Number(c.get(f"{o}value"))) if kind in ("float", "percentage", "currency") else _cell(c.get(f"{o}boolean-value") == "true") if kind == "boolean" else c.get(f"{o}date-value") or texts or None
                cells += [v] * min(int(c.get(f"{t}number-columns-repeated", 1)), 1 << 14)
            while cells and cells[-1] is None:
                cells.pop()
            rows.append(cells)
        while rows and not rows[-1]:
            rows.pop()
        if rows:
            width = max(map(len, rows))
            yield sheet.get(f"{t}name"), complete_headers([(h or "").removeprefix(MARK) for h in rows[0]], width), rows[1:]


BINARY_DOCUMENTS = {".cbor": cbor, ".msgpack": msgpack, ".bson": bson, ".shp": shape_header}


def binary_document(data: bytes, ext: str):
    return _plain(BINARY_DOCUMENTS[ext](data))


def tables(data: bytes, ext: str) -> list[Table] | None:
    """All tables of a file by its extension, or None. A table without a name is the file's own."""
    if ext in (".sqlite", ".sqlite3", ".db"):
        return list(sqlite_tables(data))
    if ext in (".parquet", ".arrow", ".feather", ".ipc"):
        return [arrow_table(data, ext)]
    if ext in (".xlsx", ".xlsm"):
        return list(xlsx_sheets(data))
    if ext == ".ods":
        return list(ods_sheets(data))
    if ext == ".avro":
        return [avro_table(data)]
    if ext in (".dta", ".sas7bdat"):
        return [stat_table(data, ext)]
    if ext == ".dbf":
        return [dbf_table(data)]
    if ext == ".xpt":
        return list(xport_members(data))
    return None
