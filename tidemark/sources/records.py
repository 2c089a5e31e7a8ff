"""Tables and documents in JSON, JSON Lines, GeoJSON, YAML, TOML, INI, XML and property lists.

Cells of a table are texts. So that 1 and "1" stay apart, a cell that is not a string is its JSON behind a mark (tagged text).
"""

from __future__ import annotations

import configparser
import json
import plistlib
import re
import tomllib
import xml.etree.ElementTree as ET

from tidemark.functions.cells import MARK
from tidemark.operators.documents import Number, canonical, flatten, parse


def tagged(value) -> str | None:
    return None if value is None else value if isinstance(value, str) and not isinstance(value, Number) else MARK + canonical(value)


def untagged(cell: str | None):
    """The value of a cell: a string, or what its JSON says."""
    return json.loads(cell[1:]) if cell is not None and cell.startswith(MARK) else cell


def kind_of(cell: str | None) -> str:
    value = untagged(cell)
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "nested"


def same_across_types(a: str | None, b: str | None) -> bool:
    """A number and the string that reads the same."""
    kinds = {kind_of(a), kind_of(b)}
    return kinds == {"number", "string"} and (a or "").removeprefix(MARK) == (b or "").removeprefix(MARK)


def table_of(records: list) -> tuple[list[str], list[list[str | None]]] | None:
    """(names, rows) of objects (names in the order they first appear) or of arrays (column_i); else None."""
    if records and all(isinstance(r, dict) for r in records):
        names = list(dict.fromkeys(k for r in records for k in r))
        return names, [[tagged(r.get(n)) for n in names] for r in records]
    if records and all(isinstance(r, list) for r in records):
        width = max(map(len, records))
        return [f"column_{i + 1}" for i in range(width)], [[tagged(v) for v in r] for r in records]
    return None


def at_path(value, path: str):
    for name in path.split(".")[1:]:
        if not isinstance(value, dict) or name not in value:
            raise ValueError(f"nothing at {path}")
        value = value[name]
    return value


def without_path(value: dict, path: str) -> dict:
    head, *rest = path.split(".")[1:]
    return {k: (without_path(v, ".".join(["$", *rest])) if rest and k == head and isinstance(v, dict) else v) for k, v in value.items() if k != head or rest}


def json_table(data: bytes, name: str, records_path: str | None = None) -> tuple[list[str], list[list[str | None]], dict[str, str]] | None:
    """(names, rows, metadata) if the file is a table: JSON Lines, an array of objects or arrays, GeoJSON features, or what
    records_path leads to. What stands around the array is metadata with dotted keys."""
    text = data.decode("utf-8-sig", "replace")
    if name.lower().endswith((".jsonl", ".ndjson")):
        found = table_of([parse(line) for line in text.splitlines() if line.strip()])
        return (*found, {}) if found else None
    value = parse(text)
    if records_path:
        records = at_path(value, records_path)
        found = table_of(records) if isinstance(records, list) else None
        if not found:
            raise ValueError(f"{records_path} is no array of objects")
        return (*found, flatten(without_path(value, records_path)) if isinstance(value, dict) else {})
    if isinstance(value, dict) and value.get("type") == "FeatureCollection" and isinstance(value.get("features"), list):
        features = [{**({"id": f["id"]} if "id" in f else {}), **(f.get("properties") or {}), "geometry": f.get("geometry")} for f in value["features"]]
        found = table_of(features)
        return (*found, flatten({k: v for k, v in value.items() if k != "features"})) if found else None
    found = table_of(value) if isinstance(value, list) else None
    return (*found, {}) if found else None


def xml_value(e: ET.Element):
    """Attributes as @name, text as #text, repeated children as arrays; all scalars are strings."""
    out: dict = {f"@{k}": v for k, v in e.attrib.items()}
    for child in e:
        v = xml_value(child)
        if child.tag in out:
            out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), v]
        else:
            out[child.tag] = v
    text = (e.text or "").strip()
    if not out:
        return text
    return out | ({"#text": text} if text else {})


def _plain(value):
    """Values that JSON has: numbers as written, others as text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, bool) or value is None or isinstance(value, (str, Number)):
        return value
    if isinstance(value, (int, float)):
        return Number(json.dumps(value))
    return value.isoformat() if hasattr(value, "isoformat") else value.hex() if isinstance(value, bytes) else str(value)


def document(data: bytes, ext: str):
    """The tree of a document by its extension; None if it is none."""
    text = data.decode("utf-8-sig", "replace")
    if ext in (".json", ".jsonld", ".geojson"):
        return parse(text)
    if ext in (".yaml", ".yml"):
        import yaml

        return _plain(yaml.safe_load(text))
    if ext == ".toml":
        return _plain(tomllib.loads(text))
    if ext in (".ini", ".cfg"):
        p = configparser.ConfigParser(interpolation=None, default_section="\0")
        p.optionxform = str
        p.read_string(text if re.match(r"\s*\[", text) else "[\0top]\n" + text)
        out = {s: dict(p[s]) for s in p.sections()}
        return out.pop("\0top", {}) | out
    if ext == ".xml":
        root = ET.fromstring(data)
        return {root.tag: xml_value(root)}
    if ext == ".plist":
        return _plain(plistlib.loads(data))
    return None
