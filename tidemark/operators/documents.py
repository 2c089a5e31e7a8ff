"""Differences of document trees (JSON and what can be read as such): leaves by path, keyed nodes, and what only serialization shows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = 16
_SPACE = re.compile(r'("(?:[^"\\]|\\.)*")|\s+')
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")


class Number(str):
    """A number as it is written, so that 1 and 1.0 stay apart."""


def parse(text: str):
    return json.loads(text, parse_float=Number, parse_int=Number, parse_constant=Number)


def canonical(value) -> str:
    """JSON with sorted keys; numbers as written."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def step(path: str, key: str | int) -> str:
    if isinstance(key, int):
        return f"{path}[{key}]"
    return f"{path}.{key}" if _NAME.match(key) else f"{path}[{json.dumps(key, ensure_ascii=False)}]"


def leaves(value, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, canonical value); an empty object or list is a leaf."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, step(path, k))
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, step(path, i))
    else:
        yield path, canonical(value)


def value_changes(a, b, path: str = "$") -> Iterator[dict]:
    """add, remove, replace and array_length changes, object keys in order."""
    if isinstance(a, dict) and isinstance(b, dict):
        for k in sorted(a.keys() | b.keys()):
            if k not in b:
                yield {"kind": "remove", "path": step(path, k), "from": a[k]}
            elif k not in a:
                yield {"kind": "add", "path": step(path, k), "to": b[k]}
            else:
                yield from value_changes(a[k], b[k], step(path, k))
    elif isinstance(a, list) and isinstance(b, list):
        for i, (x, y) in enumerate(zip(a, b, strict=False)):
            yield from value_changes(x, y, step(path, i))
        if len(a) != len(b):
            yield {"kind": "array_length", "path": path, "from": len(a), "to": len(b)}
    elif canonical(a) != canonical(b):
        yield {"kind": "replace", "path": path, "from": a, "to": b}


def keyed_nodes(value, attribute: str, path: str = "$") -> Iterator[tuple[str, str, object]]:
    """(key, path, node) of every nested object that has the attribute."""
    if isinstance(value, dict):
        if attribute in value and not isinstance(value[attribute], (dict, list)) and value[attribute] is not None:
            yield str(value[attribute]), path, value
        for k, v in value.items():
            yield from keyed_nodes(v, attribute, step(path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from keyed_nodes(v, attribute, step(path, i))


def leaf_table(docs: DataFrame, by: list[str], text: str) -> DataFrame:
    """by, path, value: the leaves of JSON texts; a text that isn't JSON has none."""
    types = dict(docs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", path string, value string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for *keys, body in part[[*by, text]].itertuples(index=False):
                try:
                    rows += [(*keys, path, value) for path, value in leaves(parse(body))]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=[*by, "path", "value"])

    return docs.select(*by, text).mapInPandas(run, schema)


def leaf_changes(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """by, path, from, to of leaf tables."""
    pairs = left.withColumnRenamed("value", "from").join(right.withColumnRenamed("value", "to"), [*by, "path"], "full_outer")
    return pairs.filter(~F.col("from").eqNullSafe(F.col("to"))).select(*by, "path", "from", "to")


def equal_values(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: by, l, r (JSON texts). by, equal_value: whether both are the same value, whatever the order of keys; null if one is no JSON."""
    types = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", equal_value boolean"

    def same(a: str | None, b: str | None) -> bool | None:
        try:
            return canonical(parse(a)) == canonical(parse(b))
        except (TypeError, ValueError):
            return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [same(a, b) for a, b in zip(part["l"], part["r"], strict=True)]
            yield part[by].assign(equal_value=pd.array(found, dtype="boolean"))

    return pairs.select(*by, "l", "r").mapInPandas(run, schema)


def flatten(value: dict, prefix: str = "") -> dict[str, str]:
    """Dotted keys of nested objects; other values as canonical JSON, texts as they are."""
    out: dict[str, str] = {}
    for k, v in value.items():
        name = f"{prefix}.{k}" if prefix else k
        if isinstance(v, dict) and v:
            out |= flatten(v, name)
        else:
            out[name] = v if isinstance(v, str) else canonical(v)
    return out


def metadata_changes(left: DataFrame, right: DataFrame, by: list[str], most: int = 32) -> DataFrame:
    """by, key, kind, from, to of two columns `meta` of type map: keys added, removed and changed, the first `most` of each row by key."""
    from pyspark.sql import Window

    side = lambda df, name: df.select(*by, F.explode("meta").alias("key", name))
    pairs = side(left, "from").join(side(right, "to"), [*by, "key"], "full_outer").filter(~F.col("from").eqNullSafe(F.col("to")))
    kind = F.when(F.col("from").isNull(), "add").when(F.col("to").isNull(), "remove").otherwise("change")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("key"))
    return pairs.withColumn("_place", place).filter(F.col("_place") <= most).select(*by, "key", kind.alias("kind"), "from", "to")


def serialization_kinds(a: str, b: str) -> list[str]:
    """For documents of equal value: which of object_key_order, formatting and serialization differ."""
    if a == b:
        return []
    order = lambda t: json.dumps(parse(t), ensure_ascii=False)
    kinds = []
    if order(a) != order(b):
        kinds.append("object_key_order")
    squeeze = lambda t: _SPACE.sub(lambda m: m[1] or "", t)
    if squeeze(a) == squeeze(b):
        kinds.append("formatting")
    return kinds or ["serialization"]
