"""Keyed comparison of document trees: nested objects correspond by an attribute."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.documents import canonical, keyed_nodes, parse


def node_table(docs: DataFrame, by: list[str], text: str, attribute: str) -> DataFrame:
    """by, key, path, value of every nested object with the attribute; value without nested objects that have it themselves."""
    types = dict(docs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in by) + ", key string, path string, value string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for *keys, body in part[[*by, text]].itertuples(index=False):
                try:
                    rows += [(*keys, key, path, canonical(pruned(node, attribute))) for key, path, node in keyed_nodes(parse(body), attribute)]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=[*by, "key", "path", "value"])

    return docs.select(*by, text).mapInPandas(run, schema)


def pruned(value, attribute: str, top: bool = True):
    """value without the nested objects that have the attribute."""
    keyed = lambda v: isinstance(v, dict) and attribute in v
    if isinstance(value, dict):
        return {k: pruned(v, attribute, False) for k, v in value.items() if not keyed(v)}
    if isinstance(value, list):
        return [pruned(v, attribute, False) for v in value if not keyed(v)]
    return value


def keyed_node_changes(left: DataFrame, right: DataFrame, by: list[str], text: str, attribute: str) -> DataFrame:
    """by, key, verb: nodes added, removed and edited."""
    side = lambda df, name: node_table(df, by, text, attribute).select(*by, "key", F.col("value").alias(name))
    pairs = side(left, "l").join(side(right, "r"), [*by, "key"], "full_outer").filter(~F.col("l").eqNullSafe(F.col("r")))
    verb = F.when(F.col("l").isNull(), "add_node").when(F.col("r").isNull(), "remove_node").otherwise("edit_node")
    return pairs.select(*by, "key", verb.alias("verb"))
