"""What users call: diff, diff_many, extract and renderers. What plugins add is in tidemark.plugins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import plugins
from tidemark.config import Config, load
from tidemark.operators import rows
from tidemark.operators.order import ROW
from tidemark.plans.engine import Changeset, diff, diff_many
from tidemark.plans.render import to_html, to_markdown
from tidemark.plans.tables import read_tables
from tidemark.plugins import discover
from tidemark.sources import files
from tidemark.store import keep

RENDERERS = plugins.RENDERERS
RENDERERS |= {
    "markdown": to_markdown,
    "html": to_html,
    "json": lambda found: "[" + ",\n".join(c.to_json() for c in found) + "]\n",
}
ASPECTS = ["rows_added", "rows_removed", "cells_changed", "columns_added", "columns_removed", "column_order", "content_left", "content_right", "content"]


def extract(spark: SparkSession, left: str, right: str, changeset: Changeset, path: str, aspect: str, config: Config | dict | str | None = None) -> DataFrame:
    """One aspect of a node as a DataFrame over the data itself."""
    config = config if isinstance(config, Config) else load(config)
    node = changeset.find(path)
    if node is None or aspect not in ASPECTS:
        raise KeyError(f"no {aspect} of {path!r}")
    outer, _, table = path.rpartition("/>") if node.item_type == "table" and "/>" in path and changeset.find(path.rpartition("/>")[0]) else (path, "", "")
    source = (node.source or path).rpartition("/>")[0] if table else node.source or path
    a, b = keep(files.scan(spark, left, config)), keep(files.scan(spark, right, config))
    if aspect.startswith("content"):
        items, at = (a, source) if aspect == "content_left" else (b, outer)
        return items.filter(F.col("path") == at).select("path", F.decode("content", "UTF-8").alias("content"))

    def load_table(items: DataFrame, at: str):
        row = items.filter(F.col("path") == at).select("ext", "physical").first()
        return next(t for t in read_tables(items, at, row["ext"], row["physical"], config.of(at)) if t.name == table)

    x, y = load_table(a, source), load_table(b, outer)
    if aspect.startswith("column"):
        names = {"columns_added": [c for c in y.columns if c not in x.columns], "columns_removed": [c for c in x.columns if c not in y.columns], "column_order": y.columns}[aspect]
        return spark.createDataFrame([(i, c) for i, c in enumerate(names)], "place int, name string")
    keys = config.of(outer).key_columns
    if keys:
        unique = lambda df: df.join(df.groupBy(*keys).count().filter("count > 1").select(*keys), keys, "left_anti")
        if aspect == "cells_changed":
            return rows.keyed_cells(unique(x.df.drop(ROW)), unique(y.df.drop(ROW)), keys)
        return (rows.rows_added if aspect == "rows_added" else rows.rows_removed)(x.df, y.df, keys).drop(ROW)
    if aspect == "cells_changed":
        return rows.positional_cells(x.df, y.df)
    more, fewer = (y.df, x.df) if aspect == "rows_added" else (x.df, y.df)
    return more.join(fewer.select(ROW), ROW, "left_anti")


__all__ = ["ASPECTS", "RENDERERS", "Changeset", "Config", "diff", "diff_many", "discover", "extract", "load", "to_html", "to_markdown"]
