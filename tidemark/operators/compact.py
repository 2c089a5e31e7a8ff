"""Rewrites of an edit list to a shorter one, and the cost that decides: one for each edit and each link, and the size of its params.

An edit is a dict: verb, params, and what it shows (tags, visible). Tables of edits of any length are handled where they arise
(precision, rows, infer); what is here works on lists that are already short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.schema import reordered

Edit = dict


def text_cost(c: Column) -> Column:
    """A text's part of the cost."""
    return F.lit(1) + F.floor(F.length(c) / 16)


def value_size(value: object) -> int:
    if isinstance(value, str):
        return 1 + len(value) // 16
    if isinstance(value, dict):
        return 1 + sum(value_size(k) + value_size(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return 1 + sum(map(value_size, value))
    return 1


def cost(edits: list[Edit], links: int = 0) -> int:
    return links + sum(1 + value_size(e.get("params", {})) for e in edits)


def edit(verb: str, params: dict, tags: tuple[str, ...] = (), visible: bool = True) -> Edit:
    return {"verb": verb, "params": params, "tags": sorted(tags), "visible": visible}


def renamed_columns(edits: list[Edit], pairs: list[tuple[str, str]], cells: list[Edit] = []) -> list[Edit] | None:
    """Removed and added columns that are one column become rename_column; a set_headers that says no more goes. cells: edits of
    the cells of these columns that changed besides."""
    if not pairs:
        return None
    gone, came = {a for a, _ in pairs}, {b for _, b in pairs}
    out = [e for e in edits if not (e["verb"] == "tabular.remove_column" and e["params"]["name"] in gone) and not (e["verb"] == "tabular.add_column" and e["params"]["name"] in came)]
    names = dict(pairs)
    headers = next((e for e in out if e["verb"] == "tabular.set_headers"), None)
    if headers and [names.get(c, c) for c in headers["params"]["from"]] == headers["params"]["to"]:
        out.remove(headers)
    return [edit("tabular.rename_column", {"from": a, "to": b}, ("column-rename", "schema-change")) for a, b in pairs] + out + cells


def reordered_columns(edits: list[Edit]) -> list[Edit] | None:
    """set_headers whose common columns changed their order becomes reorder_columns."""
    for i, e in enumerate(edits):
        if e["verb"] == "tabular.set_headers" and (order := reordered(e["params"]["from"], e["params"]["to"])):
            return [*edits[:i], edit("tabular.reorder_columns", {"order": order}, ("column-reorder", "schema-change")), *edits[i + 1 :]]
    return None


def appended_rows(edits: list[Edit]) -> list[Edit] | None:
    """Consecutive add_row edits become append_rows."""
    adds = sorted((e for e in edits if e["verb"] == "tabular.add_row"), key=lambda e: e["params"]["index"])
    runs: list[list[Edit]] = []
    for e in adds:
        if runs and runs[-1][-1]["params"]["index"] + 1 == e["params"]["index"]:
            runs[-1].append(e)
        else:
            runs.append([e])
    if not any(len(r) > 1 for r in runs):
        return None
    out = [e for e in edits if e["verb"] != "tabular.add_row"]
    for run in runs:
        if len(run) > 1:
            out.append(edit("tabular.append_rows", {"start": run[0]["params"]["index"], "rows": [e["params"]["values"] for e in run]}, ("row-addition",)))
        else:
            out.append(edit("tabular.add_row", {k: v for k, v in run[0]["params"].items() if k != "key"}, ("row-addition",)))
    return out


def compacted(edits: list[Edit], rules: list[Callable[[list[Edit]], list[Edit] | None]]) -> list[Edit]:
    """One sweep: each rule's rewrite counts if it costs less."""
    for rule in rules:
        new = rule(edits)
        if new is not None and cost(new) < cost(edits):
            edits = new
    return edits
