"""Comparison of all changed tables at once: which rows correspond, what changed, and the short way to say it.

Every step is one query over the rows of all tables, which carry their table's number `t`, so the number of Spark jobs does not depend
on how many tables there are. Tables of any shape meet in one full outer join on (t, align): `align` is a row's key, its place, or its
place once both sides are sorted. What comes to the driver are a few counts for each column, and the edits that are shown.

Rewrites to a shorter description (compaction) are decided from counts and costs by (table, column, class of change), so they hold for
any number of edits. What is left is listed up to EDIT_LIMIT edits for each table and summed up, with examples, beyond it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import POLICIES, Diagnostic, PathConfig, diagnostic
from tidemark.functions.cells import decimal, is_blank, is_suppressed, kind_of, rounding_modulus, unmarked
from tidemark.operators import infer, rows
from tidemark.operators.compact import Edit, appended_rows, cost, edit, renamed_columns, reordered_columns, value_size
from tidemark.operators.order import ROW, with_row_index
from tidemark.plans.reading import Head
from tidemark.store import keep, local

EDIT_LIMIT, EXAMPLES, CAPTURED = 5_000, 16, 16
#: Row indexes of a table are below 2 ** INDEX_BITS, so (t, index) is one number.
INDEX_BITS = 40
SORTED = "sorted_row_content"
#: Rows between two that can be told apart, up to which inserted rows are looked for.
STRETCH = 100_000


@dataclass
class Plan:
    """One table: both heads, how its rows are aligned, and the edits and diagnostics so far."""

    t: int
    path: str
    id: int
    left_name: str
    right_name: str
    left: Head
    right: Head
    config: PathConfig
    keys: list[str] = field(default_factory=list)
    mode: str = "positional"  # or configured_key, auto_key, sorted, inserted, uncertain
    edits: list[Edit] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    renames: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        self.common = [c for c in self.left.columns if c in self.right.columns]
        self.removed = [c for c in self.left.columns if c not in self.right.columns]
        self.added = [c for c in self.right.columns if c not in self.left.columns]

    @property
    def keyed(self) -> bool:
        return self.mode in ("configured_key", "auto_key")

    @property
    def names(self) -> list[str]:
        """What positions of changed cells mean: common columns, then renamed ones."""
        return self.common + [b for _, b in self.renames]

    def note(self, severity: str, code: str, message: str) -> None:
        self.diagnostics.append(diagnostic(severity, code, message, self.path))


def _spec(spark, plans: list[Plan], schema: str, row) -> DataFrame:
    return local(spark, [row(p) for p in plans], schema)


def _at(cells: Column, positions: str) -> Column:
    return F.transform(positions, lambda i: F.get(cells, i))


def _keys(cells: Column, positions: str, plans: list[Plan]) -> Column:
    """The cells of a key. Where all tables have keys of as many columns that takes no loop over them."""
    widths = {len(p.keys) for p in plans if p.keys}
    return F.array(*[F.get(cells, F.get(positions, F.lit(i))) for i in range(*widths)]) if len(widths) == 1 else _at(cells, positions)


def _any_blank(key: Column, plans: list[Plan]) -> Column:
    """Whether a cell of the key is blank; one whose first character is seen isn't."""
    blank = lambda x: F.when(F.ascii(x).between(33, 126), False).otherwise(is_blank(x))
    widths = {len(p.keys) for p in plans if p.keys}
    return reduce(or_, (blank(F.get(key, F.lit(i))) for i in range(*widths))) if len(widths) == 1 else F.exists(key, blank)


def _places(p: Plan, side: str) -> tuple[list[int], bool]:
    """Where a side's common columns are among its own, and whether they are all of them, in their order."""
    columns = p.left.columns if side == "l" else p.right.columns
    found = [columns.index(c) for c in p.common]
    return found, found == list(range(len(columns)))


def _common(cells: str, positions: str, whole: str) -> Column:
    """A row's common columns."""
    return F.when(F.col(whole) & (F.size(cells) == F.size(positions)), F.col(cells)).otherwise(_at(F.col(cells), positions))


class Sides:
    """Rows of both sides: t, _row, cells (the whole row), c (its common columns, in one order)."""

    def __init__(self, found: DataFrame):
        self.found = found

    def of(self, plans: list[Plan], side: str) -> DataFrame:
        spec = _spec(self.found.sparkSession, plans, "id int, name string, t int, pos array<int>, whole boolean", lambda p: (p.id, p.left_name if side == "l" else p.right_name, p.t, *_places(p, side)))
        mine = self.found.filter((F.col("kind") == "row") & (F.col("side") == side)).select("id", "name", ROW, "cells")
        return mine.join(spec, ["id", "name"]).select("t", ROW, "cells", _common("cells", "pos", "whole").alias("c"))


# --- which rows correspond ------------------------------------------------------------------------------------------------


def _check_keys(sides: Sides, plans: list[Plan]) -> None:
    """Declared keys hold if they are complete on both sides; else the table is compared by place."""
    declared = []
    for p in plans:
        p.keys = p.config.key_columns or [p.left.columns[i - 1] for i in p.config.key_positions if i <= len(p.left.columns)]
        if p.keys and not all(k in p.common for k in p.keys):
            p.note("warning", "row_identity_missing", f"key columns {p.keys} are not in both tables")
            p.keys, p.mode = [], "positional"
        elif p.keys:
            declared.append(p)
    if not declared:
        return
    spec = _spec(sides.found.sparkSession, declared, "t int, kpos array<int>", lambda p: (p.t, [p.common.index(k) for k in p.keys]))
    key = lambda side: sides.of(declared, side).join(spec, "t").select("t", F.lit(side == "l").alias("is_left"), _keys(F.col("c"), "kpos", declared).alias("key"))
    keys = key("l").unionByName(key("r"))
    repeats = F.bool_or(~F.col("blank") & ((F.col("l") > 1) | (F.col("r") > 1)))
    sides_of = [F.count_if("is_left").alias("l"), F.count_if(~F.col("is_left")).alias("r")]
    # equal keys have equal hashes: only where a hash is there twice the keys themselves are counted
    hashed = keys.select("t", F.xxhash64("t", "key").alias("h"), "is_left", _any_blank(F.col("key"), declared).alias("blank"))
    found = hashed.groupBy("t", "h").agg(F.bool_and("blank").alias("blank"), F.bool_or("blank").alias("some"), *sides_of).groupBy("t").agg(F.bool_or("some").alias("null_key"), repeats.alias("duplicate_key")).collect()
    if unsure := [r["t"] for r in found if r["duplicate_key"]]:
        counted = keys.filter(F.col("t").isin(unsure)).groupBy("t", "key").agg(*sides_of).withColumn("blank", F.exists("key", is_blank))
        exact = {r["t"]: r["duplicate_key"] for r in counted.groupBy("t").agg(repeats.alias("duplicate_key")).collect()}
        found = [{"t": r["t"], "null_key": r["null_key"], "duplicate_key": exact.get(r["t"], False)} for r in found]
    quality = {r["t"]: r for r in found}
    for p in declared:
        wrong = [code for code in ("null_key", "duplicate_key") if p.t in quality and quality[p.t][code]]
        for code in wrong:
            severity = POLICIES[getattr(p.config, f"on_{code}")]
            if severity:
                p.note(severity, f"keyed_row_identity_degraded.{code}", f"{code.replace('_', ' ')}s in {p.keys}: rows are compared by place")
        if wrong:
            p.edits.append(edit("tabular.row_identity_degraded", {}, ("identity-diagnostic", "row-identity-ambiguous", *(c.replace("_", "-") for c in wrong)), False))
            p.keys = []
        else:
            p.mode = "configured_key"


def key_statistics(sides: Sides, plans: list[Plan]) -> dict[int, list[dict]]:
    """By table: its common columns without blank or repeated values: column, common, distinct (values), bytes."""
    if not plans:
        return {}
    values = lambda side: sides.of(plans, side).select("t", F.posexplode("c").alias("pos", "value")).withColumn("side", F.lit(side))
    counted = values("l").unionByName(values("r")).groupBy("t", "pos", "value").agg(F.count_if(F.col("side") == "l").alias("l"), F.count_if(F.col("side") == "r").alias("r"))
    unique = ~F.bool_or(is_blank(F.col("value")) | (F.col("l") > 1) | (F.col("r") > 1))
    found = counted.groupBy("t", "pos").agg(
        unique.alias("is_unique"),
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("common"),
        F.count("*").alias("distinct"),
        F.coalesce(F.sum(F.when(F.col("l") > 0, F.octet_length("value"))), F.lit(0)).alias("bytes"),
    )
    by_t = {p.t: p for p in plans}
    out: dict[int, list[dict]] = defaultdict(list)
    for r in found.filter("is_unique").collect():  # a row for each column that could be a key
        out[r["t"]].append(r.asDict() | {"column": by_t[r["t"]].common[r["pos"]]})
    return out


def _fit(stats: list[dict]) -> list[dict]:
    return [s for s in stats if s["common"] * 100 >= s["distinct"] * int(infer.KEY_OVERLAP * 100)]


def _candidates(stats: list[dict]) -> list[str]:
    """Columns that could be the key, best first: overlap, names like an id, fewest bytes, name."""

    def order(s: dict):
        name = s["column"].lower()
        return (-(s["common"] * 1_000_000 // s["distinct"]), 0 if name == "id" else 1 if name.endswith(("_id", " id")) else 2, s["bytes"], s["column"])

    return [s["column"] for s in sorted(_fit(stats), key=order)[: infer.CANDIDATES]]


def _churn(pairs: DataFrame) -> DataFrame:
    """t, changed_cells, changed_rows, total_rows, moved (rows whose candidate key differs) of aligned rows: lc, rc (null where a side is
    missing), kp (position of a candidate key, or null), m (number of common columns)."""
    both = F.col("lc").isNotNull() & F.col("rc").isNotNull()
    differ = F.size(F.filter(F.zip_with("lc", "rc", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    n = F.when(both, differ).otherwise(F.col("m"))
    other = both & F.col("kp").isNotNull() & ~F.get("lc", F.col("kp")).eqNullSafe(F.get("rc", F.col("kp")))
    marked = pairs.select("t", n.alias("n"), other.alias("other"))
    return marked.groupBy("t").agg(F.sum("n").alias("changed_cells"), F.count_if(F.col("n") > 0).alias("changed_rows"), F.count("*").alias("total_rows"), F.count_if("other").alias("moved"))


def _align_rows(sides: Sides, plans: list[Plan]) -> DataFrame | None:
    """Chooses how the rows of tables without a declared key are aligned. The sorted places of tables that are sorted, if any:
    side, t, place, _row, cells, c."""
    spark = sides.found.sparkSession
    free = [p for p in plans if not p.keyed and p.common]
    if not free:
        return None
    undeclared = [p for p in free if not (p.config.key_columns or p.config.key_positions)]
    stats = key_statistics(sides, [p for p in undeclared if max(p.left.rows, p.right.rows) <= infer.KEY_ROWS])
    guess = {}
    for t, own in stats.items():
        if best := min(_fit(own), key=lambda s: (-s["common"] / s["distinct"], s["bytes"], s["column"]), default=None):
            guess[t] = best
    spec = _spec(spark, free, "t int, kp int, m int", lambda p: (p.t, guess[p.t]["pos"] if p.t in guess else None, len(p.common)))
    side = lambda s: sides.of(free, s).select("t", ROW, F.col("c").alias(f"{s}c"))
    churn = {r["t"]: r for r in _churn(side("l").join(side("r"), ["t", ROW], "full_outer").join(spec, "t")).collect()}
    high = []
    for p in free:
        found = churn.get(p.t)
        if p.t in guess and found and found["moved"]:  # only a key that aligns rows otherwise than their places do is of use
            p.mode, p.keys = "auto_key", [guess[p.t]["column"]]
            p.note("suggestion", "tabular_auto_key", f"rows were matched by {p.keys[0]!r}, which was not declared")
            p.edits.append(edit("tabular.auto_detected_key", {"columns": p.keys, "left_rows": p.left.rows, "right_rows": p.right.rows}, ("row-identity-inferred",), False))
        elif found and p.left.rows == p.right.rows and 2 * found["changed_cells"] > found["total_rows"] * len(p.common) > 0:
            high.append(p)
    if not high:
        return None
    # all tables are sorted at once; a table's first place is the number of rows of those before it
    starts, n = {}, 0
    for p in sorted(high, key=lambda p: p.t):
        starts[p.t], n = n, n + p.left.rows
    start = _spec(spark, high, "t int, start long, kp int, m int", lambda p: (p.t, starts[p.t], None, len(p.common)))

    def ranked(s: str) -> DataFrame:
        keyed = sides.of(high, s).withColumn("_s", F.transform("c", lambda x: F.coalesce(x, F.lit(""))))
        placed = with_row_index(keyed, "t", "_s", ROW, name="_place").drop("_s")
        return placed.join(start.select("t", "start"), "t").select(F.lit(s).alias("side"), "t", (F.col("_place") - F.col("start")).alias("place"), ROW, "cells", "c")

    ordered = keep(ranked("l").unionByName(ranked("r")), "ranked")
    half = lambda s: ordered.filter(F.col("side") == s).select("t", "place", F.col("c").alias(f"{s}c"))
    again = {r["t"]: r for r in _churn(half("l").join(half("r"), ["t", "place"], "full_outer").join(start, "t")).collect()}
    poor = [p for p in high if 2 * again[p.t]["changed_cells"] > again[p.t]["total_rows"] * len(p.common)]
    more = key_statistics(sides, [p for p in poor if p.t not in stats])
    for p in high:
        first, found = churn[p.t], again[p.t]
        total = first["total_rows"] * len(p.common)
        if p in poor:
            candidates = _candidates((stats | more).get(p.t, []))
            if candidates:
                continue
            p.mode = "uncertain"
            params = {"mode": "positional", "changed_cell_fraction": round(first["changed_cells"] / total, 6), "threshold": infer.CHURN_LIMIT, "changed_cells": first["changed_cells"], "total_cells": total}
            params |= {"changed_rows": first["changed_rows"], "total_rows": first["total_rows"], "candidate_keys": []}
            p.edits.append(edit("tabular.row_correspondence_uncertain", params, ("row-correspondence-uncertain",)))
            p.note("suggestion", "tabular_high_churn", "most cells differ: declare a row_identity")
        elif found["changed_cells"] < first["changed_cells"]:
            p.mode = "sorted"
            if found["changed_cells"]:
                params = {"left_rows": p.left.rows, "right_rows": p.right.rows, "changed_cells": found["changed_cells"], "changed_rows": found["changed_rows"]}
                p.edits.append(edit("tabular.sorted_row_alignment", params, ("row-alignment-inferred",), False))
            else:
                p.edits.append(edit("tabular.reorder_rows", {"alignment": SORTED, "rows": p.left.rows}, ("row-reorder",)))
    return ordered


def _inserted(sides: Sides, plans: list[Plan]) -> DataFrame | None:
    """t, _row of the right rows that were put between left ones, of small tables all of whose left rows are found in order."""
    small = [p for p in plans if p.mode == "positional" and p.common and p.left.rows != p.right.rows and max(p.left.rows, p.right.rows) <= rows.LCS_ROWS]
    if not small:
        return None
    sign = lambda s: sides.of(small, s).select("t", ROW, F.lit(s).alias("side"), F.to_json(F.struct("c")).alias("sign"))

    def align(group: pd.DataFrame) -> pd.DataFrame:  # at most LCS_ROWS rows a side
        group = group.sort_values(ROW)
        a, b = (group[group["side"] == s] for s in "lr")
        pairs = rows.lcs_pairs(a["sign"].tolist(), b["sign"].tolist())
        if len(pairs) < len(a):
            return pd.DataFrame({"t": [], ROW: []}, dtype="int64")
        kept = {j for _, j in pairs}
        left_over = [-1, *(int(r) for j, r in enumerate(b[ROW]) if j not in kept)]
        return pd.DataFrame({"t": int(group["t"].iloc[0]), ROW: left_over})

    found = keep(sign("l").unionByName(sign("r")).groupBy("t").applyInPandas(align, f"t int, {ROW} long"), "inserted")
    aligned = {r["t"] for r in found.filter(F.col(ROW) == -1).collect()}
    for p in small:
        if p.t in aligned:
            p.mode = "inserted"
    return found.filter(F.col(ROW) >= 0)


def _inserted_large(sides: Sides, plans: list[Plan]) -> DataFrame | None:
    """As _inserted, of tables of any size. Rows that are as frequent on both sides can only be matched each with its like, first with
    first; these forced matches must rise on both sides. Between two of them what is left is matched from the front, a stretch at a time."""
    large = [p for p in plans if p.mode == "positional" and p.common and p.left.rows < p.right.rows and p.right.rows > rows.LCS_ROWS]
    if not large:
        return None
    sign = lambda s: keep(sides.of(large, s).select("t", ROW, F.sha2(F.to_json(F.struct("c")), 256).alias("sign")), "signs")
    left, right = sign("l"), sign("r")
    both = left.withColumn("l", F.lit(1)).withColumn("r", F.lit(0)).unionByName(right.withColumn("l", F.lit(0)).withColumn("r", F.lit(1)))
    counts = keep(both.groupBy("t", "sign").agg(F.sum("l").alias("l"), F.sum("r").alias("r")), "counts")
    lost = {r["t"] for r in counts.filter("l > r").select("t").distinct().collect()}
    able = [p for p in large if p.t not in lost]
    if not able:
        return None
    forced = counts.filter("l = r").select("t", "sign")

    def ranked(df: DataFrame, by: list[str]) -> DataFrame:
        """Adds rank: the place of a row within `by`."""
        placed = keep(with_row_index(df, *by, ROW, name="_i"), "ranked")
        return placed.join(placed.groupBy(*by).agg(F.min("_i").alias("_s")), by).withColumn("rank", F.col("_i") - F.col("_s")).drop("_i", "_s")

    mine = lambda df: df.filter(F.col("t").isin([p.t for p in able]))
    one, two = (ranked(mine(df).join(forced, ["t", "sign"]), ["t", "sign"]) for df in (left, right))
    pairs = one.withColumnRenamed(ROW, "l_row").join(two.withColumnRenamed(ROW, "r_row"), ["t", "sign", "rank"]).select("t", F.col("l_row").alias(ROW), "r_row")
    ordered = keep(with_row_index(pairs, "t", ROW, name="_i"), "matched")
    after = ordered.select("t", (F.col("_i") - 1).alias("_i"), F.col("r_row").alias("next"))
    crossed = {r["t"] for r in ordered.join(after, ["t", "_i"]).filter("next < r_row").select("t").distinct().collect()}
    able = [p for p in able if p.t not in crossed]
    if not able:
        return None
    # what isn't forced, with the number of forced matches before it
    free = lambda df, side: ranked(mine(df).join(forced, ["t", "sign"], "left_anti"), ["t"]).select("t", (F.col(ROW) - F.col("rank")).alias("stretch"), ROW, "sign", F.lit(side).alias("side"))
    rest = keep(free(left, "l").unionByName(free(right, "r")), "stretches")
    sizes = rest.groupBy("t", "stretch").agg(F.count("*").alias("n"), F.count_if(F.col("side") == "l").alias("l"))
    long = {r["t"] for r in sizes.filter((F.col("n") > STRETCH) & (F.col("l") > 0)).select("t").distinct().collect()}
    for p in able:
        if p.t in long:
            p.note("warning", "row_alignment_limit", f"more than {STRETCH:,} rows between rows that can be told apart: rows are compared by place")
    able = [p for p in able if p.t not in long]
    if not able:
        return None
    alone = mine(rest.join(sizes.filter("l = 0"), ["t", "stretch"], "left_semi")).select("t", ROW)

    def walk(group: pd.DataFrame) -> pd.DataFrame:  # at most STRETCH rows
        group = group.sort_values(ROW)
        wanted = iter(group[group["side"] == "l"]["sign"].tolist())
        at, over = next(wanted, None), []
        for row, own in zip(group[group["side"] == "r"][ROW], group[group["side"] == "r"]["sign"], strict=True):
            if own == at:
                at = next(wanted, None)
            else:
                over.append(int(row))
        return pd.DataFrame({"t": int(group["t"].iloc[0]), ROW: over if at is None else [*over, -1]}, dtype="int64")

    mixed = mine(rest.join(sizes.filter("l > 0").select("t", "stretch"), ["t", "stretch"])).groupBy("t", "stretch").applyInPandas(walk, f"t int, {ROW} long")
    found = keep(alone.unionByName(mixed), "inserted")
    failed = {r["t"] for r in found.filter(F.col(ROW) < 0).select("t").distinct().collect()}
    for p in able:
        if p.t not in failed:
            p.mode = "inserted"
    return found.filter((F.col(ROW) >= 0) & ~F.col("t").isin(sorted(failed)))


# --- what changed -------------------------------------------------------------------------------------------------------------


def _hashed(df: DataFrame, align: str) -> DataFrame:
    """With a number for what rows meet by, so that a sort compares numbers."""
    return df.withColumn("h", F.xxhash64("t", align))


def _changes(sides: Sides, plans: list[Plan], ordered: DataFrame | None, inserted: DataFrame | None) -> DataFrame:
    """Kept: t, key, l_row, r_row, lcells (of removed rows and tables that may have renamed columns), rcells (added rows, the same), diff
    (pos, from, to of changed common cells) of the aligned rows that say anything. One that is only at another place doesn't: after a row
    that went, or came, that is each one."""
    spark = sides.found.sparkSession
    aligned = [p for p in plans if p.mode not in ("uncertain", "inserted")]
    out = None
    if aligned:
        schema = "t int, keyed boolean, kpos array<int>, rename boolean, lpos array<int>, lwhole boolean, rpos array<int>, rwhole boolean"
        spec = _spec(spark, aligned, schema, lambda p: (p.t, p.keyed, [p.common.index(k) for k in p.keys] if p.keyed else [], _may_rename(p), *_places(p, "l"), *_places(p, "r")))

        def side(s: str) -> DataFrame:
            own = sides.of([p for p in aligned if p.mode != "sorted"], s).withColumn("place", F.col(ROW)) if any(p.mode != "sorted" for p in aligned) else None
            ranks = [p.t for p in aligned if p.mode == "sorted"]
            if ranks:
                placed = ordered.filter((F.col("side") == s) & F.col("t").isin(ranks)).drop("side")
                own = placed if own is None else own.unionByName(placed)
            align = F.when(F.col("keyed"), _keys(F.col("c"), "kpos", [p for p in aligned if p.keyed])).otherwise(F.array(F.col("place").cast("string")))
            return _hashed(own.join(spec.select("t", "keyed", "kpos"), "t").select("t", align.alias("align"), F.struct(ROW, "cells").alias(s)), "align")

        pairs = side("l").join(side("r"), ["h", "t", "align"], "full_outer").join(spec.drop("kpos"), "t")
        pairs = pairs.withColumns({f"{s}c": F.when(F.col(s).isNotNull(), _common(f"{s}.cells", f"{s}pos", f"{s}whole")) for s in "lr"})
        gone, came = F.col("r").isNull(), F.col("l").isNull()
        each = F.transform(F.zip_with("lc", "rc", lambda a, b: F.struct(a.alias("from"), b.alias("to"))), lambda x, i: F.struct(i.alias("pos"), x["from"].alias("from"), x["to"].alias("to")))
        diff = F.when(~gone & ~came, F.filter(each, lambda x: ~x["from"].eqNullSafe(x["to"])))
        pairs = pairs.filter(gone | came | F.col("rename") | ~F.col("lc").eqNullSafe(F.col("rc")))
        out = pairs.select(
            "t",
            F.when(F.col("keyed"), F.col("align")).alias("key"),
            F.col(f"l.{ROW}").alias("l_row"),
            F.col(f"r.{ROW}").alias("r_row"),
            F.when(gone | F.col("rename"), F.col("l.cells")).alias("lcells"),
            F.when(came | F.col("rename"), F.col("r.cells")).alias("rcells"),
            diff.alias("diff"),
        )
    placed = [p for p in plans if p.mode == "inserted"]
    if placed:
        cells = sides.of(placed, "r").join(inserted.select("t", ROW), ["t", ROW])
        none = lambda kind: F.lit(None).cast(kind)
        pair = "array<struct<pos:int,from:string,to:string>>"
        more = cells.select("t", none("array<string>").alias("key"), none("long").alias("l_row"), F.col(ROW).alias("r_row"), none("array<string>").alias("lcells"), F.col("cells").alias("rcells"), none(pair).alias("diff"))
        out = more if out is None else out.unionByName(more)
    return keep(out, "changes")


def _may_rename(p: Plan) -> bool:
    return bool(p.removed and p.added) and (p.keyed or (p.left.rows == p.right.rows and p.mode != "uncertain"))


def _find_renames(changes: DataFrame, plans: list[Plan]) -> None:
    """Removed and added columns whose values agree in aligned rows."""
    able = [p for p in plans if _may_rename(p)]
    if not able:
        return
    spec = _spec(changes.sparkSession, able, "t int, gone array<int>, came array<int>", lambda p: (p.t, [p.left.columns.index(c) for c in p.removed], [p.right.columns.index(c) for c in p.added]))
    both = changes.filter("l_row IS NOT NULL AND r_row IS NOT NULL").join(spec, "t")
    left = both.select("t", F.explode("gone").alias("a"), "came", "lcells", "rcells").select("t", "a", F.explode("came").alias("b"), F.get("lcells", F.col("a")).alias("x"), "rcells")
    same = left.select("t", "a", "b", (F.col("x").eqNullSafe(F.get("rcells", F.col("b"))) & ~is_blank(F.col("x"))).alias("same"))
    by_t = {p.t: p for p in able}
    scored = defaultdict(list)
    for r in same.groupBy("t", "a", "b").agg(F.count_if("same").alias("equal"), F.count("*").alias("rows")).collect():  # columns squared
        if r["equal"] >= infer.RENAME_VALUES and r["equal"] * 100 >= r["rows"] * int(infer.RENAME_SHARE * 100):
            p = by_t[r["t"]]
            scored[r["t"]].append((r["equal"], p.left.columns[r["a"]], p.right.columns[r["b"]]))
    for t, found in scored.items():
        by_t[t].renames = infer.assign(found)


# --- costs and classes of edits ---------------------------------------------------------------------------------------------


def _size(c: Column) -> Column:
    return F.when(c.isNull(), 1).otherwise(1 + F.floor(F.length(c) / 16)).cast("long")


def _sizes(cells: Column, width: Column) -> Column:
    """The cost of a row's values; missing cells at its end count as nulls."""
    return F.aggregate(cells, F.lit(0).cast("long"), lambda acc, x: acc + _size(x)) + F.greatest(width - F.size(cells), F.lit(0))


NO_OP, HIDDEN, ROUNDED, OTHER = "noop", "suppressed", "rounded", "other"


def _each_edit(changes: DataFrame, plans: list[Plan], sentinels: tuple[str, ...]) -> DataFrame:
    """t, kind (remove, add, cell), key, l_row, r_row, cells, pos, from, to, cost, class, modulus: every single edit."""
    named = lambda names: 1 + sum(value_size(n) for n in names)

    def row(p: Plan) -> tuple:
        cell_base = {"sorted": value_size("left_row") * 2 + 2 + value_size("alignment") + value_size(SORTED)}.get(p.mode, value_size("row") + 1)
        gone, came = [p.left.columns.index(a) for a, _ in p.renames], [p.right.columns.index(b) for _, b in p.renames]
        key = value_size("key") + named(p.keys) if p.keyed else None
        return (p.t, key, cell_base, [value_size(n) for n in p.names], named(p.left.columns), named(p.right.columns), len(p.left.columns), len(p.right.columns), len(p.common), gone, came)

    schema = "t int, key_cost int, base int, name_cost array<int>, l_names int, r_names int, l_width int, r_width int, m int, gone array<int>, came array<int>"
    with_spec = changes.join(_spec(changes.sparkSession, plans, schema, row), "t")
    key = F.when(F.col("key_cost").isNotNull(), F.col("key_cost") + F.aggregate("key", F.lit(0).cast("long"), lambda acc, x: acc + _size(x))).otherwise(0).cast("long")
    whole = lambda names, cells, width: 2 + value_size("index") + 1 + key + value_size("values") + F.col(names) + _sizes(F.col(cells), F.col(width))
    same = ["t", "key", "l_row", "r_row"]
    none = lambda kind: F.lit(None).cast(kind)
    cell_columns = [none("int").alias("pos"), none("string").alias("from"), none("string").alias("to")]
    gone = with_spec.filter("r_row IS NULL").select(*same, F.lit("remove").alias("kind"), F.col("lcells").alias("cells"), whole("l_names", "lcells", "l_width").alias("cost"), *cell_columns)
    came = with_spec.filter("l_row IS NULL").select(*same, F.lit("add").alias("kind"), F.col("rcells").alias("cells"), whole("r_names", "rcells", "r_width").alias("cost"), *cell_columns)
    renamed = F.zip_with("gone", "came", lambda a, b: F.struct(F.array_position("gone", a).alias("k"), F.get("lcells", a).alias("from"), F.get("rcells", b).alias("to")))
    renamed = F.transform(F.filter(renamed, lambda x: ~x["from"].eqNullSafe(x["to"])), lambda x: F.struct((F.col("m") + x["k"].cast("int") - 1).alias("pos"), x["from"].alias("from"), x["to"].alias("to")))
    both = with_spec.filter("l_row IS NOT NULL AND r_row IS NOT NULL")
    exploded = both.select(*same, key.alias("k"), "base", "name_cost", F.explode(F.when(F.size("gone") > 0, F.concat("diff", renamed)).otherwise(F.col("diff"))).alias("e")).select(*same, "k", "base", "name_cost", "e.*")
    place = F.when(F.col("key").isNotNull(), F.col("k")).otherwise(F.col("base"))
    cell_cost = 2 + place + value_size("column") + F.get("name_cost", F.col("pos")) + value_size("from") + _size(F.col("from")) + value_size("to") + _size(F.col("to"))
    cells = exploded.select(*same, F.lit("cell").alias("kind"), none("array<string>").alias("cells"), cell_cost.cast("long").alias("cost"), "pos", "from", "to")
    old, new = unmarked(F.col("from")), unmarked(F.col("to"))
    modulus = rounding_modulus(old, new)
    kind = F.when(F.coalesce(decimal(old) == decimal(new), F.lit(False)) & (kind_of(F.col("from")) == kind_of(F.col("to"))), NO_OP)
    kind = kind.when(is_suppressed(F.col("from"), F.col("to"), sentinels) | (is_suppressed(old, F.col("to"), sentinels) & F.startswith("from", F.lit(""))), HIDDEN)
    kind = kind.when(F.col("modulus").isNotNull(), ROUNDED).otherwise(OTHER)
    cells = cells.withColumn("modulus", modulus).withColumn("class", kind).withColumn("modulus", F.when(F.col("class") == ROUNDED, F.col("modulus")))
    rest = gone.unionByName(came).withColumns({"modulus": none("long"), "class": none("string")})
    return rest.unionByName(cells)


def _statistics(each: DataFrame) -> dict[int, list]:
    """By table, a row for each (kind, column, class, modulus): n, cost, and whether all of it only changes types in one way."""
    types = F.struct(kind_of(F.col("from")).alias("a"), kind_of(F.col("to")).alias("b"))
    retyped = F.coalesce(F.array_sort(F.array(kind_of(F.col("from")), kind_of(F.col("to")))) == F.array(F.lit("number"), F.lit("string")), F.lit(False)) & unmarked(F.col("from")).eqNullSafe(unmarked(F.col("to")))
    found = each.groupBy("t", "kind", "pos", "class", "modulus").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.min(types).alias("first"), F.max(types).alias("last"), F.bool_and(retyped).alias("retyped"))
    out: dict[int, list] = defaultdict(list)
    for r in found.collect():  # a few rows for each column
        out[r["t"]].append(r)
    return out


@dataclass
class Shown:
    """What of a table's edits is replaced by grouped ones, and what is left."""

    retyped: list[int] = field(default_factory=list)
    precise: bool = False
    rounded: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    runs: list[tuple[int, int]] = field(default_factory=list)

    @property
    def whole(self) -> bool:
        return sum(n for k, n in self.counts.items() if not (self.runs and k == "add")) <= EDIT_LIMIT


def _long_runs(changes: DataFrame, shown: dict[int, Shown]) -> None:
    """Finds the runs of added rows of the tables that have too many edits; where these are at most EXAMPLES runs, rows count as runs."""
    many = [t for t, s in shown.items() if not s.whole and s.counts.get("add")]
    if not many:
        return
    index = changes.filter(F.col("l_row").isNull() & F.col("t").isin(many)).select((F.shiftleft(F.col("t").cast("long"), INDEX_BITS) + F.col("r_row")).alias(ROW))
    own = rows.runs_of(index).withColumn("t", F.shiftright("start", INDEX_BITS).cast("int"))
    few = own.withColumn("place", F.row_number().over(Window.partitionBy("t").orderBy("start"))).filter(F.col("place") <= EXAMPLES + 1)
    found = defaultdict(list)
    for r in few.collect():
        found[r["t"]].append((r["start"] & ((1 << INDEX_BITS) - 1), r["rows"]))
    for t, runs in found.items():
        if len(runs) <= EXAMPLES:
            shown[t].runs = sorted(runs)


# --- all tables -----------------------------------------------------------------------------------------------------------------


def compare(found: DataFrame, plans: list[Plan], sentinels: tuple[str, ...]) -> None:
    """Fills in the edits and diagnostics of all plans. found: kept rows of reading (kind, id, side, name, _row, cells)."""
    if not plans:
        return
    sides = Sides(found)
    for p in plans:
        if p.left.columns != p.right.columns:
            p.edits.append(edit("tabular.set_headers", {"from": p.left.columns, "to": p.right.columns}, ()))
    _capture(sides, plans)
    _check_keys(sides, plans)
    ordered = _align_rows(sides, plans)
    inserted = _inserted(sides, plans)
    if (more := _inserted_large(sides, plans)) is not None:
        inserted = more if inserted is None else inserted.unionByName(more)
    alike = [p for p in plans if p.mode != "uncertain"]
    for p in plans:
        if p.left.meta != p.right.meta:
            p.edits.append(metadata_edit(p.left.meta, p.right.meta, "table"))
    if alike:
        changes = _changes(sides, alike, ordered, inserted)
        _find_renames(changes, alike)
        each = keep(_each_edit(changes, alike, sentinels), "edits")
        stats = _statistics(each)
        moved = _moved(sides, [p for p in alike if p.keyed and p.t not in stats and set(p.left.columns) == set(p.right.columns)])
        shown = {}
        for p in alike:
            if p.t in moved:
                p.edits.append(edit("tabular.reorder_rows", {"alignment": p.mode, "rows": p.right.rows, "keys": p.keys}, ("row-reorder",)))
            shown[p.t] = _compact(p, stats.get(p.t, []))
        _long_runs(changes, shown)
        _list(each, [p for p in alike if shown[p.t].counts], shown)
    for p in plans:
        if (new := reordered_columns(p.edits)) is not None and cost(new) < cost(p.edits):
            p.edits = new


def _capture(sides: Sides, plans: list[Plan]) -> None:
    """remove_column and add_column edits with the columns' first values."""
    for side, verb, tags in (("l", "tabular.remove_column", ("column-removal", "schema-change")), ("r", "tabular.add_column", ("column-addition", "schema-change"))):
        own = [p for p in plans if (p.removed if side == "l" else p.added)]
        first = defaultdict(list)
        if own:
            for r in sides.of(own, side).filter(F.col(ROW) < CAPTURED).select("t", ROW, "cells").collect():
                first[r["t"]].append((r[ROW], r["cells"]))
        for p in own:
            head = p.left if side == "l" else p.right
            for c in p.removed if side == "l" else p.added:
                i = head.columns.index(c)
                values = [cells[i] if i < len(cells) else None for _, cells in sorted(first[p.t], key=lambda x: x[0])]
                p.edits.append(edit(verb, {"name": c, "values": {"values": values, "total_values": head.rows, "truncated": head.rows > len(values)}}, tags))


def _moved(sides: Sides, plans: list[Plan]) -> set[int]:
    """Keyed tables without other edits whose rows changed their places."""
    if not plans:
        return set()
    spec = _spec(sides.found.sparkSession, plans, "t int, kpos array<int>", lambda p: (p.t, [p.common.index(k) for k in p.keys]))
    side = lambda s: _hashed(sides.of(plans, s).join(spec, "t").select("t", _keys(F.col("c"), "kpos", plans).alias("key"), F.col(ROW).alias(s)), "key")
    return {r["t"] for r in side("l").join(side("r"), ["h", "t", "key"]).filter("l <> r").select("t").distinct().collect()}


def _compact(p: Plan, stats: list) -> Shown:
    """Decides the rewrites from counts and costs, in their order; each counts if it costs less. Adds the grouped edits to the plan."""
    m = len(p.common)
    fixed = p.edits
    if p.renames:
        extra = sum(r["cost"] for r in stats if r["kind"] == "cell" and r["pos"] >= m)
        new = renamed_columns(fixed, p.renames)
        if new is not None and cost(new) + extra < cost(fixed):
            p.edits = new
        else:
            stats = [r for r in stats if r["pos"] is None or r["pos"] < m]
            p.renames = []
    out = Shown()
    cells = [r for r in stats if r["kind"] == "cell"]
    by_column = defaultdict(list)
    for r in cells:
        by_column[r["pos"]].append(r)
    retyped, saved = {}, 0
    for pos, own in by_column.items():
        if all(r["retyped"] for r in own) and len({r["first"] for r in own} | {r["last"] for r in own}) == 1:
            a, b = own[0]["first"]
            params = {"column": p.names[pos], "from_type": a, "to_type": b, "cells": sum(r["n"] for r in own)}
            retyped[pos] = edit("tabular.column_type_changed", params, ("column-type-change", "schema-change"))
            saved += sum(r["cost"] for r in own) - cost([retyped[pos]])
    if retyped and saved > 0:
        out.retyped = sorted(retyped)
        p.edits = [*p.edits, *retyped.values()]
        cells = [r for r in cells if r["pos"] not in retyped]
    dropped = [r for r in cells if r["class"] == NO_OP]
    hidden: dict[int, list] = defaultdict(list)
    for r in cells:
        if r["class"] == HIDDEN:
            hidden[r["pos"]].append(r)
    rounded = [r for r in cells if r["class"] == ROUNDED and r["n"] > 1]
    grouped = [edit("tabular.values_rounded", {"column": p.names[r["pos"]], "cells": r["n"], "basis": {"kind": "modulus", "value": r["modulus"]}}, ("value-rounded", "cell-change")) for r in rounded]
    grouped += [edit("tabular.values_suppressed", {"column": p.names[c], "cells": sum(r["n"] for r in own)}, ("value-suppressed", "cell-change")) for c, own in hidden.items()]
    taken = [*dropped, *rounded, *(r for own in hidden.values() for r in own)]
    if taken and cost(grouped) < sum(r["cost"] for r in taken):
        out.precise, out.rounded = True, [f"{r['pos']}:{r['modulus']}" for r in rounded]
        cells = [r for r in cells if r not in taken]
        p.edits = [*p.edits, *grouped]
        others = any(r["kind"] != "cell" for r in stats)
        if dropped and not cells and not others and not any(e["visible"] for e in p.edits):
            p.edits = [*p.edits, edit("tabular.numeric_canonical_equal", {"reason": "numbers are equal"}, (), False)]
    found = {k: sum(r["n"] for r in stats if r["kind"] == k) for k in ("remove", "add")} | {"cell": sum(r["n"] for r in cells)}
    out.counts = {k: n for k, n in found.items() if n}
    return out


def _list(each: DataFrame, plans: list[Plan], shown: dict[int, Shown]) -> None:
    """Adds the edits that no group replaces: all of them up to EDIT_LIMIT (a long run of added rows as one), else a summary with the
    first EXAMPLES of each kind."""
    if not plans:
        return
    spec = _spec(
        each.sparkSession,
        plans,
        "t int, whole boolean, starts array<long>, retyped array<int>, precise boolean, rounded array<string>, m int",
        lambda p: (p.t, shown[p.t].whole, [start for start, _ in shown[p.t].runs], shown[p.t].retyped, shown[p.t].precise, shown[p.t].rounded, len(p.names)),
    )
    joined = each.join(spec, "t")
    rounded = (F.col("class") == ROUNDED) & F.array_contains("rounded", F.concat_ws(":", F.col("pos").cast("string"), F.col("modulus").cast("string")))
    told = F.array_contains("retyped", F.col("pos")) | (F.col("precise") & (F.col("class").isin(NO_OP, HIDDEN) | rounded))
    first = (F.size("starts") == 0) | (F.col("kind") != "add") | F.exists("starts", lambda s: (F.col("r_row") >= s) & (F.col("r_row") < s + EXAMPLES))
    left = joined.filter(first & ((F.col("kind") != "cell") | ((F.col("pos") < F.col("m")) & ~F.coalesce(told, F.lit(False)))))
    left = left.select("t", "whole", "kind", "key", "l_row", "r_row", "cells", "pos", "from", "to")
    place = F.row_number().over(Window.partitionBy("t", "kind").orderBy("key", F.coalesce("l_row", "r_row"), "pos"))
    some = left.filter("NOT whole").withColumn("place", place).filter(F.col("place") <= EXAMPLES).drop("place")
    by_t: dict[int, dict[str, list]] = defaultdict(lambda: defaultdict(list))
    for r in left.filter("whole").unionByName(some).collect():  # at most EDIT_LIMIT rows for each table
        by_t[r["t"]][r["kind"]].append(r)
    for p in plans:
        p.edits = [*p.edits, *_listed(p, shown[p.t], by_t[p.t])]


def _listed(p: Plan, shown: Shown, found: dict[str, list]) -> list[Edit]:
    order = lambda r: (r["key"] or [], r["l_row"] if r["l_row"] is not None else r["r_row"], r["pos"] or 0)
    own = {k: sorted(v, key=order) for k, v in found.items()}
    key = lambda r: {"key": dict(zip(p.keys, r["key"], strict=True))} if p.keyed else {}
    values = lambda cells, columns: {c: cells[i] if i < len(cells) else None for i, c in enumerate(columns)}

    def place(r) -> dict:
        return key(r) if p.keyed else {"left_row": r["l_row"], "right_row": r["r_row"], "alignment": SORTED} if p.mode == "sorted" else {"row": r["l_row"]}

    removed = [edit("tabular.remove_row", {"index": r["l_row"], **key(r), "values": values(r["cells"], p.left.columns)}, ("row-removal",)) for r in own.get("remove", [])]
    added = [edit("tabular.add_row", {"index": r["r_row"], **key(r), "values": values(r["cells"], p.right.columns)}, ("row-addition",)) for r in own.get("add", [])]
    changed = [edit("tabular.edit_cell", {**place(r), "column": p.names[r["pos"]], "from": r["from"], "to": r["to"]}, ("cell-change",)) for r in own.get("cell", [])]
    if shown.whole and shown.runs:
        by_row = {e["params"]["index"]: e["params"]["values"] for e in added}
        runs = [(start, n, [by_row[i] for i in range(start, start + min(n, EXAMPLES))]) for start, n in shown.runs]
        return removed + changed + [edit("tabular.append_rows", {"start": start, "rows": some, "row_count": n, "truncated": n > len(some)}, ("row-addition",)) for start, n, some in runs]
    if shown.whole:
        listed = removed + added + changed
        new = appended_rows(listed)
        return new if new is not None and cost(new) < cost(listed) else listed
    counts = [shown.counts.get(k, 0) for k in ("remove", "add", "cell")]
    tags = [t for t, n in zip(("row-removal", "row-addition", "cell-change"), counts, strict=True) if n]
    examples = {"removed": [e["params"] for e in removed], "added": [e["params"] for e in added[:EXAMPLES]], "modified": [e["params"] for e in changed], "truncated": True}
    params = {"keys": p.keys if p.keyed else [], "rows_removed": counts[0], "rows_added": counts[1], "cells_changed": counts[2], "examples": examples}
    return [edit("tabular.keyed_stream_summary", params, tuple(tags))]


def metadata_edit(a: dict, b: dict, scope: str) -> Edit:
    changes = []
    for k in sorted(a.keys() | b.keys()):
        if a.get(k) != b.get(k):
            kind = "add" if k not in a else "remove" if k not in b else "change"
            changes.append({"kind": kind, "key": k, "from": a.get(k), "to": b.get(k)})
    return edit("metadata.value_change", {"scope": scope, "changes": changes[:32], "examples_truncated": len(changes) > 32}, ("metadata-change", f"metadata.{scope}"))
