"""Row correspondence and cell changes."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import cells
from tidemark.operators import infer, precision, rows
from tidemark.operators.compact import appended_rows, compacted, cost, edit, renamed_columns, reordered_columns
from tidemark.operators.order import ROW, with_row_index

A = [("1", "ann", "10"), ("2", "bob", "20"), ("3", "cy", None)]
B = [("3", "cy", "30"), ("1", "ann", "10"), ("4", "di", "40")]


def frame(spark, data, columns=("id", "name", "v")):
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))


def test_keyed(spark):
    a, b = frame(spark, A), frame(spark, B)
    assert [tuple(r) for r in rows.keyed_cells(a, b, ["id"]).collect()] == [("3", "v", None, "30")]
    assert [r["id"] for r in rows.rows_added(a, b, ["id"]).collect()] == ["4"]
    assert [r["id"] for r in rows.rows_removed(a, b, ["id"]).collect()] == ["2"]
    assert rows.keyed_summary(a, b, ["id"]).first().asDict() == {"rows_added": 1, "rows_removed": 1, "rows_changed": 1, "rows_equal": 1, "cells_changed": 1}


def test_key_quality(spark):
    df = frame(spark, [("1", "a", "x"), ("1", "b", "y"), (" \t", "c", "z"), (None, "d", "w")])
    assert rows.key_quality(df, ["id"]).first().asDict() == {"rows": 4, "null_keys": 2, "duplicate_keys": 1, "duplicate_rows": 2}
    assert not rows.keys_complete(df, ["id"])


def test_row_index_is_gapless(spark):
    df = spark.range(1000).repartition(7)
    assert sorted(r[ROW] for r in with_row_index(df, "id").collect()) == list(range(1000))
    assert all(r["id"] == r[ROW] for r in with_row_index(df, "id").collect())


def test_positional_and_sorted(spark):
    a = with_row_index(frame(spark, A).coalesce(1))
    b = with_row_index(frame(spark, [A[1], A[0], A[2]]).coalesce(1))
    assert rows.positional_cells(a, b).count() == 6
    assert rows.sorted_cells(a, b).count() == 0
    assert rows.churn(a, b).first()["changed_cells"] == 6


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["x", "y", None])), unique_by=lambda r: r[0], max_size=8), other=st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["x", "y", None])), unique_by=lambda r: r[0], max_size=8))
def test_keyed_properties(spark, data, other):
    a, b = (spark.createDataFrame(d, "id long, v string") for d in (data, other))
    s, t = rows.keyed_summary(a, b, ["id"]).first(), rows.keyed_summary(b, a, ["id"]).first()
    assert (s["rows_added"], s["rows_removed"], s["cells_changed"]) == (t["rows_removed"], t["rows_added"], t["cells_changed"])
    same = rows.keyed_summary(a, a, ["id"]).first()
    assert (same["rows_added"], same["rows_removed"], same["cells_changed"]) == (0, 0, 0)
    patched = dict(data)
    for r in rows.rows_removed(a, b, ["id"]).collect():
        del patched[r["id"]]
    patched |= {r["id"]: r["v"] for r in rows.rows_added(a, b, ["id"]).collect()}
    patched |= {int(r["id"]): r["to"] for r in rows.keyed_cells(a, b, ["id"]).collect()}
    assert patched == dict(other)


def test_runs_over_block_borders(spark):
    index = spark.range(65_530, 65_545).filter("id <> 65540").select(F.col("id").alias(ROW))
    assert sorted(tuple(r) for r in rows.runs_of(index).select("start", "rows").collect()) == [(65_530, 10), (65_541, 4)]


def test_lcs(spark):
    assert rows.lcs_pairs(list("abcbd"), list("bcd")) == [(1, 0), (2, 1), (4, 2)]
    a = spark.createDataFrame([(1, i, c) for i, c in enumerate("abcd")], f"g int, {ROW} long, c string")
    b = spark.createDataFrame([(1, i, c) for i, c in enumerate("xacd")], f"g int, {ROW} long, c string")
    assert sorted((r["left_row"], r["right_row"]) for r in rows.lcs_alignment(a, b, ["g"]).collect()) == [(0, 1), (2, 2), (3, 3)]


def test_infer_key_and_rename(spark):
    a = frame(spark, [("k1", "1", "p"), ("k2", "1", "q"), ("k3", "2", "r")], ("code", "n", "old"))
    b = frame(spark, [("k3", "2", "r"), ("k1", "1", "p"), ("k2", "1", "q")], ("code", "n", "new"))
    assert infer.infer_key(a, b) == "code"
    scores = infer.rename_scores(a, b, ["code"], ["old"], ["new"]).collect()
    assert [(r["removed"], r["added"], r["equal"]) for r in scores] == [("old", "new", 3)]
    assert infer.assign([(3, "a", "x"), (5, "a", "y"), (4, "b", "y")]) == [("a", "y")]


def test_decimals(spark):
    texts = ["0", "007", "1,234", "12,34", "-1.50", "1e3", " 7", "", None, "1" * 37]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(cells.is_decimal(F.col("t"))).collect()] == [True, False, True, False, True, True, False, False, False, False]


def test_precision(spark):
    edits = spark.createDataFrame([("v", "1234", "1000"), ("v", "4567", "5000"), ("v", "9", "*"), ("w", "x", ""), ("w", "12", ""), ("w", "1.0", "1")], "column string, from string, to string")
    assert [tuple(r) for r in precision.rounded(edits).collect()] == [("v", 1000, 2)]
    assert {tuple(r) for r in precision.suppressed(edits).collect()} == {("v", 1), ("w", 1)}
    assert precision.without_noops(edits).count() == 5


def test_compaction():
    adds = [edit("tabular.add_row", {"index": i, "values": {"a": str(i)}}) for i in (3, 4, 5, 9)]
    out = compacted(adds, [appended_rows])
    assert [e["verb"] for e in out] == ["tabular.append_rows", "tabular.add_row"] and cost(out) < cost(adds)
    headers = edit("tabular.set_headers", {"from": ["a", "b"], "to": ["a", "c"]})
    renamed = renamed_columns([headers, edit("tabular.remove_column", {"name": "b"}), edit("tabular.add_column", {"name": "c"})], [("b", "c")])
    assert [e["verb"] for e in renamed] == ["tabular.rename_column"]
    assert reordered_columns([edit("tabular.set_headers", {"from": ["a", "b", "c"], "to": ["c", "a", "b"]})])[0]["params"]["order"] == ["c", "a", "b"]


def test_sorted_edits_beyond_the_limit_are_summed_up(spark, monkeypatch):
    from tidemark.config import PathConfig
    from tidemark.plans import compare
    from tidemark.plans.reading import READ, Head

    left, right = ([(f"{i:03}", "x") for i in range(40)], [(f"{i:03}", "y" if i % 2 else "x") for i in range(40)][::-1])
    found = spark.createDataFrame([("row", 0, side, "", i, list(r), None) for side, data in (("l", left), ("r", right)) for i, r in enumerate(data)], READ)

    def edits():
        plan = compare.Plan(0, "t", 0, "", "", Head(["a", "b"], rows=40), Head(["a", "b"], rows=40), PathConfig())
        monkeypatch.setattr(compare.infer, "KEY_ROWS", 0)  # no key is looked for
        compare.compare(found, [plan], ())
        return plan.edits

    whole = edits()
    assert sum(e["verb"] == "tabular.edit_cell" for e in whole) == 20
    monkeypatch.setattr(compare, "EDIT_LIMIT", 5)
    summed = edits()[-1]["params"]
    assert summed["cells_changed"] == 20 and summed["examples"]["truncated"] and len(summed["examples"]["modified"]) == 16


def test_byte_changes_of_a_null_side(spark):
    from tidemark.operators.binary import byte_changes

    pairs = spark.createDataFrame([(1, None, bytearray(b"abc")), (2, bytearray(b"abc"), bytearray(b"abc"))], "k long, l binary, r binary")
    found = {r["k"]: (r["left_size"], r["right_size"]) for r in byte_changes(pairs, ["k"]).collect()}
    assert found == {1: (0, 3), 2: (3, 3)}
