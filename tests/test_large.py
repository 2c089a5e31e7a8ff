"""Files beyond `large_table_bytes` give what small ones give, wherever they are cut."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark import api
from tidemark.plans import compare
from tidemark.sources import large
from tidemark.sources.delimited import Dialect
from test_engine import write


def csv_text(n, changed, sep=",", quoted=True):
    cell = lambda i: f'"line {i}\nand ""more""{sep} of it"' if quoted and i % 3 == 0 else f"v{i}"
    return f"id{sep}text{sep}n\n" + "".join(f"{i}{sep}{cell(i)}{sep}{i * 7 + (1000 if i in changed else 0)}\n" + ("\n" if i % 50 == 9 else "") for i in range(n))


def files(changed):
    stacked = "a,b\n" + "".join(f"{i},{i in changed}\n" for i in range(30)) + "\nc,d,e\n" + "".join(f"{i},x,{i}\n" for i in range(40))
    records = [{"id": f"k{i}", "text": 'a } b { "quoted" \\ ]' if i % 4 == 0 else "x", "v": i + (1 if i in changed else 0), **({"deep": {"y": [1, {"z": i}]}} if i % 5 == 0 else {})} for i in range(200)]
    sink = pa.BufferOutputStream()
    pq.write_table(pa.table({"id": list(range(90)), "f": [i / 3 for i in range(90)], "s": [None if i % 9 == 0 else f"s{i + (i in changed)}" for i in range(90)]}), sink, row_group_size=20)
    return {
        "plain.csv": csv_text(300, changed),
        "pipes.csv": csv_text(120, changed, ";"),
        "crlf.csv": csv_text(60, changed).replace("\n", "\r\n"),
        "lead.csv": "a note\nanother\n" + csv_text(40, changed),
        "bare.tsv": csv_text(40, changed, "\t", False).split("\n", 1)[1],
        "stacked.csv": stacked,
        "records.json": json.dumps(records, indent=1),
        "dense.json": json.dumps(records),
        "lines.jsonl": "".join(json.dumps(r) + "\n" for r in records),
        "t.parquet": sink.getvalue().to_pybytes(),
        "one.json": json.dumps({"a": sorted(changed)}),
        "note.txt": "same\n" * 40 + str(sorted(changed)),
        "odd [name] 1%.csv": csv_text(30, changed),
    }


CONFIG = [{"match": "lead.csv", "shape": {"header_line": 3}}, {"match": "bare.tsv", "shape": {"has_header": False}}, {"match": "pipes.csv", "row_identity": {"columns": ["id"]}}]


def told(found):
    return {n.path: (n.action, sorted(n.tags), [(e["verb"], str(e["params"])) for e in n.edits], n.summary) for n in found.root.walk()}


@pytest.mark.parametrize("cut", [1000, 100_000])
def test_equal_edits_at_any_limit(spark, tmp_path, cut):
    a, b = write(tmp_path / "a", files({})), write(tmp_path / "b", files({3, 17, 29}))
    small = api.diff(spark, a, b, {"dataset": {"paths": CONFIG}})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", cut)  # parts of files
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        big = api.diff(spark, a, b, {"dataset": {"paths": CONFIG, "correspondence": {"large_table_bytes": 10}}})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for path, found in told(small).items():
        assert told(big).get(path) == found, path
    assert told(big).keys() == told(small).keys()
    assert {"stacked.csv/>table_1", "records.json", "t.parquet", "odd [name] 1%.csv"} <= told(big).keys()


def test_states():
    d = Dialect()
    assert large.delimited_state('1,"a\n', False, d) and not large.delimited_state('b",2\n', True, d)
    assert not large.delimited_state('5" wide,2\n', False, d) and not large.delimited_state('1,"a""b"\n', False, d)
    assert large.delimited_state("still\n", True, d) and large.delimited_state('end",2,"again\n', True, d)
    assert large.json_state('[{"a": {"b": 1', False) == (False, 2) and large.json_state(', "c": "x ', False) == (True, 0)
    assert large.json_state(' y", "d": 2', True) == (False, -1) and large.json_state('"\\"{"', False) == (False, -1)


def test_a_record_over_many_parts(spark, tmp_path, monkeypatch):
    parts, of = [], large._changes
    monkeypatch.setattr(large, "_changes", lambda *a: parts.append(of(*a)) or parts[-1])
    text = "id,t\n1," + '"' + "a line\n" * 3000 + '"\n2,x\n'
    a, b = write(tmp_path / "a", {"t.csv": text + "3,y\n"}), write(tmp_path / "b", {"t.csv": text + "3,z\n"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    config = {"dataset": {"correspondence": {"large_table_bytes": 10}}}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        changeset = api.diff(spark, a, b, config)
        found = changeset.find("t.csv")
        cells = api.extract(spark, a, b, changeset, "t.csv", "cells_changed", config).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(len(p) > 5 for p in parts[0].values()) and len(parts[0]) == 2
    assert [tuple(r) for r in cells] == [(2, "t", "y", "z")]
    assert [e["params"] for e in found.edits] == [{"row": 2, "column": "t", "from": "y", "to": "z"}]


def test_plain_lines_give_what_small_files_give(spark, tmp_path):
    """Lines that are only split at their delimiters, among those that are not."""

    def body(changed):
        row = lambda i: f"{i},a{i % 7},{i * 3 + (i in changed)},{'' if i % 5 else 'x'}"
        lines = [row(i) for i in range(400)]
        return {
            "plain.csv": "id,a,n,e\n" + "\n".join(lines),
            "crlf.csv": "﻿id,a,n,e\r\n" + "\r\n".join(lines) + "\r\n",
            "mixed.csv": "id,a,n,e\n" + "\n".join([*lines[:100], "", "500,\rlone,9,", "  ", *lines[100:200], '501,"q, ""r""\ns",1,', *lines[200:], "502,,,　", "﻿503,b,1,2"]) + "\n",
            "latin.csv": ("id,a,n,e\n" + "\n".join(lines)).encode() + b"\n600,\xe9\xff,1,\n",
            "pipes.csv": "id|a|n\n" + "\n".join(r.rpartition(",")[0].replace(",", "|") for r in lines),
            "stacked.csv": "a,b\n" + "".join(f"{i},{i in changed}\n" for i in range(30)) + "c,d,e\n" + "".join(f"{i},x,{i}\n" for i in range(40)),
        }

    a, b = write(tmp_path / "a", body(())), write(tmp_path / "b", body({3, 17, 29}))
    config = {"paths": [{"match": "pipes.csv", "row_identity": {"columns": ["id"]}}]}
    small, big = (api.diff(spark, a, b, {"dataset": config | more}) for more in ({}, {"correspondence": {"large_table_bytes": 10}}))
    assert told(big) == told(small)
    assert {p for p, (action, *_) in told(big).items() if action == "modify"} >= {"plain.csv", "crlf.csv", "mixed.csv", "latin.csv", "pipes.csv", "stacked.csv"}


def test_files_without_quotes_are_read_once_by_tasks(spark, tmp_path, monkeypatch):
    seen, of = [], large._changes
    monkeypatch.setattr(large, "_changes", lambda *a: seen.append(sorted(f.path for f in a[1].values())) or of(*a))
    text = "id,t\n" + "".join(f"{i},x\n" for i in range(50))
    a, b = (write(tmp_path / s, {"plain.csv": text + end, "quoted.csv": text + f'7,"{end}"'}) for s, end in (("a", "1,y\n"), ("b", "1,z\n")))
    found = api.diff(spark, a, b, {"dataset": {"correspondence": {"large_table_bytes": 10}}})
    assert seen == [["quoted.csv", "quoted.csv"]]
    assert [e["params"] for e in found.find("plain.csv").edits] == [{"row": 50, "column": "t", "from": "y", "to": "z"}]


def test_rows_at_another_place_are_not_kept(spark, tmp_path, monkeypatch):
    kept, of = [], compare._changes
    monkeypatch.setattr(compare, "_changes", lambda *a: kept.append(of(*a)) or kept[-1])
    rows = [f"{i},v{i}\n" for i in range(300)]
    a = write(tmp_path / "a", {"t.csv": "id,v\n" + "".join(rows), "sorted.csv": "id,v\n" + "".join(rows)})
    b = write(tmp_path / "b", {"t.csv": "id,v\n" + "".join(rows[1:]), "sorted.csv": "id,v\n" + "".join(rows[::-1])})
    found = api.diff(spark, a, b, {"dataset": {"defaults": {"row_identity": {"columns": ["id"]}}}})
    assert kept[0].count() == 1
    assert [e["verb"] for e in found.find("t.csv").edits] == ["tabular.remove_row"]
    assert [e["verb"] for e in found.find("sorted.csv").edits] == ["tabular.reorder_rows"]
