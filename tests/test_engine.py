"""Snapshots on disk: the facts that come out, in the shapes of small vectors."""

import json
import sqlite3
import zipfile

import pytest

from tidemark import api, cli, plugins
from tidemark.config import load
from tidemark.operators.compact import edit
from tidemark.sources.archives import Limits, TooLarge, members
from tidemark.sources.delimited import sniff, stacked
from tidemark.plans.engine import Node, fused_layers
from tidemark.sources.formats import bson, cbor, msgpack, tables
from tidemark.sources.records import document, json_table, kind_of, tagged


def write(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode() if isinstance(body, str) else body)
    return str(root)


@pytest.fixture(scope="module")
def changeset(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("snapshots")
    a = {
        "cells.csv": "name,score\nann,1\nbob,2\ncy,3\n",
        "columns.csv": "name,age\nx,1\ny,2\n",
        "renamed.csv": "id,status,score\n1,a,10\n2,b,20\n3,c,30\n",
        "keyed.csv": "id,name,price\n1,a,5\n2,b,6\n3,c,7\n",
        "rounded.csv": "county,pop\na,1234\nb,5678\nc,9100\n",
        "all.csv": "year,n\n2020,1\n2020,2\n2021,3\n",
        "docs/readme.txt": "hello\nworld\n",
        "old/same.txt": "a text that moves\n",
        "conf.yaml": "a: 1\nb: [1, 2]\n",
        "order.json": '{"a":1,"b":2}',
        "types.json": '[{"id":"x","v":1},{"id":"y","v":2}]',
        "same.txt": "same",
    }
    b = a | {
        "cells.csv": "name,score\nann,1\nbob,5\ncy,3\n",
        "columns.csv": "name,age,city\nx,1,P\ny,2,Q\n",
        "renamed.csv": "id,state,score\n1,a,10\n2,b,20\n3,c,30\n",
        "keyed.csv": "id,name,price\n3,c,7\n4,d,9\n1,a,8\n",
        "rounded.csv": "county,pop\na,1000\nb,6000\nc,9000\n",
        "docs/readme.txt": "hello\nthere\nworld\n",
        "new/same.txt": "a text that moves\n",
        "conf.yaml": "a: 2\nb: [1, 2]\n",
        "order.json": '{"b":2,"a":1}',
        "types.json": '[{"id":"x","v":"1"},{"id":"y","v":"2"}]',
        "y20.csv": "year,n\n2020,1\n2020,2\n",
        "y21.csv": "year,n\n2021,3\n",
        "added.bin": b"\0\1\2",
    }
    for gone in ("all.csv", "old/same.txt"):
        del b[gone]
    left, right = write(top / "a", a), write(top / "b", b)
    for root, n in ((left, 1), (right, 2)):
        with zipfile.ZipFile(f"{root}/z.zip", "w") as z:
            z.writestr("in/x.csv", f"k,v\n1,{n}\n")
        db = sqlite3.connect(f"{root}/d.sqlite")
        db.execute("CREATE TABLE t (id INTEGER, name TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i, str(i)) for i in range(n + 2)])
        db.commit()
        db.close()
    config = {"dataset": {"paths": [{"match": "keyed.csv", "row_identity": {"columns": ["id"]}}]}}
    return api.diff(spark, left, right, config), left, right, config


@pytest.mark.parametrize(
    ("path", "action", "tags"),
    [
        ("cells.csv", "modify", {"cell-change"}),
        ("columns.csv", "modify", {"column-addition", "schema-change"}),
        ("renamed.csv", "modify", {"column-rename", "schema-change"}),
        ("keyed.csv", "modify", {"row-addition", "row-removal", "cell-change"}),
        ("rounded.csv", "modify", {"value-rounded", "cell-change"}),
        ("docs/readme.txt", "modify", {"content-changed", "lines-added"}),
        ("conf.yaml", "modify", {"content-changed", "document-value-change"}),
        ("order.json", "modify", {"serialization-change", "document-serialization-change"}),
        ("types.json", "modify", {"column-type-change", "schema-change"}),
        ("z.zip/>in/x.csv", "modify", {"cell-change"}),
        ("d.sqlite/>t", "modify", {"row-addition"}),
        ("y20.csv", "tabular_split", {"tabular_split"}),
        ("new", "move", {"move", "folder-move"}),
        ("added.bin", "add", set()),
    ],
)
def test_facts(changeset, path, action, tags):
    node = changeset[0].find(path)
    assert node and node.action == action and set(node.tags) == tags


@pytest.mark.parametrize(
    ("config", "right", "places"),
    [
        ({}, "id,state,score\n1,a,10\n2,B,20\n3,c,30\n4,d,40\n", [{"row": 1}]),
        ({"dataset": {"defaults": {"row_identity": {"columns": ["id"]}}}}, "id,state,score\n4,d,40\n1,a,10\n3,c,30\n2,B,20\n", [{"key": {"id": "2"}}]),
    ],
)
def test_renamed_columns_keep_changed_cells(spark, tmp_path, config, right, places):
    a = write(tmp_path / "a", {"t.csv": "id,status,score\n1,a,10\n2,b,20\n3,c,30\n4,d,40\n"})
    found = api.diff(spark, a, write(tmp_path / "b", {"t.csv": right}), config).find("t.csv")
    assert {"column-rename", "cell-change"} <= set(found.tags)
    cells = [e["params"] for e in found.edits if e["verb"] == "tabular.edit_cell"]
    assert cells == [{**p, "column": "state", "from": "b", "to": "B"} for p in places]


@pytest.mark.parametrize(
    ("config", "place"), [({}, {"row": 1}), ({"dataset": {"defaults": {"row_identity": {"columns": ["a.b"]}}}}, {"key": {"a.b": "y"}})]
)
def test_columns_with_dots(spark, tmp_path, config, place):
    a = write(tmp_path / "a", {"t.csv": "a.b,c.`d\nx,1\ny,2\nz,3\n"})
    found = api.diff(spark, a, write(tmp_path / "b", {"t.csv": "a.b,c.`d\nx,1\ny,5\nz,3\n"}), config).find("t.csv")
    cells = [e["params"] for e in found.edits if e["verb"] == "tabular.edit_cell"]
    assert cells == [{**place, "column": "c.`d", "from": "2", "to": "5"}]


def test_claims_and_identical(changeset):
    found = changeset[0]
    assert found.claims == [{"verb": "split", "whole": "all.csv", "parts": ["y20.csv", "y21.csv"], "covered": 3, "residual": 0}]
    assert found.find("same.txt") is None and found.changed
    paths = [n.path for n in found.root.walk()]
    assert len(paths) == len(set(paths))


def test_rendering(changeset):
    found = changeset[0]
    assert json.loads(found.to_json())["root"]["children"]
    markdown = api.to_markdown([found])
    assert "renamed.csv" in markdown and "\ue000" not in markdown and "<div" in api.to_html([found])


def test_extract(spark, changeset):
    found, left, right, config = changeset
    cells = api.extract(spark, left, right, found, "keyed.csv", "cells_changed", config)
    assert [tuple(r) for r in cells.collect()] == [("1", "price", "5", "8")]
    assert api.extract(spark, left, right, found, "columns.csv", "columns_added").collect()[0]["name"] == "city"
    with pytest.raises(KeyError):
        api.extract(spark, left, right, found, "nowhere", "content")


def test_cli(spark, tmp_path, capsys):
    left, right = write(tmp_path / "a", {"x.txt": "a\n"}), write(tmp_path / "b", {"x.txt": "b\n"})
    assert cli.main(["diff", left, left], spark) == 0
    assert cli.main(["diff", left, right, "-o", f"json:{tmp_path}/out.json"], spark) == 1
    assert json.loads((tmp_path / "out.json").read_text())[0]["root"]["action"] == "modify"
    assert cli.main(["diff", left], spark) == 2
    assert cli.main(["changelog", f"{tmp_path}/out.json"], spark) == 0 and "x.txt" in capsys.readouterr().out
    assert cli.main(["report", left, right, f"{tmp_path}/report"], spark) == 1
    assert json.loads((tmp_path / "report" / "trace.json").read_text())[0] and (tmp_path / "report" / "snapshots" / "1" / "x.txt").read_text() == "b\n"


def test_config():
    config = load("dataset:\n  paths:\n    - match: '*.csv'\n      shape: {header_line: 0}\n      colour: red\n  exclude: ['*.tmp']\n")
    assert {d["code"] for d in config.diagnostics} == {"tidemark.dataset_config.unknown_field", "tidemark.dataset_config.invalid_header_line"}
    assert config.exclude == ["*.tmp"] and config.has_errors()


def test_sources():
    assert sniff(b"a|b\n1|2\n3|4\n", "x.csv").delimiter == "|" and sniff(b"a,b\n1,2\n", "x.csv").inferred is False
    rows = [["a", "b"]] + [["1", "2"]] * 11 + [[]] + [["c", "d", "e"]] + [["1", "2", "3"]] * 12
    assert stacked(rows) == [(0, 12), (13, 26)]
    assert json_table(b'{"type":"FeatureCollection","n":1,"features":[{"properties":{"a":1},"geometry":null}]}', "x.geojson") == (["a", "geometry"], [[tagged(document(b"1", ".json")), None]], {"type": "FeatureCollection", "n": "1"})
    assert kind_of("1") == "string" and kind_of("\ue0001") == "number"
    assert document(b"<r a='1'><x>t</x><x>u</x></r>", ".xml") == {"r": {"@a": "1", "x": ["t", "u"]}}
    assert document(b"top = 1\n[s]\nk = v\n", ".ini") == {"top": "1", "s": {"k": "v"}}
    assert cbor(bytes.fromhex("a2616101616282f5f6")) == {"a": 1, "b": [True, None]}
    assert msgpack(bytes.fromhex("82a16101a16292c3c0")) == {"a": 1, "b": [True, None]}
    assert bson(bytes.fromhex("0c0000001061000100000000")) == {"a": 1}


def test_binary_tables(tmp_path):
    import io

    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"a": [1, None], "b": ["x", "y"]})
    sink = io.BytesIO()
    pq.write_table(table, sink)
    assert tables(sink.getvalue(), ".parquet") == [("", ["a", "b"], [[tagged(document(b"1", ".json")), "x"], [None, "y"]])]
    pd.DataFrame({"v": [1.0, 2.5], "s": ["p", "q"]}).to_stata(tmp_path / "x.dta", write_index=False)
    assert tables((tmp_path / "x.dta").read_bytes(), ".dta") == [("", ["v", "s"], [["1", "p"], ["2.5", "q"]])]
    schema = b'{"type":"record","name":"R","fields":[{"name":"id","type":"long"},{"name":"s","type":["null","string"]}]}'
    text = lambda b: bytes([2 * len(b)]) + b if len(b) < 64 else bytes([(2 * len(b)) & 0x7F | 0x80, (2 * len(b)) >> 7]) + b
    body = b"\x02\x02\x02p" + b"\x04\x00"
    avro = b"Obj\x01" + b"\x02" + text(b"avro.schema") + text(schema) + b"\x00" + b"M" * 16 + b"\x04" + bytes([2 * len(body)]) + body + b"M" * 16
    one, two = (tagged(document(x, ".json")) for x in (b"1", b"2"))
    assert tables(avro, ".avro") == [("", ["id", "s"], [[one, "p"], [two, None]])]


def test_plugins(spark, tmp_path, monkeypatch):
    def parse(data):
        return [("", ["k", "v"], [line.split("=") for line in data.decode().split()])]

    monkeypatch.setitem(plugins.PARSERS, ".kv", parse)
    monkeypatch.setitem(plugins.WRITERS, ".own", lambda a, b: [edit("own.changed", {}, ("own",))])
    monkeypatch.setattr(plugins, "ANNOTATORS", [lambda node: {"seen"}])
    monkeypatch.setattr(plugins, "PAIR_RULES", [lambda a, b, links: spark.createDataFrame([("p.own", "q.own", "plugin")], "left string, right string, evidence string")])
    left, right = write(tmp_path / "a", {"x.kv": "a=1 b=2", "p.own": "1"}), write(tmp_path / "b", {"x.kv": "a=1 b=3", "q.own": "2"})
    found = api.diff(spark, left, right)
    assert set(found.find("x.kv").tags) == {"cell-change", "seen"}
    assert found.find("q.own").source == "p.own" and "own" in found.find("q.own").tags


def test_layers():
    names = {"d/r.shp", "d/r.shx", "d/r.dbf"}
    found = fused_layers([Node("d/r.shp", "modify"), Node("d/r.dbf", "modify"), Node("d/r.shx", "modify"), Node("d/q.dbf", "modify")], names, names)
    assert [n.path for n in found] == ["d/r.shp/>geometry", "d/r.shp/>attributes", "d/q.dbf"]


def test_archive_limits(tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("../evil.txt", "x")
        z.writestr("big.txt", "x" * 1000)
    data = (tmp_path / "z.zip").read_bytes()
    limits = Limits()
    assert [n for n, _ in members("z.zip", data, limits)] == ["big.txt"] and limits.skipped == [("z.zip", "../evil.txt")]
    with pytest.raises(TooLarge, match="entry_bytes"):
        list(members("z.zip", data, Limits(entry=10)))
