"""All changed files at once: as many jobs for many files as for few, and one answer whatever the number of changes."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidemark import api
from tidemark.functions import cells
from tidemark.plans import compare
from test_engine import write


def jobs_of(spark, run):
    spark.sparkContext.setJobGroup(name := f"count-{uuid.uuid4()}", "")
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("rest", "")
    return out, n


def snapshots(top, n):
    a = {f"d/{i}.csv": f"id,v\n1,old{i}\n2,x{i}\n3,y\n" for i in range(n)} | {f"t/{i}.txt": f"line {i}\nsame\n" for i in range(n)} | {f"j/{i}.json": f'{{"a": {i}}}' for i in range(n)}
    b = {f"d/{i}.csv": f"id,v\n1,new{i}\n2,x{i}\n3,y\n" for i in range(n)} | {f"t/{i}.txt": f"line {i}\nother {i}\n" for i in range(n)} | {f"j/{i}.json": f'{{"a": {i}, "b": 1}}' for i in range(n)}
    return write(top / "a", a), write(top / "b", b)


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    few, n = jobs_of(spark, lambda: api.diff(spark, *snapshots(tmp_path / "few", 2)))
    many, m = jobs_of(spark, lambda: api.diff(spark, *snapshots(tmp_path / "many", 40)))
    assert len([x for x in many.root.walk() if x.edits]) == 120 == 20 * len([x for x in few.root.walk() if x.edits])
    assert many.find("d/7.csv").edits[-1]["params"] == {"row": 0, "column": "v", "from": "old7", "to": "new7"}
    assert m <= n + 12  # adaptive plans give some more jobs to larger inputs


KEYED = {"dataset": {"defaults": {"row_identity": {"columns": ["id"]}}}}


def grouped(found):
    """What a changeset says, examples and lists aside."""
    out = []
    for n in found.root.walk():
        for e in n.edits:
            if e["verb"] in ("tabular.edit_cell", "tabular.add_row", "tabular.remove_row", "tabular.append_rows", "tabular.keyed_stream_summary"):
                continue
            out.append((n.path, e["verb"], str({k: v for k, v in e["params"].items() if k != "values"})))
    return sorted(out), {n.path: (n.action, sorted(n.tags), n.summary) for n in found.root.walk()}


def test_one_answer_on_both_sides_of_the_limit(spark, tmp_path, monkeypatch):
    rows = range(60)
    a = {
        "noop.csv": "id,v\n" + "".join(f"{i},{i + 1}\n" for i in rows),
        "round.csv": "id,v\n" + "".join(f"{i},{1000 * i + 1234}\n" for i in rows),
        "fraction.csv": "id,v\n" + "".join(f"{i},{i}.4\n" for i in rows),
        "hide.csv": "id,v\n" + "".join(f"{i},{i}\n" for i in rows),
        "types.json": "[" + ",".join(f'{{"id": "k{i}", "v": {i}}}' for i in rows) + "]",
        "append.csv": "id,v\n" + "".join(f"{i},{i}\n" for i in rows),
        "mixed.csv": "id,v,w\n" + "".join(f"{i},{i},{i}\n" for i in rows),
        "renamed.csv": "id,old,w\n" + "".join(f"{i},n{i},w{i}\n" for i in rows),
        "sorted.csv": "v,w\n" + "".join(f"{i:03},{i % 3}\n" for i in rows),
    }
    b = {
        "noop.csv": "id,v\n" + "".join(f"{i},{i + 1}.0\n" for i in rows),
        "round.csv": "id,v\n" + "".join(f"{i},{1000 * (i + 1)}\n" for i in rows),
        "fraction.csv": "id,v\n" + "".join(f"{i},{i or 5}\n" for i in rows),
        "hide.csv": "id,v\n" + "".join(f"{i},*\n" for i in rows),
        "types.json": "[" + ",".join(f'{{"id": "k{i}", "v": "{i}"}}' for i in rows) + "]",
        "append.csv": "id,v\n" + "".join(f"{i},{i}\n" for i in range(110)),
        "mixed.csv": "id,v,w\n" + "".join(f"{i},x{i},{i}.0\n" for i in rows),
        "renamed.csv": "id,new,w\n" + "".join(f"{i},n{i},x{i}\n" for i in rows),
        "sorted.csv": "v,w\n" + "".join(f"{i:03},{(i + (i == 7)) % 3}\n" for i in reversed(rows)),
    }
    left, right = write(tmp_path / "a", a), write(tmp_path / "b", b)
    config = {"dataset": {"paths": [{"match": n, "row_identity": {"columns": ["id"]}} for n in a if n != "sorted.csv"]}}
    whole = api.diff(spark, left, right, config)
    monkeypatch.setattr(compare, "EDIT_LIMIT", 20)
    summed = api.diff(spark, left, right, config)
    assert grouped(whole) == grouped(summed)
    assert whole.find("noop.csv") is None
    verbs = lambda found, path: {e["verb"].partition(".")[2] for e in found.find(path).edits if e["visible"]}
    assert verbs(summed, "round.csv") == {"values_rounded"} == verbs(whole, "round.csv")
    assert verbs(summed, "fraction.csv") == {"values_rounded", "edit_cell"}  # 0.4 to 5 is no rounding
    assert verbs(summed, "hide.csv") == {"values_suppressed"} and verbs(summed, "types.json") == {"column_type_changed"}
    assert verbs(whole, "append.csv") == {"append_rows"} == verbs(summed, "append.csv") and "50 rows added" in summed.find("append.csv").summary
    assert verbs(whole, "mixed.csv") == {"edit_cell"} and verbs(summed, "mixed.csv") == {"keyed_stream_summary"}
    assert verbs(summed, "renamed.csv") == {"rename_column", "keyed_stream_summary"}
    assert verbs(summed, "sorted.csv") == {"edit_cell"}
    summary = next(e for e in summed.find("mixed.csv").edits if e["verb"] == "tabular.keyed_stream_summary")["params"]
    assert summary["cells_changed"] == 60 and len(summary["examples"]["modified"]) == compare.EXAMPLES


def test_many_equal_numbers_are_identical(spark, tmp_path):
    a = write(tmp_path / "a", {"t.csv": "id,v\n" + "".join(f"{i},7\n" for i in range(6000))})
    b = write(tmp_path / "b", {"t.csv": "id,v\n" + "".join(f"{i},7.0\n" for i in range(6000))})
    assert not api.diff(spark, a, b, KEYED).changed


@pytest.mark.parametrize(("config", "tags"), [(None, {"row-correspondence-uncertain"}), (KEYED, {"row-removal", "row-addition"})])
def test_tables_of_nothing_but_a_key(spark, tmp_path, config, tags):
    a, b = write(tmp_path / "a", {"ids.csv": "id\n1\n2\n3\n"}), write(tmp_path / "b", {"ids.csv": "id\n1\n3\n4\n"})
    found = api.diff(spark, a, b, config).find("ids.csv")
    assert set(found.tags) == tags


def test_a_broken_file_is_a_diagnostic(spark, tmp_path):
    a = write(tmp_path / "a", {"bad.json": '[{"a": 1}]', "bad.parquet": b"PAR1 nothing", "good.csv": "id,v\n1,2\n"})
    b = write(tmp_path / "b", {"bad.json": '[{"a": 1}', "bad.parquet": b"PAR1 nothing else", "good.csv": "id,v\n1,3\n"})
    found = api.diff(spark, a, b)
    assert {d["location"] for d in found.diagnostics if d["code"] == "tidemark.rule.parse_failed"} == {"bad.json", "bad.parquet"}
    assert found.find("bad.json").edits and found.find("good.csv").tags == ["cell-change"]


def test_numbers_of_documents_stay_numbers(spark, tmp_path):
    a, b = write(tmp_path / "a", {"c.yaml": "n: 1\ns: x\n"}), write(tmp_path / "b", {"c.yaml": "n: 2\ns: y\n"})
    changes = api.diff(spark, a, b).to_dict()["root"]["children"][0]["edits"][0]["params"]["changes"]
    assert [(c["from"], c["to"]) for c in changes] == [(1, 2), ("x", "y")]


def test_three_hundred_parts(spark, tmp_path):
    n = 300
    lines = [f"{i % n},{i}\n" for i in range(3 * n)]
    a = write(tmp_path / "a", {"all.csv": "k,v\n" + "".join(lines)})
    b = write(tmp_path / "b", {f"part_{k}.csv": "k,v\n" + "".join(x for x in lines if x.startswith(f"{k},")) for k in range(n)})
    found = api.diff(spark, a, b)
    assert len(found.claims) == 1 and found.claims[0]["covered"] == 3 * n and len(found.claims[0]["parts"]) == n


def test_rounding(spark):
    pairs = [("1234", "1000"), ("1500", "2000"), ("2500", "2000"), ("-1500", "-2000"), ("1499", "2000"), ("7.4", "7"), ("7.5", "8"), ("7", "8"), ("0.4", "0"), ("95", "100"), ("1,250", "1,300"), ("3", "-3")]
    df = spark.createDataFrame(pairs, "a string, b string").select(cells.rounding_modulus(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == [1000, 1000, None, 1000, None, 1, 1, None, None, 100, 100, None]
    exact = spark.createDataFrame([("1." + "0" * 12 + "1", "1"), ("1e-13", "0"), ("1.50", "1.5"), ("1e3", "1000")], "a string, b string")
    assert [r[0] for r in exact.select(cells.numbers_equal(F.col("a"), F.col("b"))).collect()] == [False, False, True, True]


def test_tables_pair_across_formats(spark, tmp_path):
    people = [("id", "Name", "city"), *((str(i), f"name{i}", f"city{i % 7}") for i in range(30))]
    rows = lambda data, sep: "".join(sep.join(r) + "\n" for r in data)
    other = [("k", "amount"), *((f"x{i}", str(i * 13)) for i in range(25))]
    a = write(tmp_path / "a", {"people.csv": rows(people, ","), "old/sums.csv": rows(other, ","), "note.txt": "nothing alike\n"})
    b = write(tmp_path / "b", {"roster.tsv": rows(people[:9] + [("8", "changed", "city1")] + people[10:], "\t"), "new/totals.csv": rows([*other, ("x99", "7")], ","), "more.csv": "q,r\n1,2\n"})
    found = api.diff(spark, a, b, KEYED)
    node = found.find("roster.tsv")
    assert node.source == "people.csv" and [e["params"]["to"] for e in node.edits] == ["changed"] and "serialization-change" in node.tags
    assert found.find("new/totals.csv").source == "old/sums.csv" and found.find("more.csv").action == "add" and found.find("note.txt").action == "remove"


def test_many_tables_of_the_same_headers(spark, monkeypatch):
    from tidemark.operators import similarity

    monkeypatch.setattr(similarity, "SAME_HEADERS", 3)
    table = lambda n, k: (f"{k}{n}", ["a", "b"], [f"t{n}", f"u{n}"])
    left, right = (spark.createDataFrame([table(n, k) for n in range(8)] + [(f"{k}z", ["a", "b"], [f"only{k}"])], "id string, headers array<string>, tokens array<string>") for k in "lr")
    found = {(r["left"], r["right"]) for r in similarity.greedy(similarity.table_pairs(left, right)).collect()}
    assert found == {(f"l{n}", f"r{n}") for n in range(8)}
    assert [tuple(r) for r in similarity.by_place(left.filter("id = 'lz'"), right.filter("id = 'rz'")).collect()] == [("lz", "rz")]


def test_containers_in_rounds(spark):
    from tidemark.operators import pairing

    votes = spark.createDataFrame([("l1", "r1", 5, 5), ("l2", "r1", 5, 5), ("l2", "r2", 4, 5)], "lp string, rp string, votes long, children long")
    assert {(r["left"], r["right"]) for r in pairing.best_containers(votes).collect()} == {("l1", "r1"), ("l2", "r2")}


def test_policies_of_bad_keys(spark, tmp_path):
    files = {f"{p}.csv": "id,v\n1,a\n1,b\n,c\n" for p in ("diagnostic", "error", "ignore")}
    a, b = write(tmp_path / "a", files), write(tmp_path / "b", {k: v.replace("c", "d") for k, v in files.items()})
    paths = [{"match": k, "row_identity": {"columns": ["id"], "on_null_key": k[:-4], "on_duplicate_key": k[:-4]}} for k in files]
    found = api.diff(spark, a, b, {"dataset": {"paths": paths}})
    told = {(d["location"], d["severity"], d["code"].rpartition(".")[2]) for d in found.diagnostics}
    codes = ("null_key", "duplicate_key")
    assert told == {("diagnostic.csv", "warning", c) for c in codes} | {("error.csv", "error", c) for c in codes}
    assert all("cell-change" in found.find(k).tags for k in files)
    wrong = api.load({"dataset": {"defaults": {"row_identity": {"columns": ["id"], "on_null_key": "shout"}}}})
    assert [d["code"] for d in wrong.diagnostics] == ["tidemark.dataset_config.invalid_on_null_key"]


def test_inserted_rows_of_large_tables(spark, tmp_path):
    r = random.Random(2)
    plain = [f"{i},v{i % 40}\n" for i in range(1500)]
    alike = ["x,1\n" if i % 3 else f"k{i},2\n" for i in range(900)]
    a = {"top.csv": plain, "alike.csv": alike, "changed.csv": plain, "swapped.csv": plain}
    more = list(alike)
    places = sorted(r.sample(range(len(alike)), 12))
    for n, i in enumerate(places):
        more.insert(i + n, r.choice(["x,1\n", "new,3\n"]))
    b = {"top.csv": ["first,v\n", *plain], "alike.csv": more, "changed.csv": [*plain[:700], "700,other\n", *plain[701:], "more,v\n"], "swapped.csv": ["first,v\n", *plain[1:9], plain[0], *plain[9:]]}
    files = lambda d: {k: "id,v\n" + "".join(v) for k, v in d.items()}
    left, right = write(tmp_path / "a", files(a)), write(tmp_path / "b", files(b))
    config = {"dataset": {"defaults": {"row_identity": {"columns": ["nothing"]}}}}  # no key is looked for
    found = api.diff(spark, left, right, config)
    top = found.find("top.csv").edits
    assert [(e["verb"], e["params"]["index"]) for e in top if e["visible"]] == [("tabular.add_row", 0)]
    added = set()
    for e in found.find("alike.csv").edits:
        if e["visible"]:
            p = e["params"]
            added |= {p["index"]} if e["verb"] == "tabular.add_row" else set(range(p["start"], p["start"] + len(p["rows"])))
    wanted, at = set(), iter(alike)
    row = next(at)
    for i, x in enumerate(more):  # matched from the front
        if x == row:
            row = next(at, None)
        else:
            wanted.add(i)
    assert added == wanted and len(added) == 12
    for path in ("changed.csv", "swapped.csv"):  # a left row is missing, or in another place
        assert "cell-change" in found.find(path).tags
