"""Pairing of items, row sets, similarity, text, bytes and documents."""

import random

from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators import binary, documents, pairing, schema, similarity, text
from tidemark.streaming.sequence import follow, key_changes


def items(spark, data):
    df = spark.createDataFrame(data, "path string, hash string").withColumn("is_dir", F.lit(False))
    return df.withColumns({"name": paths.file_name(F.col("path")), "parent": paths.parent_path(F.col("path"))})


def test_moves_prefer_names(spark):
    a = items(spark, [("x/1.txt", "h"), ("x/2.txt", "h"), ("same.txt", "s")])
    b = items(spark, [("y/2.txt", "h"), ("y/9.txt", "h"), ("same.txt", "s"), ("copy.txt", "s")])
    same = pairing.same_content(a, b)
    moved = pairing.moved(a, b, same)
    assert {(r["left"], r["right"]) for r in moved.collect()} == {("x/2.txt", "y/2.txt"), ("x/1.txt", "y/9.txt")}
    links = same.unionByName(moved)
    assert [(r["left"], r["right"]) for r in pairing.copied(a, b, links).collect()] == [("same.txt", "copy.txt")]


def test_cover(spark):
    whole = spark.createDataFrame([("w", t) for t in "aabc"], "whole string, token string")
    part = lambda rows: spark.createDataFrame(rows, "part string, token string")
    clean = pairing.exact_cover(whole, part([("p", "a"), ("p", "a"), ("q", "b"), ("q", "c")]))
    assert pairing.clean_splits(clean).count() == 1
    missing = pairing.exact_cover(whole, part([("p", "a"), ("p", "a"), ("q", "b")]))
    assert pairing.clean_splits(missing).count() == 0 and pairing.near_splits(missing).count() == 1
    foreign = pairing.exact_cover(whole, part([("p", "a"), ("p", "a"), ("q", "b"), ("q", "c"), ("q", "z")]))
    assert foreign.first()["foreign"] == 1 and pairing.clean_splits(foreign).count() == 0


def test_similar(spark):
    side = lambda data: spark.createDataFrame([(k, v.split()) for k, v in data], "id string, tokens array<string>")
    found = similarity.similar_pairs(side([("a", "1 2 3 4"), ("b", "9 8")]), side([("x", "1 2 3 5"), ("y", "7")]), [])
    assert [tuple(r) for r in found.collect()] == [("a", "x", 3, 5)]
    pairs = spark.createDataFrame([("a", "x", 9, 10), ("a", "y", 8, 10), ("b", "x", 8, 10)], "left string, right string, shared long, total long")
    assert [(r["left"], r["right"]) for r in similarity.greedy(pairs).collect()] == [("a", "x")]


def test_paths(spark):
    assert paths.glob_matches("a/b/c.csv", "**/*.csv") and paths.glob_matches("c.csv", "**/*.csv") and not paths.glob_matches("a/c.csv", "*.csv")
    assert paths.glob_matches("z.zip/>in/x.csv", "z.zip/in/*.csv")
    key = spark.createDataFrame([("d/2020_x.csv",), ("other",)], "p string").select(paths.captured_key(F.col("p"), r"(?P<y>\d{4})_(?P<n>\w+)\.csv", "${n}-${y}"))
    assert [r[0] for r in key.collect()] == ["x-2020", None]


def test_text(spark):
    pairs = spark.createDataFrame([("a\nb", "a\nb"), ("a\nb", "a\r\nb"), ("a", "\ufeffa"), ("a b", "ab"), ("a", "c")], "l string, r string")
    assert [r[0] for r in pairs.select(text.change_kind(F.col("l"), F.col("r"))).collect()] == ["identical", "line_endings_changed", "bom_changed", "whitespace_only_changed", "lines_changed"]
    assert text.lines_changed("a\nb\nc", "a\nx\nc\nd") == (2, 1, ["-b", "+x", "+d"])


def test_binary():
    data = random.Random(1).randbytes(300_000)
    found = binary.changed_regions(data, data[:150_000] + b"####" + data[150_000:])
    assert found["unchanged"] > 200_000 and found["regions"]
    assert binary.string_changes(b"\0hello\0", b"\0world\0") == (["world"], ["hello"])


def test_documents():
    changes = list(documents.value_changes(documents.parse('{"a":1,"b":[1,2],"c":1.0}'), documents.parse('{"a":2,"b":[1],"c":1}')))
    assert [(c["kind"], c["path"]) for c in changes] == [("replace", "$.a"), ("array_length", "$.b"), ("replace", "$.c")]
    assert documents.serialization_kinds('{"a":1,"b":2}', '{"b":2,"a":1}') == ["object_key_order"]
    assert documents.serialization_kinds('{"a":1}', '{ "a": 1 }') == ["formatting"]


def test_sequence(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), ("2", "c"), ("3", "a")], "snapshot string, k string")
    assert {tuple(r) for r in key_changes(df, ["k"]).collect()} == {("1", "2", 1, 1), ("2", "3", 1, 2)}
    source = tmp_path / "in"
    spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string").coalesce(1).write.parquet(str(source / "1"))
    spark.createDataFrame([(1, "z"), (3, "y")], "id long, v string").coalesce(1).write.parquet(str(source / "2"))
    stream = spark.readStream.schema("id long, v string").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = follow(stream, ["id"], str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row["rows_added"], row["rows_removed"], row["cells_changed"]) == (1, 1, 1)


def test_equal_values(spark):
    rows = [(1, '{"a": 1, "b": [1]}', '{"b":[1],"a":1}'), (2, "1", "1.0"), (3, "x", "x"), (4, None, "1"), (5, "", ""), (6, '"é"', '"\\u00e9"')]
    found = documents.equal_values(spark.createDataFrame(rows, "i int, l string, r string"), ["i"])
    assert {r["i"]: r["equal_value"] for r in found.collect()} == {1: True, 2: False, 3: None, 4: None, 5: None, 6: True}


def test_string_counts(spark):
    rows = [(1, b"abcd\0efgh", "efgh\u0001ijkl".encode("utf-16-le")), (2, None, b"long run"), (3, b"", None)]
    found = binary.string_counts(spark.createDataFrame(rows, "i int, l binary, r binary"), ["i"])
    assert {r["i"]: (r["added"], r["removed"]) for r in found.collect()} == {1: (1, 1), 2: (1, 0), 3: (0, 0)}


def test_header_changes(spark):
    pairs = [(["a", "b", "c"], ["c", "b", "d"]), ([], ["x"]), (["x"], []), ([], [])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, l array<string>, r array<string>")
    found = df.select("i", schema.header_changes(F.col("l"), F.col("r")).alias("c")).collect()
    assert {r["i"]: [tuple(x) for x in r["c"]] for r in found} == {i: schema.column_changes(*p) for i, p in enumerate(pairs)}
