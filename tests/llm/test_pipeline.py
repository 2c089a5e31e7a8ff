"""The pipeline's stages on a small corpus, and the query registry."""

import corpus_pipeline
import __spark_entry__
from tidemark.llm import mixing
from tidemark.llm.common import stored


def test_stages(spark, tmp_path):
    text = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    passage = text("p", 80)
    rows = [(i, text(i, 60), "en", f"s{i % 3}") for i in range(12)]
    rows += [(20, text(0, 60), "en", "s0"), (21, text(30, 70) + " " + passage, "en", "s1"), (22, text(31, 70) + " " + passage, "en", "s1"), (23, None, "en", "s1"), (24, "", None, None), (3, text(3, 60), "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = seen[name] = stored(stage(spark, docs, str(tmp_path)), name)
        assert name == "best_fit_packing" or docs.columns == columns
    ids = lambda name: sorted(r["doc_id"] for r in seen[name].collect())
    assert ids("language_id") == [0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 20, 21, 22]
    assert ids("ngram_jaccard_join") == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 21, 22]
    left = {r["doc_id"]: r["text"] for r in seen["substring_dedup"].collect()}
    assert passage in left[21] and passage not in left[22] and left[22].strip() == text(31, 70)
    assert set(ids("source_mixing")) <= set(left)
    assert {r["doc_id"] for r in seen["best_fit_packing"].collect()} == set(ids("source_mixing"))


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and columns, repeated ids with different texts, columns of the stages' own names; and the order of the mix."""
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(i, say(i), "en", f"s{i % 2}") for i in range(30)] + [(None, say(40), "en", None), (None, say(41), None, "s1"), (5, say(50), "en", "s1"), (5, say(50), "en", "s1"), (60, None, None, None)]
    names = ["_copy", "_copies", "_id", "_spans", "_start", "_times", "row", "word", "n"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) AS n_chars", *[f"'x' AS {n}" for n in names])
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        ids[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert ids["ngram_jaccard_join"].count(5) == 1 and ids["ngram_jaccard_join"].count(None) == 2
    assert ids["substring_dedup"].count(None) == 2 and len(ids["source_mixing"]) >= 30


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


def test_the_mix_is_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(i, "w " * 60, "en", f"s{i % 2}") for i in range(60)], "doc_id long, text string, lang string, source string")
    start = {r["doc_id"]: r["starts"] for r in mixing.mix(docs).collect()}
    found = [r["doc_id"] for r in corpus_pipeline.source_mixing(spark, docs, str(tmp_path)).collect()]
    left = {i: list(s) for i, s in start.items()}
    places = [left[i].pop(0) for i in found]
    assert places == sorted(places)


def test_registry():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
