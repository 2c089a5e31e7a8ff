import pytest


@pytest.fixture
def docs(spark):
    """Rows of documents: (doc_id, text[, lang[, source]]), with a column of a clashing name."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s") for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        return df.selectExpr("*", "cast(length(text) as long) AS n_chars", "'x' AS score", "'y' AS n", "'z' AS size", "'w' AS label")

    return make


#: Nulls in any column, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, "en", "a"),
    (2, "", None, "a"),
    (3, "   \n\t ", "de", None),
    (None, "no id but words in it, some of them", "en", "b"),
    (4, "tie tie tie tie tie tie tie", "en", "b"),
    (5, "tie tie tie tie tie tie tie", "en", "b"),
    (6, "same row", "fr", "c"),
    (6, "same row", "fr", "c"),
    (7, "1234 5678 %%% 漢字 ß \U0001f600", "xx", "c"),
    (8, "long words and more words " * 20_000, "en", "c"),
    (9, "x" * 50_000, "en", "c"),
]


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs(ODD).filter("false")
