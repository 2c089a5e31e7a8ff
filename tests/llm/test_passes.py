"""Seeds in two passes: half of them is on its way at a time, and what is found stays the same."""

import random

import numpy as np

from tidemark.llm import common, substring


def test_two_passes_find_the_same(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    passages = [" ".join(r.choices(words, k=70)) for _ in range(6)]
    rows = [(i, " ".join([*r.choices(words, k=40), passages[i % 6], *r.choices(words, k=30)])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, substring.shared_passages(docs).collect()))
    assert len(found) >= 54
    monkeypatch.setattr(substring, "PASS_BYTES", 1000)
    halves = substring.matches(docs)
    assert len(halves.tidemark_paths) == 2
    size = lambda half: sum(len(x["seeds"]) for x in substring.seeds(docs, 4, half).collect())
    assert size(0) + size(1) == size(None) and max(size(0), size(1)) < 0.7 * size(None)
    assert sorted(map(tuple, substring.shared_passages(docs).collect())) == found


def test_rows_of_many_buckets_are_small(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(10**12 + 7 * i, " ".join(r.choices([f"w{k}" for k in range(5000)], k=300))) for i in range(40)], "doc_id long, text string").coalesce(1)
    few, many = (substring.seeds(docs, bits).collect() for bits in (1, 9))
    read = lambda rows, bits: sorted(zip(*(np.concatenate(x).tolist() for x in zip(*((s[1], s[2], s[0] if bits == 9 else s[0] >> np.uint64(8)) for s in map(substring.seeds_of, rows)), strict=True)), strict=True))
    assert [x[:2] for x in read(few, 1)] == [x[:2] for x in read(many, 9)] and min(x[0] for x in read(many, 9)) == 10**12
    for rows in (few, many):  # 5 bytes of hash, and what places and differences of ids need: 12 bytes more before
        assert sum(len(x["places"]) + len(x["docs"]) for x in rows) <= 4 * sum(len(x["seeds"]) // 5 for x in rows)


def test_windows_by_running_sums(spark, monkeypatch):
    x = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    power, inverse = common._powers()
    for n in (0, 42, 43, 44, 3000):
        summed = common.windows(x[:n], 43)
        with monkeypatch.context() as m:
            m.setattr(common, "_powers", lambda: (power[:401], inverse[:401]))
            parts = common.windows(x[:n], 43)
            m.setattr(common, "SUMMED_WINDOW", 50)
            assert summed.tolist() == parts.tolist() == common.windows(x[:n], 43).tolist()
