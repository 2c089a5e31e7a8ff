"""MinHash near-dedup, conversation repair and vector codes, against brute force, and on odd rows and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import conversations, hyperminhash, ngram_join, queries, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 11 ----------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def top(i):
        return i if label[i] == i else top(label[i])

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def near_texts():
    """A large group of near copies, chains of copies of copies, short texts, and texts of their own."""
    r = random.Random(5)
    say = lambda n: ["".join(r.choices("abcdefgh", k=4)) for _ in range(n)]
    rows, base, chain = [], say(160), say(90)
    for i in range(300):
        if i % 3 == 0:
            text = list(base)
            for _ in range(r.randint(0, 7)):
                text[r.randrange(len(text))] = say(1)[0]
        elif i % 3 == 1 and i < 200:
            chain = list(chain)
            for _ in range(2):
                chain[r.randrange(len(chain))] = say(1)[0]
            text = chain
        elif i % 3 == 1:
            text = ["the", "same", "few", "words", "stand", "here", "and", "there", "again"][: r.randint(1, 9)]
        else:
            text = say(r.randint(1, 60))
        rows.append((i, " ".join(text)))
    return rows


def test_near_duplicates(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_ROWS", 16)  # blocks are cut
    rows = near_texts()
    found = hyperminhash.near_duplicates(docs(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == brute_components(rows)


def test_near_duplicates_odd(odd, empty):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(odd).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True)} <= rows
    assert any(r[0] is None and r[2] is None and r[3] for r in rows)
    assert hyperminhash.near_duplicates(odd).count() == odd.count()
    assert hyperminhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("size", [1, 2, 9, 60, 700])
def test_registers(size):
    r = np.random.default_rng(size)
    tokens = np.sort(r.integers(0, 1 << 64, size, np.uint64, endpoint=False))
    row = hyperminhash.registers([tokens, tokens[:0]])
    assert not row[1].any()
    filled = {}
    for t in map(int, tokens):
        bucket, rest = t >> 57, t & ((1 << 57) - 1)
        if bucket not in filled or rest < filled[bucket]:
            filled[bucket] = rest
    for bucket, rest in filled.items():
        zeros = 57 - rest.bit_length()
        assert row[0][bucket] == zeros << 10 | ((rest << (zeros + 1)) & ((1 << 57) - 1)) >> 47
    assert set(row[0]) == {row[0][b] for b in filled}  # empty buckets have a filled one's register


def test_estimates_and_samples():
    r = np.random.default_rng(2)
    for n in (12, 90, 1500, 30_000):
        both = r.integers(0, 1 << 64, n, np.uint64, endpoint=False)
        for share in (0.7, 0.86, 1.0):
            own = int(n * (1 - share) / (1 + share))
            a, b = (np.sort(np.concatenate([both, r.integers(0, 1 << 64, own, np.uint64, endpoint=False)])) for _ in range(2))
            true = n / (n + 2 * own)
            rows = hyperminhash.registers([a, b])
            found = hyperminhash.estimate(np.array([(rows[0] == rows[1]).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
            assert abs(found - true) < 0.19
            made = [hyperminhash.sample_of(x) for x in (a, b)]
            sampled = hyperminhash.Samples([x.tobytes() for x, _ in made], [level for _, level in made])
            assert bool(sampled.may_link(0, np.array([1]))[0]) or true < 0.85
            assert len(made[0][0]) < 3 * hyperminhash.SAMPLE
    assert 0 < hyperminhash._collisions(20, 20) < 0.001


# --- 12 ----------------------------------------------------------------------------------------------------------------


def brute_repair(rows):
    """rows: (turn, role, text) of one conversation before damage, with conv id 7: the result by trying all edits, cheapest first."""
    after = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"7:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in after:
        end = text.rstrip(" \t\n\v\f\r")
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in after if t is not None]
    best = None
    good = re.compile(r"(s?(ua)+)?")

    def search(i, cost, audit, made):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(after):
            initials = "".join(m[:1] for m in made)
            options = [(0, "", [])]
            options += [(3 * k, "I" * k, list(x)) for k in (1, 2) for x in itertools.product(("user:", "assistant:"), repeat=k)]
            for more, edits, extra in options:
                whole = initials + "".join(x[0] for x in extra)
                if good.fullmatch(whole) and (best is None or (cost + more, audit + edits) < best[:2]):
                    best = (cost + more, audit + edits, made + extra)
            return
        _, role, text = after[i]
        for k in (0, 1, 2):  # inserted before it
            for x in itertools.product(("user:", "assistant:"), repeat=k):
                before = made + list(x)
                if not re.fullmatch(r"s?(ua)*u?", "".join(m[0] for m in before) or "") and before:
                    continue
                at = cost + 3 * k
                search(i + 1, at + 4, audit + "I" * k + "D", before)
                if faults[i] in ("b", "d"):
                    continue
                extra = 3 if faults[i] == "t" else 0
                for c, e, line in ((0, "K", f"{role}:{text}"), (3, "R", f"user:{text}"), (3, "R", f"assistant:{text}")):
                    new = [*before, line]
                    if re.fullmatch(r"s?(ua)*u?", "".join(m[:1] for m in new)):
                        search(i + 1, at + c + extra, audit + "I" * k + e, new)

    search(0, 0, "", [])
    initials = [r[:1] for _, r, _ in after]
    cost, audit, made = best
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("b"),
        "duplicate": faults.count("d"),
        "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(made).encode()).hexdigest(),
    }


def talk(r, n):
    roles = ["user", "assistant", "system", "tool", None, "u"]
    texts = ["A b.", "what?", "cut off", "", None, " \n", "A b."]
    start = r.randint(0, 30)
    return [(None if r.random() < 0.05 else start + i * r.choice([1, 1, 2]), r.choices(roles, [6, 6, 2, 1, 1, 1])[0], r.choice(texts)) for i in range(n)]


def conversation_rows(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS cost", "'y' AS part", "1 AS piece")


@pytest.mark.parametrize("pieces", [4096, 2])
def test_repair_against_brute_force(spark, monkeypatch, pieces):
    monkeypatch.setattr(conversations, "PIECE_ROWS", pieces)  # with 2, conversations are cut over pieces
    r = random.Random(pieces)
    talks = [talk(r, n) for n in range(6) for _ in range(10)]
    wanted = [brute_repair(t) for t in talks]
    # each is a conversation 7 of its own table for the damage; here they are told apart by the order of one table each
    for t, w in list(zip(talks, wanted, strict=True))[:: 6 if pieces == 2 else 12]:
        rows = [(7, *x) for x in t]
        found = [x.asDict() for x in conversations.repair(conversation_rows(spark, rows)).collect()] if rows else []
        assert found == ([{"conv_id": 7, **w}] if rows else [])
    for t, w in zip(talks, wanted, strict=True):  # all of them by the same steps in memory
        damaged = conversations_after(t)
        if damaged:
            assert conversations.repaired(*map(list, zip(*damaged, strict=True))) == w


def conversations_after(rows):
    out = []
    for turn, role, text in rows:
        kind = zlib.crc32(f"7:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_pieces_agree_with_whole_conversations(spark, monkeypatch):
    """Many conversations, one of them a third of all rows, cut into pieces of three rows over several tasks."""
    r = random.Random(3)
    rows = [(1, *t) for t in talk(r, 120)] + [(i, *t) for i in range(2, 40) for t in talk(r, r.randint(1, 9))] + [(None, *t) for t in talk(r, 12)]
    table = conversation_rows(spark, rows)
    key = lambda x: str(x["conv_id"])
    whole = sorted((x.asDict() for x in conversations.repair(table.coalesce(1)).collect()), key=key)
    monkeypatch.setattr(conversations, "PIECE_ROWS", 3)
    cut = sorted((x.asDict() for x in conversations.repair(table.repartition(6)).collect()), key=key)
    assert cut == whole and len(whole) == 40


def test_repair_odd(spark):
    rows = [(i, t, None, None) for i, t in ((None, None), (3, 3))] + [(5, None, "user", "Same."), (5, None, "user", "Same."), (6, 1, "assistant", "x" * 200_000 + ".")]
    found = {x["conv_id"]: x for x in conversations.repair(conversation_rows(spark, rows)).collect()}
    assert set(found) == {None, 3, 5, 6}
    # conversation ids of which each row is dropped by the damage
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    row = conversations.repair(conversation_rows(spark, [(gone, 1, "user", "A.")])).first().asDict()
    assert row == {"conv_id": gone, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert conversations.repair(conversation_rows(spark, rows).filter("false")).count() == 0


# --- 13 ----------------------------------------------------------------------------------------------------------------


def brute_codes(rows):
    """rows: (vec_id, vector, label), valid and in the order of seeds. Python's integers throughout."""
    from fractions import Fraction

    x = [[math.floor(Fraction(v) * 4096) for v in vector] for _, vector, _ in rows]
    d = len(x[0]) // 8
    parts = [[v[p * d : (p + 1) * d] for v in x] for p in range(8)]
    away = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    codes, errors, books = [""] * len(x), [0] * len(x), []
    for own in parts:
        book = [list(v) for v in own[:16]]
        near = lambda v, book: min((away(v, e), i) for i, e in enumerate(book))
        for _ in range(6):
            at = [near(v, book)[1] for v in own]
            for i in range(len(book)):
                mine = [v for v, k in zip(own, at, strict=True) if k == i]
                if mine:
                    book[i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for k, v in enumerate(own):
            far, i = near(v, book)
            codes[k] += f"{i:02x}"
            errors[k] += far
        books.append(book)
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    labels = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    fits = lambda e: e if e < 1 << 63 else None
    return sorted((i, c, fits(e), fits(labels[label]), digest) for (i, _, label), c, e in zip(rows, codes, errors, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "'y' AS error", "'z' AS vector", "'w' AS entry")


@pytest.mark.parametrize(("n", "width", "scale"), [(120, 16, 1.0), (9, 8, 0.01), (40, 24, 1e6), (20, 8, 1e30)])
def test_vector_codes(spark, n, width, scale):
    r = random.Random(n)
    rows = [(i, [r.gauss(0, scale) for _ in range(width)], r.choice([1, 2, None])) for i in range(n)]
    rows[3] = (3, rows[2][1], 1)  # equal vectors
    bad = [(n + 1, None, 1), (n + 2, [], 1), (n + 3, [float("nan")] * width, 1), (n + 4, [*rows[0][1][:-1], None], 1), (n + 5, [*rows[0][1][:-1], float("inf")], 1), (n + 6, [1.0] * (width - 8 or 16), 1), (n + 7, [1.0] * 9, 1)]
    found = vector_codes.compress(vectors(spark, bad + rows).repartition(3)).collect()
    assert sorted(tuple(x) for x in found) == brute_codes(rows)


def test_label_errors_where_labels_are_many(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)], r.choice([1, 1, 1, None, i])) for i in range(60)]
    few = sorted(map(tuple, vector_codes.compress(vectors(spark, rows)).collect()))
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(vector_codes, "HOT_LABEL", 5)
    assert sorted(map(tuple, vector_codes.compress(vectors(spark, rows)).collect())) == few == brute_codes(rows)


def test_vector_codes_odd(spark):
    rows = [(None, [float(i)] * 8, None) for i in range(3)] + [(4, [1.0] * 8, 1), (4, [1.0] * 8, 1)]
    found = vector_codes.compress(vectors(spark, rows)).collect()
    assert len(found) == 5 and {x["error"] for x in found} == {0}
    assert vector_codes.compress(vectors(spark, rows).filter("false")).count() == 0


def test_annulus_is_exact_and_prunes():
    r = np.random.default_rng(1)
    for spread in (1, 50, 4000):
        book = r.integers(-spread, spread + 1, (16, 8)) * np.arange(1, 17)[:, None]
        x = r.integers(-spread, spread + 1, (500, 8)) * r.integers(1, 17, (500, 1))
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        seen = []
        index, best = vector_codes.nearest(x, book, seen)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
        slow, far = vector_codes.nearest(x[:40].astype(object), book.astype(object))
        assert (slow == d[:40].argmin(1)).all() and (far.astype(np.int64) == d[:40].min(1)).all()
    assert seen[0] < 16 * 500 * 0.9


def test_sql_of_the_new_queries(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name in ("op11_minhash_dedup", "op12_conversation_repair", "op13_vector_codes"):
        found, wanted = queries.queries()[name](spark, data).toPandas(), db.execute(queries.oracle_sql()[name]).df()
        order = sorted(wanted.columns)
        assert sorted(found.columns) == order
        assert sorted(map(str, found[order].values.tolist())) == sorted(map(str, wanted[order].values.tolist())), name
