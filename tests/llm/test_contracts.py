"""Each operator's contract on small fixtures, against brute force, and on odd rows and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import classifier, common, fingerprint, langid, licenses, mixing, ngram_join, packing, quality_rules, sharding, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies in a large group, shared passages and a common line."""
    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, base, passage, line = [], say(120), say(70), say(12)
    for i in range(240):
        kind = i % 6
        if kind == 0:
            text = list(base)
            for _ in range(r.randint(0, 9)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
        elif kind == 1:
            text = say(60) + passage + say(30)
        elif kind == 2:
            text = line + say(r.randint(3, 90))
        elif kind == 3 and i > 30:
            text = rows[r.randrange(len(rows))][1].split()
        else:
            text = say(r.randint(1, 150))
        rows.append((i, " ".join(text) + ("\n" if i % 5 == 0 else ""), ["en", "de"][i % 2], f"s{i % 4}" if i % 7 else None))
    return rows


# --- 1 -----------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def top(i):
        return i if label[i] == i else top(label[i])

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_ngram_join(docs, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_ROWS", 8)  # blocks are cut
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(corpus)).collect()}
    assert found == brute_components([(r[0], r[1]) for r in corpus])


def test_components(spark, monkeypatch):
    """Both ways to follow labels, on a long path, a star and cliques."""
    r = random.Random(4)
    order = r.sample(range(30), 30)
    edges = list(zip(order, order[1:], strict=False)) + [(300, 300 + k) for k in range(1, 80)] + [(400 + 5 * k + a, 400 + 5 * k + b) for k in range(9) for a in range(5) for b in range(a)]
    wanted = {i: 0 for i in range(30)} | {300 + k: 300 for k in range(80)} | {400 + 5 * k + a: 400 + 5 * k for k in range(9) for a in range(5)}
    table = spark.createDataFrame(edges, "a long, b long")
    monkeypatch.setattr(ngram_join, "SALTS", 4)
    for most in (1_000_000, -1):
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
        assert {x["node"]: x["label"] for x in ngram_join.components(table).collect()} == wanted


def test_ngram_join_odd(odd, empty):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6)} <= rows
    assert any(r[0] is None and r[2] is None for r in rows)
    assert ngram_join.jaccard_components(odd).count() == odd.count()
    assert ngram_join.jaccard_components(empty).count() == 0


def test_tree_bound_is_safe():
    r = np.random.default_rng(3)
    pool = common.mix64(np.arange(1, 400, dtype=np.uint64))
    sets = [np.sort(r.choice(pool[: r.integers(20, 399)], r.integers(5, 20), False)) for _ in range(40)] + [np.sort(pool[k : k + 100]) for k in range(0, 60, 4)]
    leaves = [ngram_join.leaf_of(i, len(s), i, ngram_join.bitmap(s).tobytes()) for i, s in enumerate(sets)]
    root = ngram_join.tree_of(leaves)
    found = {tuple(sorted(p)) for p in ngram_join.dual_traversal(root, root)}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in found


# --- 2 -----------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return {s: 3.0 * sizes[s] for s in names}
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        new = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not new:
            return {s: 3.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= new


def test_mixing(docs, corpus):
    rows = [(i, t, lang, s if s != "s0" or i > 200 else "s1") for i, t, lang, s in corpus]
    found = mixing.mix(docs(rows)).collect()
    source = {i: s for i, _, _, s in rows}
    sizes = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t))
    targets = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["size"] == len(WORD.findall(dict((x[0], x[1]) for x in rows)[r["doc_id"]])) and r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-6
    assert all(abs(taken[s] - targets[s]) <= mixing.PACKET for s in sizes) and sum(taken.values()) == sum(sizes.values())
    again = mixing.mix(docs(rows).repartition(5)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_mix_is_cut_in_the_queue(docs, corpus):
    documents, schedule = mixing.mix_schedule(docs(corpus))
    rows = sorted(schedule.collect(), key=lambda r: r["mix_start"])
    budget = sum(r["size"] for r in documents.collect())
    assert all(a["mix_start"] + a["words"] == b["mix_start"] for a, b in zip(rows, rows[1:], strict=False))
    assert all(a["finish"] <= b["finish"] for a, b in zip(rows, rows[1:], strict=False))
    assert all(r["taken"] == max(0, min(r["words"], budget - r["mix_start"])) for r in rows)
    # more is queued than the budget holds, so another order takes other words
    assert sum(r["words"] for r in rows) > budget
    left, other = budget, {}
    for r in rows[::-1]:
        other[r["row"], r["epoch"], r["packet"]] = min(left, r["words"])
        left -= min(left, r["words"])
    assert any(other[r["row"], r["epoch"], r["packet"]] != r["taken"] for r in rows)


def test_a_long_document_at_the_cut_leaves_sources_near_their_targets(docs):
    rows = [(i, "w " * (40_000 if i == 7 else 50), "en", "ab"[i % 2]) for i in range(60)]
    found = mixing.mix(docs(rows)).collect()
    for s in (0, 1):
        own = [r for r in found if r["doc_id"] % 2 == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= mixing.PACKET


def test_mixing_odd(odd, empty):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in found)
    assert mixing.mix(empty).count() == 0


# --- 3 -----------------------------------------------------------------------------------------------------------------


def test_network_gradient():
    r = np.random.default_rng(1)
    net = langid.ByteNetwork.new(3)
    spans = r.integers(97, 110, size=(4, 12)).astype(np.uint8)
    spans[1, 9:] = 0
    labels = np.array([0, 1, 2, 1])
    for name, part in zip(["inputs", "states", "output", "bias"], net.parts(), strict=True):
        setattr(net, name, part.astype(float))

    def loss():
        states, turned = net.states_of(spans)
        x = net.log_odds(states.astype(float))
        return -(x[:, labels, np.arange(4)] * (turned != 0)).sum() / (turned != 0).sum()

    for part, grad in zip(net.parts(), net.gradient(spans, labels), strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        part[at] += 1e-2
        up = loss()
        part[at] -= 2e-2
        down = loss()
        part[at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[at]) < 1e-3


def test_language_id(docs):
    r = random.Random(3)
    parts = {"aa": ["tha", "ing", "ed", "wor"], "bb": ["sch", "ung", "eit", "der"], "cc": ["eau", "oir", "ment", "les"]}
    rows = [(i, " ".join("".join(r.choices(parts[k], k=2)) for _ in range(30)), k) for i in range(240) for k in [list(parts)[i % 3]]]
    found = {x["doc_id"]: x for x in langid.identify(docs(rows)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(found[i]["held_out"] == (i in held) for i, _, _ in rows)
    assert np.mean([found[i]["lang_pred"] == k for i, _, k in rows if i in held]) > 0.95


def test_language_id_odd(odd, empty):
    found = langid.identify(odd).collect()
    assert len(found) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in found)
    assert langid.identify(empty).count() == 0
    assert langid.with_known_language(odd, 0.0).columns == odd.columns


# --- 4 -----------------------------------------------------------------------------------------------------------------


def test_fingerprints(docs, corpus):
    rows = [(r[0] * 3, r[1]) for r in corpus]
    random.Random(1).shuffle(rows)
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(docs(rows)).collect()}
    ordered = sorted(rows)
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        new = fingerprint.edited(text, following)
        r = found[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.digest(text.encode()) and r["edited_fingerprint"] == fingerprint.digest(new.encode())
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
    assert fingerprint.likeness("00" * 33, "00" * 33) == 1


def test_fingerprints_odd(odd, empty, docs):
    assert fingerprint.fingerprints(odd).count() == odd.count()
    assert fingerprint.fingerprints(empty).count() == 0
    one = fingerprint.fingerprints(docs([(5, "abcd")])).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


# --- 5 -----------------------------------------------------------------------------------------------------------------


def brute_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places, labels = [], set()
    for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(docs):
    texts = ["Released UNDER the MIT-License. under the mit license", "CC BY-NC and cc by nc 4", "Apache License, Version 2.0", "nothing", "cc by nc by nc", "a\u00e9b under the mit license\u00e9", "under the mit license under the mit license"]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_scan(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_expressions():
    assert licenses.evaluate("mit or gpl-3.0-only") == (1.0, ["mit", "gpl"])
    assert licenses.evaluate("mit and gpl-3.0-only") == (0.4, ["mit", "gpl"])
    assert licenses.evaluate("(mit or gpl-2.0) and apache-2.0")[0] == 0.9
    assert licenses.evaluate("gpl-2.0 with classpath-exception-2.0 or agpl-3.0")[0] == pytest.approx(0.5)
    assert licenses.evaluate("") is None and licenses.evaluate("mit or") == (1.0, ["mit"])
    assert licenses.scan(b"SPDX-License-Identifier: (MIT OR BSD-3-Clause)\nx")[5] == "bsd,mit"


def test_every_tag_of_a_line_counts():
    found = licenses.scan(b"SPDX-License-Identifier: MIT some text SPDX-License-Identifier: GPL-3.0 more")
    assert found[5:] == ("gpl,mit", 0.4)
    assert licenses.scan(b"SPDX-License-Identifier: " + b"MIT AND " * 100 + b"GPL-3.0")[5:] == ("gpl,mit", 0.4)


def test_expressions_go_on_over_lines_while_a_parenthesis_is_open():
    labels = lambda text: licenses.scan(text)[5:]
    assert labels(b"# SPDX-License-Identifier: (MIT OR\n#   AGPL-3.0-only)\nimport os") == ("agpl,mit", 1.0)
    assert labels(b" * SPDX-License-Identifier: (GPL-2.0-only WITH\r\n *  Classpath-exception-2.0\r\n * ) AND Apache-2.0\r\n") == ("apache-2,gpl", 0.5)
    assert labels(b"// SPDX-License-Identifier: MIT AND\n// GPL-3.0") == ("mit", 1.0)
    assert labels(b"SPDX-License-Identifier: (MIT OR\nsome (prose) goes on\nBSD") == ("mit", 1.0)
    assert labels(b"SPDX-License-Identifier: (" * 3 + b"ISC") == ("isc", 1.0)


def test_words_that_are_no_identifiers_give_no_label():
    labels = lambda text: licenses.scan(b"SPDX-License-Identifier: " + text)[5]
    assert labels(b"hello world") == "" and labels(b"") == "" and labels(b"\n") == ""
    assert labels(b"NOASSERTION") == "noassertion" and labels(b"NONE") == "none"
    assert labels(b"LicenseRef-Own-1.0 AND MIT") == "licenseref-own-1.0,mit"
    assert labels(b"DocumentRef-x:LicenseRef-y") == "documentref-x:licenseref-y"
    assert labels(b"MIT WITH nothing") == "mit" and labels(b"MIT OR hello") == "mit"
    for name in ("0BSD", "Apache-2.0", "BSD-3-Clause-Clear", "CC-BY-SA-4.0", "EUPL-1.2", "GPL-2.0+", "LGPL-2.1-or-later", "MPL-2.0", "OFL-1.1", "Unlicense", "Zlib", "GFDL-1.3-no-invariants-only"):
        assert labels(name.encode()) == licenses.label_of(name.lower()), name


def test_long_text_with_an_open_parenthesis():
    assert licenses.scan(b"SPDX-License-Identifier: (MIT\n" + b"# a line of text\n" * 200_000)[5] == "mit"


def test_licenses_odd(odd, empty):
    found = licenses.scan_licenses(odd).collect()
    assert len(found) == odd.count() and all(r["score"] == 0 and r["labels"] == "" for r in found)
    assert licenses.scan_licenses(empty).count() == 0


# --- 6 -----------------------------------------------------------------------------------------------------------------


def brute_shape(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_shape(docs):
    r = random.Random(5)
    texts = ["".join(r.choices(["a ", "b ", "é ", "#", "\n", "x y z ", "漢 ", "\t", "a\n"], k=r.randint(0, 60))) for _ in range(150)] + [None, "", "\n\n", "a b c a b c"]
    found = {x["doc_id"]: x for x in quality_rules.apply_rules(docs(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        x = found[i]
        shape = (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"])
        assert shape == brute_shape(text)
        assert x["base_failed"] == (shape[0] < 50 or 100 * shape[4] > 50 * shape[0]) and not (x["kept"] and x["base_failed"])


def brute_model(texts):
    """Modified Kneser-Ney of order 4 over characters, by dictionaries: a function of (text, whether it is one of the texts)."""
    clean = lambda t: "".join("0" if c.isascii() and c.isdigit() else " " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in t)
    grams = lambda t: [("\2\2\2" + clean(t))[i : i + 4] for i in range(len(t))]
    counts = {4: {}}
    for t in texts:
        for g in grams(t):
            counts[4][g] = counts[4].get(g, 0) + 1
    for k in (3, 2, 1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

    def discounts(table):
        n1, n2, n3, n4 = (sum(v == i for v in table.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        found = [i - (i + 1) * y * b / a if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return [0.0] + [min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1)]

    ds = {k: discounts(counts[k]) for k in counts}

    def probability(g, table, k):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        own = {x: n for x, n in table.items() if x[:-1] == g[:-1] and n > 0}
        total, d = sum(own.values()), ds[k]
        lower = probability(g[1:], counts.get(k - 1), k - 1)
        if not total:
            return lower
        n = own.get(g, 0)
        return max(n - d[min(n, 3)], 0) / total + sum(d[min(v, 3)] for v in own.values()) / total * lower

    def log_p(t, own):
        table = dict(counts[4])
        if own:
            for g in grams(t):
                table[g] -= 1
        return sum(np.log(probability(g, table, 4)) for g in grams(t))

    return log_p


def test_language_model_against_brute_force(docs):
    r = random.Random(3)
    say = lambda: " ".join("".join(r.choices("abcde", k=r.randint(1, 5))) for _ in range(r.randint(1, 12)))
    texts = [say() for _ in range(14)] + ["Ab 12\tx", "abba abba", "zzz\u00e9\u6f22"]
    texts.append(texts[0])
    wanted = brute_model(texts)
    model = quality_rules.NgramModel.of(*quality_rules.kneser_ney(quality_rules.count_grams(docs(list(enumerate(texts))))))

    def found(some, own):
        raw = [t.encode() for t in some]
        grams, at = quality_rules.grams_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        return model.log_p(grams, at, own)

    assert np.allclose(found(texts, True), [wanted(t, True) for t in texts])
    other = ["qq xyz", "abcq zz", "", "b", "\u6f22\u6f22 ab"]  # n-grams, contexts and characters that were never seen
    assert np.allclose(found(other, False), [wanted(t, False) for t in other])
    scored = {x["doc_id"]: x["log_perplexity"] for x in quality_rules.apply_rules(docs(list(enumerate(texts)))).collect()}
    assert np.allclose([scored[i] for i in range(len(texts))], [-wanted(t, True) / len(t) for t in texts], atol=1e-6)


def test_language_model_sums_to_one(docs, corpus):
    model, _, lower = quality_rules.kneser_ney(quality_rules.count_grams(docs(corpus)))
    assert model.agg(F.sum("n")).first()[0] == sum(len(r[1]) for r in corpus)
    sums = lower.filter("k = 1 OR k = 0").agg(F.sum("p")).first()[0]
    assert sums == pytest.approx(1)


def test_layouts_agree(docs, corpus):
    one = sorted(map(tuple, quality_rules.apply_rules(docs(corpus).coalesce(1)).collect()))
    assert one == sorted(map(tuple, quality_rules.apply_rules(docs(corpus).repartition(7, "n_chars")).collect()))


def test_equal_keys_are_grouped():
    r = np.random.default_rng(2)
    keys = r.integers(0, 50, 5000).astype(np.uint64)
    for wide in (20, 4):  # numbers with places, and the plain way
        order = quality_rules._grouped(keys, wide)
        ordered = keys[order]
        assert len(quality_rules._starts(ordered)) == len(np.unique(keys))
        assert all((np.diff(order[ordered == k]) > 0).all() for k in range(50))


def test_model_routes_agree(docs, corpus):
    a = {r["doc_id"]: r for r in quality_rules.apply_rules(docs(corpus)).collect()}
    b = {r["doc_id"]: r for r in quality_rules.apply_rules(docs(corpus), model_rows=0).collect()}
    assert all(abs(a[i]["log_perplexity"] - b[i]["log_perplexity"]) < 2e-7 and a[i]["kept"] == b[i]["kept"] for i in a)


def test_a_bad_third_does_not_open_the_band(docs):
    r = random.Random(8)
    parts = ["tha", "ing", "ed", "wor", "st", "er", "ou", "lan", "ck", "pre"]
    vocabulary = ["".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(300)]
    good = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(60, 200)))
    bad = lambda: " ".join("".join(r.sample(w, len(w))) for w in good().split())
    found = {x["doc_id"]: x["kept"] for x in quality_rules.apply_rules(docs([(i, bad() if i % 3 == 0 else good()) for i in range(600)])).collect()}
    assert np.mean([found[i] for i in range(0, 600, 3)]) < 0.02
    assert np.mean([found[i] for i in range(600) if i % 3]) > 0.97


def test_quality_odd(odd, empty):
    assert quality_rules.apply_rules(odd).count() == odd.count()
    assert quality_rules.apply_rules(odd, model_rows=0).count() == odd.count()
    assert quality_rules.apply_rules(empty).count() == 0


# --- 7 -----------------------------------------------------------------------------------------------------------------


def test_sharding(docs, corpus):
    found = sharding.shard(docs(corpus)).collect()
    text = {r[0]: r[1] for r in corpus}
    counts = np.bincount([r["shard"] for r in found], minlength=8)
    assert counts.max() - counts.min() <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))
    for r in found:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    of = {r["doc_id"]: r["shard"] for r in found}
    groups = {}
    for i, t in text.items():
        groups.setdefault(t, []).append(of[i])
    several = [g for g in groups.values() if len(g) > 1]
    assert several and np.mean([len(set(g)) == 1 for g in several]) > 0.8
    apart = sharding.cut_edges(sharding.shard(docs(corpus))).first()
    assert (apart["groups"], apart["split"]) == (len(several), sum(len(set(g)) > 1 for g in several))
    assert apart["apart"] == sum(len(g) - max(np.bincount(g)) for g in several)


def test_small_groups_come_together_beside_a_hot_one(docs):
    """A group of a third of all rows fills shards of its own; the others meet elsewhere. Propagation is deterministic, so a plain
    simulation of its quotas isn't repeated here: the law and the cut edges are held."""
    r = random.Random(9)
    rows = [(i, "hot" if i % 3 == 0 else f"group {r.randrange(120)}" if i % 3 == 1 else f"alone {i}") for i in range(2400)]
    found = sharding.shard(docs(rows))
    counts = [x["n"] for x in found.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert max(counts) - min(counts) <= 1 and len(counts) == 8
    hot = sorted(x["n"] for x in found.filter(F.col("text_crc32") == zlib.crc32(b"hot")).groupBy("shard").agg(F.count("*").alias("n")).collect())
    assert sum(hot[-3:]) >= 0.9 * 800
    apart = sharding.cut_edges(found).first()
    assert apart["split"] <= 0.1 * apart["groups"]


def test_sharding_odd(odd, empty):
    found = sharding.shard(odd).collect()
    counts = np.bincount([r["shard"] for r in found], minlength=8)
    assert len(found) == odd.count() and counts.max() - counts.min() <= 1
    assert sharding.shard(empty).count() == 0


# --- 8 -----------------------------------------------------------------------------------------------------------------


def test_passages_are_found(docs, corpus):
    found = {}
    for r in substring.shared_passages(docs(corpus)).collect():
        assert r["source_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= substring.LEAST_WORDS
        found.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    seen, n = set(), substring.LEAST_WORDS
    for i, text, *_ in corpus:
        w = words(text)
        runs = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]
        for k, run in enumerate(runs):
            if run in seen:  # all but a few words at its edges, where the first occurrences of its seeds may read otherwise
                assert len(set(range(k, k + n)) - found.get(i, set())) <= substring.SEED_WORDS, i
        seen |= set(runs)


def test_fuzzy_passage_and_clean_documents(docs):
    r = random.Random(2)
    say = lambda n: ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(n)]
    passage = say(120)
    edited_ = list(passage)
    for k in range(20, 120, 20):
        edited_[k] = "edited"
    del edited_[50]
    rows = [(1, " ".join(say(40) + passage + say(40))), (2, " ".join(say(40) + edited_ + say(40))), (3, " ".join(say(200))), (4, " ".join(passage[:30] + say(100)))]
    found = substring.shared_passages(docs(rows)).collect()
    assert {(x["doc_id"], x["source_doc_id"]) for x in found} == {(2, 1)}
    span = max(x["end_word"] - x["start_word"] for x in found)
    assert span >= 110
    left = {x["doc_id"]: x for x in substring.without_passages(docs(rows), substring.shared_passages(docs(rows))).collect()}
    assert len(left[2]["text"].split()) <= 90 and left[1]["text"] == rows[0][1] and left[2]["n_chars"] == len(left[2]["text"])


def planted(r, words_, share, regular=False):
    """A passage and a copy of which about the given share of the words agree."""
    say = lambda n: ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(n)]
    passage = say(words_)
    copy_ = list(passage)
    changed = range(0, words_, round(1 / (1 - share))) if regular else r.sample(range(1, words_ - 1), int(words_ * (1 - share)))
    for k in changed:
        copy_[k] = "changed"
    return say(30) + passage + say(30), say(40) + copy_ + say(30)


def test_passages_of_the_stated_share_are_found(docs):
    r = random.Random(11)
    rows, n = [], 0
    for share, regular in ((0.76, False), (0.8, False), (0.85, False), (0.9, False), (0.8, True), (0.875, True), (0.9, True)):
        for size in (64, 100):
            for _ in range(10):
                first, second = planted(r, size, share, regular)
                rows += [(n, " ".join(first)), (n + 1, " ".join(second))]
                n += 2
    found = {(x["source_doc_id"], x["doc_id"]) for x in substring.shared_passages(docs(rows)).collect()}
    assert found <= {(k, k + 1) for k in range(0, n, 2)}
    assert len(found) >= 0.95 * n / 2


def test_passage_whose_lines_stand_alone_before(docs):
    """The first occurrences of nearly all its short seeds are in documents that have one of its lines."""
    r, rows, wanted = random.Random(5), [], set()
    say = lambda n: ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(n)]
    for k in range(0, 120, 4):
        size = (28, 35, 45)[k // 4 % 3]
        one, two = say(size), say(size)
        for j, text in enumerate([one, two, one + two, one + two]):
            rows.append((k + j, " ".join(say(20) + text + say(20))))
        wanted.add((k + 3, k + 2, 2 * size))
    found = {(x["doc_id"], x["source_doc_id"], x["matched_words"]) for x in substring.shared_passages(docs(rows)).collect()}
    assert wanted <= found


def test_passages_whose_seeds_are_first_elsewhere(docs):
    """The first occurrences of all seeds are in documents that share too little."""
    r = random.Random(9)
    say = lambda n: ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(n)]
    rows, wanted = [], {}

    def add(text):
        rows.append((len(rows), " ".join(say(20) + text + say(20))))
        return len(rows) - 1

    few = say(50)  # 46 words of it come first
    add(few[:46])
    source = add(few)
    wanted[add(few)] = source, 50
    one, two = say(28), say(30)  # a word between them differs, so no seed leads over it
    add(one), add(two)
    source = add(one + say(1) + two)
    wanted[add(one + say(1) + two)] = source, 59
    one, two = say(28), say(30)  # as before, and many have the lines
    for _ in range(2 * substring.FEW):
        add(one), add(two)
    source = add(one + say(1) + two)
    wanted[add(one + say(1) + two)] = source, 59
    many = say(50)  # one seed stands in few documents
    for _ in range(2 * substring.FEW):
        add(many[:49])
    source = add(many)
    wanted[add(many)] = source, 50
    found = {x["doc_id"]: (x["source_doc_id"], x["end_word"] - x["start_word"]) for x in substring.shared_passages(docs(rows)).collect()}
    assert found == wanted


def test_text_that_repeats_itself_makes_few_chains(docs):
    r = random.Random(6)
    say = lambda n: ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(n)]
    line = say(12)
    rows = [(1, " ".join(say(40) + ["the"] * 600 + say(20) + line * 9)), (2, " ".join(say(10) + ["the"] * 400 + say(30) + line * 8 + say(9)))]
    table = docs(rows)
    assert substring.chains(substring.matches(table)).count() <= 12
    covered = set()
    for x in substring.shared_passages(table).collect():
        assert (x["doc_id"], x["source_doc_id"]) == (2, 1)
        covered.update(range(x["start_word"], x["end_word"]))
    assert set(range(10, 410)) | set(range(440, 536)) <= covered and not covered & set(range(0, 10))


def test_long_gap_with_equal_words():
    one = np.arange(3000)
    other = one.copy()
    other[::7] += 10_000
    assert (substring.agreeing(one, other) >= 0).sum() == (one == other).sum()
    assert (substring.agreeing(one, np.concatenate([one, one + 20_000])) == one).all()
    r = np.random.default_rng(1)
    x, y = r.integers(0, 30, 90), r.integers(0, 30, 70)
    held, substring.GAP_CELLS = substring.GAP_CELLS, 100
    cut = substring.agreeing(x, y)
    substring.GAP_CELLS = held
    whole = substring.agreeing(x, y)
    for found in (cut, whole):
        assert (np.diff(found[found >= 0]) > 0).all() and (x[found >= 0] == y[found[found >= 0]]).all()
    assert (cut >= 0).sum() == (whole >= 0).sum()


def test_chaining_is_best():
    """The Fenwick tree's chain against all chains."""
    r = np.random.default_rng(0)
    for _ in range(20):
        starts, sources = r.integers(0, 60, 7), r.integers(0, 60, 7)
        parts = np.stack([starts, starts + 8, sources, np.full(7, 8)], 1)
        parts = np.unique(parts, axis=0)

        def best(i, parts=parts):
            a = parts[i]
            gains = [0.0]
            for j, b in enumerate(parts):
                end = b[2] + b[1] - b[0]
                if b[1] <= a[0] and end <= a[2]:
                    gains.append(best(j) - substring.GAP_COST * (a[0] - b[1] + a[2] - end))
            return a[3] + max(gains)

        chain = next(substring.best_chains(parts))
        score = sum(parts[i, 3] for i in chain)
        for i, j in zip(chain, chain[1:], strict=False):
            score -= substring.GAP_COST * (parts[j, 0] - parts[i, 1] + parts[j, 2] - (parts[i, 2] + parts[i, 1] - parts[i, 0]))
        assert score == pytest.approx(max(best(i) for i in range(len(parts))))


def test_matches_are_packed(docs):
    """Few rows for Spark to sort hold every match with a first occurrence."""
    r = random.Random(12)
    say = lambda n: ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(n)]
    lines = [say(30) for _ in range(40)]
    texts = [sum(r.sample(lines, 6), []) for _ in range(120)]
    first, wanted = {}, set()
    for i, text in enumerate(texts):
        for k in range(len(text) - 3):
            source = first.setdefault(tuple(text[k : k + 4]), (i, k))
            if source[0] < i:
                wanted.add((i, source[0], k, source[1]))
    rows = substring.matches(docs([(i, " ".join(text)) for i, text in enumerate(texts)])).collect()
    assert len(rows) < len(wanted) / 20
    found = [x for row in rows if row["kind"] == substring.NEW for x in zip(*(c.tolist() for c in substring.columns_of(row["kind"], row["data"])), strict=True)]
    found = [x[:4] for x in found if x[4] == substring.SEED_WORDS]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_seeds_take_little_memory(spark):
    """Python workers work beside a JVM that may have its whole heap from an earlier stage."""
    import tracemalloc

    import pyarrow as pa

    class Kept:
        def filter(self, _):
            return self

        def mapInArrow(self, run, _):
            return run

    r = random.Random(13)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=5)) for _ in range(5000)]
    texts = [" ".join(r.choices(vocabulary, k=400)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        n = sum(len(substring.unpacked(x, 5)) for rows in substring.seeds(Kept(), 8)(iter([batch])) for x in rows.column(2).to_pylist())
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
    assert n > 2000 * 397


def test_packed_rows_come_back():
    r = np.random.default_rng(3)
    n = 5000
    columns = [r.integers(-(1 << 63), (1 << 63) - 1, n), np.where(r.random(n) < 0.5, -(1 << 63), (1 << 63) - 1), r.integers(0, 1 << 40, n), np.full(n, -7), r.integers(0, 2, n)]
    rows = substring.packed(substring.RUNS, 16, columns[2], columns).to_pylist()
    assert [x["bucket"] for x in rows] == list(range(16))
    back = [np.concatenate(x) for x in zip(*(substring.columns_of(x["kind"], x["data"]) for x in rows), strict=True)]
    assert sorted(zip(*(x.tolist() for x in back), strict=True)) == sorted(zip(*(x.tolist() for x in columns), strict=True))
    for keys in (columns[:3], [columns[3], columns[2], columns[4]], [r.integers(0, 9, n) << k for k in (30, 35, 36, 0)]):
        order = substring.order_of(*keys)
        assert all((k[order] == k[np.lexsort(keys[::-1])]).all() for k in keys)


def test_only_chains_without_a_passage_are_left_out():
    r = np.random.default_rng(4)
    rows, chained = [], []
    for _ in range(400):
        words_ = int(r.integers(3, 60))
        parts = np.array([[70, 78, 90, 8], [78 + words_, 86 + words_, 98 + words_, 8]])
        own = [r.integers(0, 5000, k).astype(np.uint32) for k in (64, words_, int(r.integers(0, 65)))]
        share = r.random()
        other = [np.where(r.random(len(x)) < share, x, 9000).astype(np.uint32) for x in own]
        rows.append({"parts": parts.tobytes(), "own": b"".join(x.tobytes() for x in own), "own_counts": np.array([len(x) for x in own], np.int32).tobytes(), "other": b"".join(x.tobytes() for x in other), "n": len(rows)})
        chained.append((parts, own, other))
    have = {k for k, found in enumerate(substring.aligned(chained)) if list(found)}
    kept = {x["n"] for x in substring.hopeful(rows)}
    assert have <= kept and 50 < len(have) and len(kept) < 350


def test_substring_odd(odd, empty):
    assert substring.shared_passages(odd).count() == 0
    assert substring.shared_passages(empty).count() == 0
    assert substring.without_passages(odd, substring.shared_passages(odd)).count() == odd.count()


# --- 9 -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def check_packing(rows, found, tokenizer, capacity=2048):
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in own] == [(k * capacity, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cuts)]
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in found) // capacity)


def test_packing(docs, corpus, tokenizer):
    rows = [(r[0], r[1]) for r in corpus] + [(900, None), (901, "word " * 5000), (902, "\u0130\u03a3\u03c2 it's WE'LL <|endoftext|> a\x1cb \u00e9\u0301 \ufb01 \u3000x")]
    used, least = check_packing(rows, packing.pack(docs(rows), tokenizer[0]).collect(), tokenizer[1])
    assert used <= least + 1


def test_genetic_packing():
    """Sizes for which largest-first is not best, and the operators' bookkeeping."""
    r = np.random.default_rng(4)
    pieces = {int(k): int(n) for k, n in zip(r.integers(300, 1200, 60), r.integers(1, 9, 60), strict=True)}
    first = packing.pack_new(dict(pieces), 2048, r, 0.0, tries=1)
    second = packing.pack_new(dict(pieces), 2048, r, 0.5)
    child = packing.crossover(first, second, pieces, 2048, r)
    for s in (first, second, child):
        assert packing.taken(s) == pieces and all(sum(p) <= 2048 for p in s)
    best = packing.evolve([first], pieces, 2048, 6, 1)[0]
    assert packing.taken(best) == pieces and packing.fitness(best, 2048) >= packing.fitness(first, 2048)
    assert packing._unpacked(packing._packed(best)) == best


def triplets(n):
    """Lengths that fill n sequences exactly, three to each; largest first leaves gaps."""
    r = np.random.default_rng(n)
    out = {}
    for _ in range(n):
        a = int(r.integers(690, 1000))
        b = int(r.integers(400, 2048 - a - 300))
        for k in (a, b, 2048 - a - b):
            out[k] = out.get(k, 0) + 1
    return out


def test_evolution_lowers_the_count(spark):
    pieces = triplets(300)
    first = min(sum(packing.pack_new(dict(pieces), 2048, np.random.default_rng(k), 0.1 * k).values()) for k in range(packing.POPULATION))
    one = sum(packing.evolve([], pieces, 2048, packing.GENERATIONS, 0)[0].values())
    best = packing.solve(spark, pieces)
    assert packing.taken(best) == pieces and 300 <= sum(best.values()) <= one < first


def test_migrants_breed():
    """An island that gets a neighbour's best solution is at least as good afterwards as that one, and keeps its own pieces."""
    pieces = triplets(100)
    poor = [packing.pack_new(dict(pieces), 2048, np.random.default_rng(0), 0.0, tries=1)]
    migrant = packing.evolve([], pieces, 2048, 30, 5)[0]
    assert packing.fitness(migrant, 2048) > packing.fitness(poor[0], 2048)
    after = packing.evolve([*poor, migrant], pieces, 2048, 5, 1)[0]
    assert packing.fitness(after, 2048) >= packing.fitness(migrant, 2048) and packing.taken(after) == pieces


def test_packing_odd(odd, empty, tokenizer):
    found = packing.pack(odd, tokenizer[0]).collect()
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in odd.collect()}
    assert packing.pack(empty, tokenizer[0]).count() == 0


# --- 10 ----------------------------------------------------------------------------------------------------------------


def test_classifier(spark, docs):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(60)) + "."
    bad = lambda: " ".join("".join(r.choices("ABC#$%!!", k=6)) for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, ""), (901, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, None, 0), (2, 7, 1)], "doc_id long, quality int, toxic int")
    found = {x["doc_id"]: x for x in classifier.score_quality(docs(rows), labels).collect()}
    assert len(found) == 302 and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in found.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i]["held_out"] == (i in held) for i in range(300))
    assert np.mean([found[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.95


def test_pairs_learn_what_single_features_cannot():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = classifier.fit(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9


def test_classifier_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x["score"] for x in classifier.score_quality(odd, none).collect()} == {0.5}
    assert classifier.score_quality(empty, none).count() == 0


# --- shared ------------------------------------------------------------------------------------------------------------


def test_running_sums(spark):
    df = spark.range(3000).withColumns({"g": F.when(F.col("id") % 3 == 0, 1).otherwise(0), "v": F.col("id") % 7})
    found = common.running(df, ["g"], common.key_of("id"), [F.col("id")], F.col("v"), 3_000_000, "s").collect()
    for g in (0, 1):
        own = sorted((r for r in found if r["g"] == g), key=lambda r: r["s"] * 10_000 + r["v"])
        assert max(r["s"] + r["v"] for r in own) == sum(r["v"] for r in own)


def test_word_hashes():
    texts = ["a bc", "bc", "", "A\tb\x0bC", "é é\u00a0x"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    hashes, starts, ends, at = common.word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    got = [[b"".join(raw)[s:e].decode().lower() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [words(t) for t in texts]
    assert hashes[1] == hashes[2] and hashes[0] == hashes[3] and len(set(hashes.tolist())) == 6
