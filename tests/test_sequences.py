"""Longest common subsequences against the table of lengths, and line differences made from them."""

import random

import pytest

from tidemark.operators import sequences, text


def table_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def checked(a, b):
    found = list(sequences.matches(a, b))
    assert all(a[i] == b[j] for i, j in found)
    assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:], strict=False))
    return len(found)


@pytest.mark.parametrize("most", [0, 1, 3, 512])
def test_greatest_length(monkeypatch, most):
    """With few or no steps by paths, the halving by bit sets does the work."""
    monkeypatch.setattr(sequences, "PATHS", most)
    r = random.Random(most)
    for _ in range(400):
        letters = "abcdefgh"[: r.randint(1, 8)]
        a, b = ("".join(r.choices(letters, k=r.randint(0, 40))) for _ in "ab")
        assert checked(a, b) == table_length(a, b), (a, b)


def test_lengths_of_all_prefixes():
    r = random.Random(1)
    for _ in range(100):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 30))] for _ in "ab")
        assert sequences.lengths(a, b).tolist() == [table_length(a[:i], b) for i in range(len(a) + 1)]


def test_masks_that_are_not_kept(monkeypatch):
    monkeypatch.setattr(sequences, "MASK_BYTES", 0)
    a, b = "abcabba" * 30, "cbabac" * 30
    monkeypatch.setattr(sequences, "PATHS", 0)
    assert checked(a, b) == table_length(a, b)


def test_long_sequences():
    r = random.Random(2)
    a = [r.randrange(50) for _ in range(3000)]
    b = r.sample(a, len(a))
    assert checked(a, b) == table_length(a, b)
    a = list(range(200_000))
    b = [x for x in a if x % 1000] + [5]
    assert checked(a, b) == 200_000 - 200
    assert checked(a, a[::-1][:2000]) == 1
    assert checked([0] * 5000, [0] * 3000) == 3000


def test_line_changes_are_the_fewest():
    r = random.Random(3)
    for _ in range(200):
        x, y = ([r.choice("abcd") for _ in range(r.randint(0, 25))] for _ in "xy")
        n = table_length(x, y)
        added, removed, examples = text.lines_changed("\n".join(x), "\n".join(y))
        assert (added, removed) == (len(y) - n, len(x) - n)
        assert len(examples) == min(text.EXAMPLES, added + removed)
    assert text.lines_changed("", "") == (0, 0, []) and text.lines_changed("", "a\nb") == (2, 0, ["+a", "+b"])
    assert text.lines_changed("a\nb\nc", "a\nx\nc\nd") == (2, 1, ["-b", "+x", "+d"])
