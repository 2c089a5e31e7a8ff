"""Quality classifier: a generalised additive model with pairwise interactions. Cyclic boosting of shallow trees learns a
lookup table for each feature and for a few pairs of features; a score is a sum of table entries."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, map_text, stored, table_rows, windows, word_hashes

#: Labelled rows that the model is fitted on at most (those with the smallest hashed ids).
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE, LEAF_WEIGHT = 150, 60, 0.1, 1.0, 1.0

_LINES = np.zeros(256, bool)
_LINES[10] = True
_CLASSES = ["lower", "upper", "digit", "space", "line", "stop", "comma", "shout", "symbol", "other", "lead", "tail"]


def _classes() -> np.ndarray:
    out = np.full(256, _CLASSES.index("other"), np.int64)
    for name, chars in {
        "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": [9, 11, 12, 13, 32], "line": [10],
        "stop": b".", "comma": b",;:", "shout": b"!?", "symbol": b"#*$%&|<>~^=+_@\\/{}[]", "lead": range(192, 256), "tail": range(128, 192),
    }.items():
        out[list(chars)] = _CLASSES.index(name)
    return out


FEATURES = [
    "log_words", "word_bytes", "short_words", "long_words", "upper", "digits", "symbols", "shouts", "stops", "commas", "lines", "other_marks",
    "letters_beyond_ascii", "distinct_words", "repeated_lines", "repeated_triples", "entropy", "top_word", "line_bytes",
]


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    n = len(offsets) - 1
    k = len(_CLASSES)
    size = np.diff(offsets)
    of_byte = np.repeat(np.arange(n), size)
    count = np.bincount(of_byte * k + _classes()[data], minlength=n * k).reshape(n, k).astype(float)
    c = {name: count[:, i] for i, name in enumerate(_CLASSES)}
    hashes, starts, ends, at = word_hashes(data, offsets)
    lines, _, _, line_at = word_hashes(data, offsets, lower=False, separator=_LINES)
    length, words = ends - starts, np.diff(at).astype(float)
    summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
    some = np.maximum(words, 1)
    letters = np.maximum(c["lower"] + c["upper"] + c["lead"], 1)
    out = np.zeros((n, len(FEATURES)), np.float32)
    out[:, 0] = np.log1p(words)
    out[:, 1] = summed(length) / some
    out[:, 2] = summed(length <= 3) / some
    out[:, 3] = summed(length > 14) / some
    out[:, 4] = c["upper"] / letters
    marks = np.maximum(size, 1)
    out[:, 5], out[:, 6], out[:, 7] = c["digit"] / marks, c["symbol"] / marks, c["shout"] / some
    out[:, 8], out[:, 9], out[:, 10], out[:, 11] = c["stop"] / some, c["comma"] / some, c["line"] / some, c["other"] / marks
    out[:, 12] = c["lead"] / letters
    for i in range(n):
        own = np.sort(hashes[at[i] : at[i + 1]])
        if not len(own):
            continue
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        out[i, 13] = (len(new) - 1) / len(own)
        out[i, 17] = np.diff(new).max() / len(own)
        if (m := line_at[i + 1] - line_at[i]) > 1:
            out[i, 14] = 1 - len(np.unique(lines[line_at[i] : line_at[i + 1]])) / m
        if len(own) > 3:
            triples = np.sort(windows(hashes[at[i] : at[i + 1]], 3))
            out[i, 15] = np.count_nonzero(triples[1:] == triples[:-1]) / len(triples)
        p = np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256)
        p = p[p > 0] / p.sum()
        out[i, 16] = -(p * np.log2(p)).sum()
        out[i, 18] = np.log1p(size[i] / (c["line"][i] + 1))
    return out


@dataclass
class AdditiveModel:
    """base + one table per feature + one table per pair, in log odds."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins).astype(np.float32))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of three leaves at most over ordered bins: the best cut, then the best cut of one of its sides."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    for _ in range(2):
        best = (1e-12, None)
        for a, b in parts:
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAF_WEIGHT) | (all_h - left_h < LEAF_WEIGHT)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), (a, b, a + 1 + int(gain.argmax())))
        if best[1] is None:
            break
        a, b, cut = best[1]
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross cut of a two-dimensional table: (gain, four leaves spread over the table)."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def four(c):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        return a, b, d, c[-1, -1] - a - b - d

    gain = sum(x**2 / (y + RIDGE) for x, y in zip(four(cg), four(ch), strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + RIDGE)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fits the model; with one class only, or no rows, every score is that class's smoothed share (0.5 without rows)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.cuts, model.coarse = [_cuts(f, BINS) for f in x.T], [_cuts(f, PAIR_BINS) for f in x.T]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = [np.searchsorted(c, f, "right") for c, f in zip(model.cuts, x.T, strict=True)]
    odds = np.full(len(y), model.base)

    def pull(where: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-odds))
        return np.bincount(where, y - p, bins), np.bincount(where, p * (1 - p), bins)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            step = RATE * _tree(*pull(at[j], len(table)))
            table += step
            odds += step[at[j]]
    coarse = [np.searchsorted(c, f, "right") for c, f in zip(model.coarse, x.T, strict=True)]
    shape = lambda a, b: (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
    flat = lambda a, b: coarse[a] * (len(model.coarse[b]) + 1) + coarse[b]

    def pair_pull(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        rows, columns = shape(a, b)
        g, h = pull(flat(a, b), rows * columns)
        return g.reshape(rows, columns), h.reshape(rows, columns)

    gains = {(a, b): _quadrants(*pair_pull(a, b))[0] for a, b in itertools.combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pair_tables = [np.zeros(shape(*p)) for p in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * _quadrants(*pair_pull(a, b))[1]
            table += step
            odds += step.ravel()[flat(a, b)]
    return model


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Learns from rows of `labels` (doc_id, quality) whose crc32(doc_id as text) mod 3 is not 1, of at most `sample` documents,
    those with the smallest hashed ids. Labels that are null or neither 0 nor 1 are left out; of several labels of a document
    the mean counts, 0.5 as 1. Features come from the whole text alone, however long; null and empty texts have zeros as features.
    A null id is never held out and never learned from. Repeated rows give repeated results; of texts that share an id the one with
    the smallest features is learned from. An empty table gives no rows, one without labels scores of 0.5. Other columns are ignored.
    """
    rows = map_text(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), "doc_id long, x array<float>", _feature_rows)
    features = stored(rows, "features")
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    learned = features.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("quality").alias("quality")).orderBy("doc_id").toPandas()
    x = np.array(learned["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    model = features.sparkSession.sparkContext.broadcast(fit(x, learned["quality"].to_numpy(float)))
    schema = "doc_id long, held_out boolean, score double, predicted int"
    kind = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
                score = model.value.score(x)
                yield table_rows({"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= 0.5).astype(np.int32)}, kind)

    return features.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "x").mapInArrow(run, schema)


def _feature_rows(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
    x = text_features(data, offsets)
    return {"doc_id": part.column(0), "x": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())}
