"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

It labels every position of a text and pools the positions' log probabilities into the document's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.classifier import remainder
from tidemark.llm.common import map_text, slices, stored, table_rows

UNKNOWN = "und"
#: Size of each direction's state; bytes that the network reads in one go (its state starts anew with each span).
HIDDEN, SPAN = 8, 128
#: Spans that the network is trained on at most for each language, from one document, and in all: with more than 200 languages each
#: has fewer, one document's at least.
SPANS, SPANS_OF_DOCUMENT, ALL_SPANS = 1_500, 4, 300_000
EPOCHS, BATCH, RATE, CLIP = 6, 128, 0.01, 1.0

#: Bytes as the network sees them: A-Z as a-z, digits and control characters as a blank, 0 pads.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[65:91] += 32
_SEEN[:32] = 32
_SEEN[48:58] = 32
_PAD = 0


def spans_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into spans of SPAN bytes, padded with 0: (spans, n + 1 offsets by text)."""
    size = np.diff(offsets)
    count = -(-size // SPAN)
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.full(at[-1] * SPAN, _PAD, np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] * SPAN - offsets[:-1], size)] = _SEEN[data]
    return out.reshape(-1, SPAN), at


@dataclass
class ByteNetwork:
    """Weights. inputs: (2, 3H, 256), states: (2, 3H, H), for the gates update, reset and candidate; output: (K, 2H) and (K,)."""

    inputs: np.ndarray
    states: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, classes: int, seed: int = 0) -> ByteNetwork:
        r = np.random.default_rng(seed)
        normal = lambda *shape: r.normal(0, 1, shape).astype(np.float32)
        h = HIDDEN
        return cls(normal(2, 3 * h, 256) * 0.3, normal(2, 3 * h, h) / np.float32(np.sqrt(h)), normal(classes, 2 * h) / np.float32(np.sqrt(2 * h)), np.zeros(classes, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.states, self.output, self.bias]

    def states_of(self, spans: np.ndarray, keep: bool = False):
        """States of both directions at each position, (T, 2H, B); with keep, also what backpropagation needs."""
        h, (b, t) = HIDDEN, spans.shape
        turned = np.ascontiguousarray(spans.T)
        out = np.empty((t, 2 * h, b), np.float32)
        kept: list[list] = [[], []]
        for d in (0, 1):
            state, u = np.zeros((h, b), np.float32), self.states[d]
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                gates = self.inputs[d].take(turned[i], axis=1)
                recurrent = u @ state
                zr = gates[: 2 * h]
                zr += recurrent[: 2 * h]
                np.tanh(zr, out=zr)  # sigmoid(2x) = (tanh(x) + 1) / 2: the factor 2 is in the weights
                zr *= np.float32(0.5)
                zr += np.float32(0.5)
                n = gates[2 * h :]
                n += recurrent[2 * h :] * zr[h:]
                np.tanh(n, out=n)
                new = state - n
                new *= zr[:h]
                new += n
                new *= turned[i] != _PAD  # padding leaves no trace
                if keep:
                    kept[d].append((i, state, zr, n, recurrent[2 * h :]))
                state = new
                out[i, d * h : (d + 1) * h] = new
        return (out, kept, turned) if keep else (out, turned)

    def log_odds(self, states: np.ndarray) -> np.ndarray:
        """Log probabilities by position, (T, K, B)."""
        x = np.matmul(self.output, states) + self.bias[:, None]
        x -= x.max(1, keepdims=True)
        x -= np.log(np.exp(x).sum(1, keepdims=True))
        return x

    def pooled(self, spans: np.ndarray) -> np.ndarray:
        """Log probabilities summed over each span's positions, (B, K)."""
        states, turned = self.states_of(spans)
        x = self.log_odds(states)
        return np.einsum("tkb,tb->bk", x, (turned != _PAD).astype(np.float32))

    def gradient(self, spans: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean loss over positions, each position having its document's language."""
        h = HIDDEN
        states, kept, turned = self.states_of(spans, keep=True)
        seen = (turned != _PAD).astype(np.float32)
        error = np.exp(self.log_odds(states))
        error[:, labels, np.arange(len(labels))] -= 1
        error *= seen[:, None, :] / np.float32(max(1.0, seen.sum()))
        d_inputs, d_states = np.zeros_like(self.inputs), np.zeros_like(self.states)
        d_output, d_bias = np.einsum("tkb,tjb->kj", error, states), error.sum((0, 2))
        back = np.matmul(self.output.T, error)
        for d in (0, 1):
            carry, u = np.zeros_like(states[0, :h]), self.states[d]
            for i, before, zr, n, recurrent in reversed(kept[d]):
                g = (back[i, d * h : (d + 1) * h] + carry) * seen[i]
                z, r = zr[:h], zr[h:]
                d_n = g * (1 - z) * (1 - n * n)
                d_z = g * (before - n) * z * (1 - z) * 2
                d_r = d_n * recurrent * r * (1 - r) * 2
                d_gates = np.concatenate([d_z, d_r, d_n])
                d_recurrent = np.concatenate([d_z, d_r, d_n * r])
                carry = g * z + u.T @ d_recurrent
                d_states[d] += d_recurrent @ before.T
                for j in range(3 * h):
                    d_inputs[d, j] += np.bincount(turned[i], d_gates[j], 256)
        return [d_inputs, d_states, d_output, d_bias]


def train(spans: np.ndarray, labels: np.ndarray, classes: int, seed: int = 0) -> ByteNetwork:
    """Adam over shuffled batches of spans, with clipped gradients and a falling rate."""
    net = ByteNetwork.new(classes, seed)
    r = np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    step, steps = 0, EPOCHS * -(-len(spans) // BATCH)
    for _ in range(EPOCHS):
        order = r.permutation(len(spans))
        for a in range(0, len(spans), BATCH):
            batch = order[a : a + BATCH]
            grads = net.gradient(spans[batch], labels[batch])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            step += 1
            rate = RATE * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                g = g * np.float32(min(1.0, CLIP / (norm + 1e-9)))
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.001) * (g * g - v)
                p -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-8))
    return net


def training_spans(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Spans, their labels, and the languages: from documents with a language, never from those held out.

    About SPANS spans of each language: each document gives up to SPANS_OF_DOCUMENT spans, spread over its whole length, and
    documents are chosen by their hashed ids at a rate that makes up that number.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & F.coalesce(remainder(F.col("doc_id"), 4) != 2, F.lit(False)))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language sample")), 11) / float(1 << 53)
    languages = stored(known.groupBy("lang").agg(F.count("*").alias("_n"), F.min(draw).alias("_first")), "languages")
    names = sorted(row["lang"] for row in languages.select("lang").collect())  # the classes of the network
    if not names:
        return np.zeros((0, SPAN), np.uint8), np.zeros(0, np.int64), []
    wanted = max(1.0, min(SPANS, ALL_SPANS / len(names)) / SPANS_OF_DOCUMENT)  # documents of each language
    # a language of few documents may have none drawn: the one that would be drawn first stands for it
    chosen = known.withColumn("_draw", draw).join(F.broadcast(languages), "lang").filter((F.col("_draw") < F.lit(wanted) / F.col("_n")) | (F.col("_draw") == F.col("_first")))
    chosen = chosen.select("doc_id", "lang", "text")

    def cut(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        spans, at = spans_of(data, offsets)
        picks = [np.unique(np.linspace(a, b - 1, SPANS_OF_DOCUMENT).astype(int)) for a, b in zip(at[:-1], at[1:], strict=True)]
        rows = np.repeat(np.arange(len(picks)), [len(p) for p in picks])
        return {"doc_id": part.column(0).take(pa.array(rows)), "lang": part.column(1).take(pa.array(rows)), "span": [spans[i].tobytes() for p in picks for i in p]}

    table = map_text(chosen, "doc_id long, lang string, span binary", cut).toArrow().sort_by([("doc_id", "ascending"), ("span", "ascending")])
    spans = np.frombuffer(b"".join(table.column("span").to_pylist()), np.uint8).reshape(-1, SPAN)
    return spans, np.searchsorted(names, table.column("lang").to_pylist()), names


def _has_letter(data: bytes) -> bool:
    return any(map(str.isalpha, data.decode("utf-8", "replace")))


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def predictions(model: tuple[ByteNetwork | None, list[str]], data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(languages, scores) of texts."""
    net, names = model
    n = len(offsets) - 1
    letters = np.diff(np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[offsets]) > 0
    for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
        letters[i] = _has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
    if net is None:
        return [UNKNOWN] * n, np.zeros(n)
    spans, at = spans_of(data, offsets)
    by_span = np.concatenate([net.pooled(spans[a : a + 2048]) for a in range(0, len(spans), 2048)] or [np.zeros((0, len(names)), np.float32)])
    total = np.concatenate([np.zeros((1, len(names))), np.cumsum(by_span, 0, dtype=np.float64)])[at]
    mean = np.diff(total, axis=0) / np.maximum(1, np.diff(offsets))[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return [names[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], np.where(letters, p[np.arange(n), best], 0.0)


def fitted(docs: DataFrame) -> tuple[ByteNetwork | None, list[str]]:
    """A model of the documents' own labels, without those held out."""
    spans, labels, names = training_spans(docs)
    return (train(spans, labels, len(names)) if names else None), names


def identify(docs: DataFrame, model: tuple[ByteNetwork | None, list[str]] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    Without a model, one is trained on the documents whose crc32(doc_id as text) mod 4 is not 2. Predictions come from the text
    alone. score: the language's share of the pooled probability, each position's log probabilities averaged and made sum to 1
    again. `und` with score 0 if the text is null, empty or without a letter, or if no language was learned. A very long text counts
    with all its spans. Repeated rows give repeated results; a null id is never held out and never learned from. An empty table gives no
    rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fitted(docs))
    held_out = F.coalesce(remainder(docs["doc_id"].cast("long"), 4) == 2, F.lit(False))

    def step(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        names, score = predictions(sent.value, data, offsets)
        return {"doc_id": part.column(0), "held_out": part.column(1), "lang_pred": names, "score": score}

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return map_text(rows, "doc_id long, held_out boolean, lang_pred string, score double", step)


def with_known_language(docs: DataFrame, least: float, model: tuple[ByteNetwork | None, list[str]] | None = None) -> DataFrame:
    """docs, all columns, without those whose language is `und` or has a score below `least`. Rows stay where they are."""
    from pyspark.sql.pandas.types import to_arrow_schema

    sent = docs.sparkSession.sparkContext.broadcast(model or fitted(docs))
    kind = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            names, score = predictions(sent.value, data, offsets)
            kept = pa.array([name != UNKNOWN and s >= least for name, s in zip(names, score, strict=True)])
            yield table_rows({f.name: part.column(i) for i, f in enumerate(kind)}, kind).filter(kept)

    return docs.mapInArrow(run, docs.schema)
