"""Quality rules: counts of a text's shape, and perplexity under a character n-gram model.

The model is of order 4 with modified Kneser-Ney smoothing. Spark counts n-grams over all documents and makes the probabilities
with joins; they are used as sorted arrays of n-grams. A document is scored by what the others say: its own counts are taken out of
the 4-grams, and what then has none backs off to the shorter ones. Documents outside their language's perplexity band fail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, arrow_schema, map_text, mix64, slices, stored, table_rows, windows, word_hashes

ORDER = 4
#: A model of at most so many n-grams (24 bytes each) is sent to the executors as sorted arrays; a larger one is joined, with the
#: same numbers as a result.
MODEL_ROWS = 4_000_000
#: Distinct n-grams that a task holds before it hands them on.
HELD = 1_500_000
#: A band reaches so many times half the width of the shortest interval that holds half of a language's perplexities, from its
#: middle: 3 standard deviations of a normal language, which rejects 0.25 % of it, and 5.2 where a third of all rows are bad.
WIDTH = 4.5
#: Half that interval's width is at least so much of its middle, as few or very like documents say little about a language.
LEAST_SPREAD = 0.02
#: Steps of the percentiles among which the shortest half is sought, and steps of a log perplexity, of which a language has a bounded
#: number, so that its percentiles are exact ones of a short list.
STEPS, GRID = 50, 10_000
#: Bands of at most so many languages are sent to the executors.
BAND_ROWS = 100_000
MIN_WORDS, REPEAT_PERCENT = 50, 50

_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SHAPE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"doc_id long, {SHAPE}, base_failed boolean, kept boolean, log_perplexity double"


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which numbers occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_shape(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; words as they are written."""
    n = len(offsets) - 1

    def per_text(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[at])

    hashes, _, _, at = word_hashes(data, offsets, lower=False)
    inside = ~SPACES[data]
    lines, starts, ends, _ = word_hashes(data, offsets, lower=False, separator=_NEWLINE)
    filled = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    lines, starts = lines[filled[ends] > filled[starts]], starts[filled[ends] > filled[starts]]
    line_at = np.searchsorted(starts, offsets, "left")
    of_word = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
    triple = windows(hashes, 3)
    whole = of_word[2:] == of_word[:-2]
    triple = np.where(whole, triple + of_word[: len(triple)] * np.uint64(0x9E3779B97F4A7C15), np.arange(len(triple), dtype=np.uint64))
    twice = _repeats(triple) & whole
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[j : j + len(twice)] |= twice
    return {
        "n_words": np.diff(at),
        "word_chars": per_text(inside & (data & 0xC0 != 0x80), offsets),
        "n_symbols": per_text(_SYMBOLS[data], offsets),
        "n_dup_lines": np.array([b - a - len(np.unique(lines[a:b])) if b - a > 1 else 0 for a, b in zip(line_at[:-1], line_at[1:], strict=True)], np.int64),
        "n_repeat_words": per_text(covered, at),
    }


def grams_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character, 16 bits a character, and n + 1 offsets by text.

    A-Z count as a-z, digits as 0, white space as a blank; each text starts with three marks.
    """
    raw = data.tobytes()
    chars = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[offsets]
    if at[-1] != len(chars):  # not UTF-8: text by text
        parts = [raw[a:b].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        chars = np.frombuffer(b"".join(parts), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
    code = np.where(chars > 0xFFFF, chars ^ (chars >> np.uint32(7)) | np.uint32(0xE000), chars) & np.uint32(0xFFFF)
    code[(chars >= 65) & (chars <= 90)] += np.uint32(32)
    code[(chars >= 48) & (chars <= 57)] = 48
    code[(chars >= 9) & (chars <= 13)] = 32
    n = len(at) - 1
    padded = np.full(len(code) + 3 * n, 2, np.uint64)
    place = np.arange(len(code)) + 3 * (np.repeat(np.arange(n), np.diff(at)) + 1)
    padded[place] = code
    out = np.zeros(len(code), np.uint64)
    for back in range(ORDER):
        out |= padded[place - back] << np.uint64(16 * back)
    return out, at


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[new], np.add.reduceat(c, new) if len(k) else c


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram, n) over all texts: each task counts its own first, then Spark adds up."""
    kind = arrow_schema("gram long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for _, data, offsets in slices(batches):
            k, c = np.unique(grams_of(data, offsets)[0], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HELD:
                k, c = _merged(keys, counts)
                if len(k) > HELD // 2:
                    yield table_rows({"gram": k.view(np.int64), "n": c}, kind)
                    k, c = k[:0], c[:0]
                keys, counts, held = [k], [c], len(k)
        if keys:
            k, c = _merged(keys, counts)
            if len(k):
                yield table_rows({"gram": k.view(np.int64), "n": c}, kind)

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _discounts(counts: DataFrame) -> list[float]:
    """Chen and Goodman's three discounts, from how many n-grams occur once to four times."""
    row = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in row)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    found = [i - (i + 1) * y * b / a if a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1)]


def _spread(table: DataFrame, d: list[float]) -> Column:
    return F.sum(_discount(F.col("n"), d))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, list[float], DataFrame]:
    """(model, discounts, lower) of counts as from count_grams().

    model: gram, n, total and spread (the sums of n and of the discounts over the 4-grams of its context), lower_p (the interpolated
    probability of its last three characters). lower: k, gram, p of the shorter n-grams, with k = -2 and -3 for the back-off weights
    of their contexts and k = 0 for a character that was never seen.
    """
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):  # below, an n-gram counts once for each character that comes before it
        mask = (1 << 16 * k) - 1
        orders.append(orders[-1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("n")))
    orders = [stored(table, "order") for table in orders[:0:-1]]  # 1, 2, 3
    d = _discounts(orders[0])
    total, kinds, spread = orders[0].agg(F.sum("n").cast("double"), F.count("*"), _spread(orders[0], d)).first()
    t, never = max(total or 1.0, 1.0), (spread or 1.0) / max(total or 1.0, 1.0) / ((kinds or 0) + 1)
    n = F.col("n").cast("double")
    probability = stored(orders[0].select("gram", ((n - _discount(n, d)) / t + never).alias("p")), "order")
    parts = [counts.sparkSession.createDataFrame([(0, 0, never)], "k int, gram long, p double"), probability.select(F.lit(1).alias("k"), "gram", "p")]
    context = F.shiftrightunsigned(F.col("gram"), 16)

    def extended(table: DataFrame, k: int, d: list[float], shorter: DataFrame) -> DataFrame:
        """table with context, total, spread and lower_p."""
        held = table.groupBy(context.alias("context")).agg(F.sum("n").cast("double").alias("total"), _spread(table, d).alias("spread"))
        short = F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))
        return table.withColumns({"context": context, "short": short}).join(held, "context").join(shorter.select(F.col("gram").alias("short"), F.col("p").alias("lower_p")), "short")

    for k in range(2, ORDER):
        d = _discounts(orders[k - 1])
        joined = stored(extended(orders[k - 1], k, d, probability), "order")
        probability = joined.select("gram", ((F.col("n") - _discount(F.col("n"), d)) / F.col("total") + F.col("spread") / F.col("total") * F.col("lower_p")).alias("p"))
        parts += [probability.select(F.lit(k).alias("k"), "gram", "p"), joined.select(F.lit(-k).alias("k"), F.col("context").alias("gram"), (F.col("spread") / F.col("total")).alias("p")).distinct()]
    lower = parts[0]
    for part in parts[1:]:
        lower = lower.unionByName(part)
    d = _discounts(counts)
    return extended(counts, ORDER, d, probability).select("gram", "n", "total", "spread", "lower_p"), d, lower


def _grouped(keys: np.ndarray, wide: int = 20) -> np.ndarray:
    """An order that puts equal keys together, earlier ones first."""
    if len(keys) <= 1 << wide:  # a sort of numbers, 44 bits of hash above the place, is much faster than one of places
        mixed = np.sort(mix64(keys) >> np.uint64(wide) << np.uint64(wide) | np.arange(len(keys), dtype=np.uint64))
        order = (mixed & np.uint64((1 << wide) - 1)).astype(np.int64)
        mixed >>= np.uint64(wide)
        ordered = keys[order]
        if np.array_equal(mixed[1:] != mixed[:-1], ordered[1:] != ordered[:-1]):
            return order
    return np.argsort(keys, kind="stable")


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(sorted_[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for x in sorted_:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


@dataclass
class NgramModel:
    """The model as sorted arrays. lower: by k as in kneser_ney(), sorted n-grams and their values; never: k = 0."""

    keys: np.ndarray
    n: np.ndarray
    lower_p: np.ndarray
    discounts: list[float]
    lower: dict[int, tuple[np.ndarray, np.ndarray]]
    never: float
    context: np.ndarray = field(init=False)
    total: np.ndarray = field(init=False)
    spread: np.ndarray = field(init=False)

    def __post_init__(self):
        first = _starts(self.keys >> np.uint64(16))  # n-grams of a context are neighbours
        self.context = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.concatenate([first, [len(self.keys)]])))
        self.total = np.add.reduceat(self.n, first) if len(first) else self.n
        self.spread = np.add.reduceat(self.discount(self.n), first) if len(first) else self.n.astype(float)

    @classmethod
    def of(cls, model: DataFrame, discounts: list[float], lower: DataFrame) -> NgramModel:
        def ordered(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
            keys = table.column("gram").to_numpy().view(np.uint64)
            order = np.argsort(keys)
            return keys[order], table.take(pa.array(order))

        keys, top = ordered(model.select("gram", "n", "lower_p").toArrow())
        below, sets = lower.toArrow(), {}
        k = below.column("k").to_numpy()
        for i in set(k.tolist()) - {0}:
            found, part = ordered(below.filter(pa.array(k == i)))
            sets[i] = found, part.column("p").to_numpy()
        return cls(keys, top.column("n").to_numpy(), top.column("lower_p").to_numpy(), discounts, sets, float(below.column("p").to_numpy()[k == 0][0]))

    def discount(self, n: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.discounts])[np.minimum(n, 3)]

    def shorter(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Probabilities of n-grams of k characters; what was never seen backs off."""
        if not k:
            return np.full(len(grams), self.never)

        def find(i: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, values = self.lower.get(i, (np.zeros(0, np.uint64), np.zeros(0)))
            if not len(keys):
                return np.zeros(len(x), bool), np.zeros(len(x))
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            return keys[at] == x, values[at]

        seen, out = find(k, grams)
        if not seen.all():
            rest = grams[~seen]
            weight = 1.0
            if k > 1:
                held, found = find(-k, rest >> np.uint64(16))
                weight = np.where(held, found, 1.0)
            out = out.copy()
            out[~seen] = weight * self.shorter(rest & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)
        return out

    def log_p(self, grams: np.ndarray, at: np.ndarray, own: bool = True) -> np.ndarray:
        """The sum of each text's log probabilities. grams, at: as from grams_of(); own: the texts are counted in the model."""
        n_texts = len(at) - 1
        if not len(grams):
            return np.zeros(n_texts)
        order = _grouped(grams)
        ordered, text = grams[order], np.repeat(np.arange(n_texts), np.diff(at))[order]
        first = _starts(ordered)
        place = np.searchsorted(self.keys, ordered[first])
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == ordered[first][known]
        place[~known] = 0
        runs = _starts(ordered, text)  # one for each 4-gram of each text
        k = np.diff(np.concatenate([runs, [len(ordered)]]))
        of = np.searchsorted(first, runs, "right") - 1
        gram, text, place, known = ordered[runs], text[runs], place[of], known[of]
        if not len(self.keys):
            p = self.shorter(gram & np.uint64((1 << 48) - 1), ORDER - 1)
            return np.bincount(text, k * np.log(p), n_texts)
        n, context = np.where(known, self.n[place], 0), self.context[place]
        lower = self.lower_p[place]
        if not known.all():
            lower = np.where(known, lower, 0.0)
            lower[~known] = self.shorter(gram[~known] & np.uint64((1 << 48) - 1), ORDER - 1)
            there = np.searchsorted(self.keys, gram & ~np.uint64(0xFFFF))  # a 4-gram of the same context, if any
            there = np.minimum(there, len(self.keys) - 1)
            seen = self.keys[there] >> np.uint64(16) == gram >> np.uint64(16)
            context = np.where(known, context, self.context[there])
        else:
            seen = np.ones(len(k), bool)
        total, spread = np.where(seen, self.total[context], 0), np.where(seen, self.spread[context], 0.0)
        if own:
            less = np.where(known, self.discount(n) - self.discount(n - np.where(known, k, 0)), 0.0)
            pair = (gram >> np.uint64(16)) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            by = _grouped(pair)
            begin = _starts(pair[by])
            width = np.diff(np.concatenate([begin, [len(by)]]))
            taken, lost = np.empty(len(by), np.int64), np.empty(len(by))
            taken[by] = np.repeat(np.add.reduceat(np.where(known, k, 0)[by], begin), width)
            lost[by] = np.repeat(np.add.reduceat(less[by], begin), width)
            n, total, spread = n - np.where(known, k, 0), total - taken, spread - lost
        p = np.where(total > 0, (np.maximum(n - self.discount(n), 0.0) + spread * lower) / np.maximum(total, 1), lower)
        return np.bincount(text, k * np.log(p), n_texts)


def _with_arrays(docs: DataFrame, model: NgramModel) -> DataFrame:
    """(doc_id, lang, shape, log_p sum, characters) with the model as sorted arrays on every executor."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        grams, at = grams_of(data, offsets)
        return {"doc_id": part.column(0), "lang": part.column(1), **text_shape(data, offsets), "log_p": sent.value.log_p(grams, at), "chars": np.diff(at)}

    return map_text(docs, f"doc_id long, lang string, {SHAPE}, log_p double, chars long", step)


def _with_join(docs: DataFrame, model: DataFrame, d: list[float]) -> DataFrame:
    """The same for a model too large to send: the documents' own n-gram counts meet it in a join."""
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "lang", "text"))

    def shape(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        at = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[offsets]
        return {"doc_id": part.column(0), "lang": part.column(1), "_row": part.column(3), **text_shape(data, offsets), "chars": np.diff(at)}

    def grams(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict[str, object]:
        found, at = grams_of(data, offsets)
        counted = [np.unique(found[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
        rows = np.repeat(part.column(3).to_numpy(), [len(k) for k, _ in counted])
        return {"_row": rows, "gram": np.concatenate([k for k, _ in counted]).view(np.int64), "k": np.concatenate([c for _, c in counted])}

    counted = map_text(keyed.dropDuplicates(["_row"]), "_row long, gram long, k long", grams)
    less = lambda n: F.when(n > 0, _discount(n, d)).otherwise(0.0)
    met = counted.join(model, "gram").withColumn("left", F.col("n") - F.col("k"))
    # the 4-grams of a text that have one context: at most as many as there are characters
    contexts = met.groupBy("_row", F.shiftrightunsigned("gram", 16).alias("context")).agg(
        (F.first("total") - F.sum("k")).alias("total"), (F.first("spread") - F.sum(less(F.col("n")) - less(F.col("left")))).alias("spread"), F.collect_list(F.struct("k", "left", "lower_p")).alias("own")
    )
    rest = F.col("x.left")
    p = F.when(F.col("total") > 0, (F.greatest(rest - less(rest), F.lit(0.0)) + F.col("spread") * F.col("x.lower_p")) / F.col("total")).otherwise(F.col("x.lower_p"))
    sums = contexts.select("_row", "total", "spread", F.explode("own").alias("x")).groupBy("_row").agg(F.sum(F.col("x.k") * F.log(p)).alias("log_p"))
    rows = map_text(keyed, f"doc_id long, lang string, _row long, {SHAPE}, chars long", shape).join(sums, "_row", "left")
    return rows.withColumn("log_p", F.coalesce("log_p", F.lit(0.0))).drop("_row")


def apply_rules(docs: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """One row per document: the shape of its text, base_failed, kept and log_perplexity (per character; null without text).

    base_failed: fewer than 50 words, or more than half of the words in three-word windows that repeat. Other documents are
    kept if their log perplexity is within the band of their language: WIDTH times half the width of the shortest interval that holds
    half of the perplexities of its documents that pass the base rules, equal ones counted once. Up to half of them may be bad on
    one side without opening it. A null language is a language of its own. Null texts are empty and fail; very long ones are counted
    and scored whole. Repeated rows give repeated results, and an empty table gives none. Other columns are ignored.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(count_grams(docs), "grams")
    model, discounts, lower = kneser_ney(counts)
    model = stored(model, "model")
    few = model.count() <= model_rows
    scored = stored(_with_arrays(docs, NgramModel.of(model, discounts, lower)) if few else _with_join(docs, model, discounts), "shape")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    # rounded, so that the order of sums bears on nothing
    perplexity = F.when(F.col("chars") > 0, F.round(-F.col("log_p") / F.col("chars"), 7))
    scored = scored.withColumns({"base_failed": failed, "log_perplexity": perplexity, "_lang": F.coalesce("lang", F.lit("\0"))})
    values = scored.filter(~failed).select("_lang", "log_perplexity", "n_words").distinct()
    steps = values.groupBy("_lang", F.round(F.col("log_perplexity") * GRID).cast("long").alias("step")).agg(F.count("*").alias("n"))
    marks = steps.groupBy("_lang").agg(F.percentile("step", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), F.col("n")).alias("m"))
    halves = [F.struct((F.col("m")[i + STEPS // 2] - F.col("m")[i]).alias("width"), F.col("m")[i].alias("start")) for i in range(STEPS // 2 + 1)]
    marks = marks.select("_lang", F.least(*halves).alias("half")).select("_lang", (F.col("half.width") / 2).alias("spread"), (F.col("half.start") + F.col("half.width") / 2).alias("middle"))
    reach = WIDTH * F.greatest("spread", LEAST_SPREAD * F.col("middle"))
    bands = marks.select("_lang", ((F.col("middle") - reach) / GRID).alias("low"), ((F.col("middle") + reach) / GRID).alias("high"))
    bands = stored(bands, "bands")
    if bands.count() <= BAND_ROWS:  # else Spark deals both sides out by language and splits large ones
        bands = F.broadcast(bands)
    within = F.col("log_perplexity").between(F.col("low"), F.col("high"))
    out = scored.join(bands, "_lang", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
