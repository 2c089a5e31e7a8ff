"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

What can be packed together depends on lengths alone, so the algorithm works on how many pieces have each length: a gene is a bin
pattern (lengths that share a sequence) with the number of bins of that pattern. Its cost thus depends on the sequence length, not
on the number of documents. Crossover injects whole well-filled bins of one parent into the other, drops the other's bins that hold
the same pieces, and best-fits what they had held. Islands evolve as Spark tasks; between epochs each gets its neighbour's best.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, give_back, key_of, ranked, slices, stored, table_rows, word_hashes, worker_state

CAPACITY = 2048
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 4, 6, 3, 5
#: A bin is well filled if at most this share of it is free.
WELL_FILLED = 1 / 256
#: Distinct words, and parts of words, whose ids a worker remembers; beyond it starts anew.
REMEMBERED, REMEMBERED_PARTS = 1_000_000, 60_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SCHEMA = f"{PIECES}, sequence_id long, offset long"

#: A solution: {pattern: bins}; a pattern has its lengths in descending order.
Solution = dict[tuple[int, ...], int]


# --- tokens ----------------------------------------------------------------------------------------------------------

#: Fixed value: the tokenizer's own pattern of the parts of a word, which are encoded each on its own.
PART = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordIds:
    """Ids of texts, word by word (a word: a run without ASCII white space).

    Words are told apart by 64-bit hashes, without regard to the case of ASCII letters, and their ids are remembered in arrays:
    sorted hashes, and where each word's ids are in a pool. Only words that are new become Python strings. Of these, words of Latin
    letters, digits and ASCII marks are normalised and cut into parts here, and each new part goes through the tokenizer's model;
    all others, and those that may hold a special token's string, go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.find = regex.compile(PART).findall
        self.plain = re.compile("[!-~\xa1-\u012f\u0131-\u024f]+").fullmatch
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {i: spell(bytes([0xC2, i]).decode())[0][0][-1] for i in range(0x80, 0xC0)}  # how the model spells bytes beyond ASCII
        self.letters |= {i: spell(bytes([i, 0x80]).decode())[0][0][0] for i in range(0xC2, 0xE0)}
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.length, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.parts: dict[str, bytes] = {}

    def one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tokenize(spelled)]
            found = self.parts[part] = pack_ids(f"<{len(ids)}I", *ids)
        return found

    def word(self, word: str) -> bytes:
        if "<|" in word or not self.plain(word):
            return self.one(word)
        return b"".join(map(self.part, self.find((word if word.isascii() else unicodedata.normalize("NFC", word)).lower())))

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Adds words by their hashes, which are new and sorted."""
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts = {}
        ids = [self.word(w.decode("utf-8", "replace")) for w in words]
        length = np.array([len(x) // 4 for x in ids], np.int64)
        first = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        at = np.searchsorted(self.keys, keys)  # keys are sorted
        self.keys, self.first, self.length = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.length, at, length)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of each text in the bytes."""
        raw = data.tobytes()
        # the strings of special tokens have a case
        hashes, starts, ends, at = word_hashes(data, offsets, lower=b"<|" not in raw)
        if not len(hashes):
            return [self.pool[:0]] * (len(offsets) - 1)
        if len(self.keys) > REMEMBERED:
            self.forget()
        known, index, of = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, known)
        new = place == len(self.keys)
        new[~new] = self.keys[place[~new]] != known[~new]
        if new.any():
            self.learn(known[new], [raw[a:b] for a, b in zip(starts[index[new]].tolist(), ends[index[new]].tolist(), strict=True)])
            place = np.searchsorted(self.keys, known)
        length = self.length[place][of]
        last = np.cumsum(length)
        ids = self.pool[np.repeat(self.first[place][of] - (last - length), length) + np.arange(last[-1])]
        cuts = np.concatenate([[0], last])[at]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def tokenised(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """PIECES: each document's ids and a closing 0, cut into pieces of `capacity`.

    The tokenizer drops white space and no token of it reaches over any, so a text's ids are those of its words; workers
    remember the ids of words.
    """
    kind = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state = worker_state()
        if state.get("tokenizer_path") != tokenizer_path:
            state["tokenizer"], state["tokenizer_path"] = WordIds(tokenizer_path), tokenizer_path
            give_back()  # reading the file takes much more than what is kept
        for part, data, offsets in slices(batches):
            rows = []
            for i, ids in zip(part.column(0).to_pylist(), state["tokenizer"].of(data, offsets), strict=True):
                raw = ids.tobytes() + b"\0\0\0\0"
                rows += [(i, k, k * capacity, len(cut) // 4, zlib.crc32(cut)) for k in range(-(-len(raw) // (4 * capacity))) if (cut := raw[4 * capacity * k : 4 * capacity * (k + 1)])]
            yield table_rows(dict(zip(kind.names, zip(*rows, strict=True), strict=True)), kind)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


# --- the genetic algorithm over a histogram ----------------------------------------------------------------------------


def _fill(left: dict[int, int], lengths: list[int], space: int, r: np.random.Generator, wander: float) -> tuple[int, ...]:
    """A bin's lengths, mostly the largest that fits; `wander` is how often a smaller one is tried. lengths: ascending."""
    bin_, used = [], Counter()
    top = len(lengths)
    while space:
        top = bisect.bisect_right(lengths, space, 0, top)
        at = top - 1
        if bin_ and at > 0 and r.random() < wander:
            at = int(r.integers(max(0, at - 32), at + 1))
        while at >= 0 and used[lengths[at]] >= left[lengths[at]]:
            at -= 1
        if at < 0:
            break
        bin_.append(lengths[at])
        used[lengths[at]] += 1
        space -= lengths[at]
    return tuple(sorted(bin_, reverse=True))


def pack_new(left: dict[int, int], capacity: int, r: np.random.Generator, wander: float, tries: int = 4) -> Solution:
    """New bins for all pieces in `left`, largest first; of several tries the fullest bin is used as often as pieces last."""
    left = {k: n for k, n in left.items() if n}
    lengths, out = sorted(left), Counter()
    while lengths:
        best: tuple[int, ...] = ()
        first = lengths[-1]
        left[first] -= 1
        for t in range(tries):
            rest = tuple(sorted((first, *_fill(left, lengths, capacity - first, r, wander if t else 0.0)), reverse=True))
            if sum(rest) > sum(best):
                best = rest
            if sum(best) == capacity:
                break
        left[first] += 1
        need = Counter(best)
        times = min(left[k] // n for k, n in need.items())
        out[best] += times
        for k, n in need.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
                lengths.pop(bisect.bisect_left(lengths, k))
    return dict(out)


def best_fit(bins: Solution, left: dict[int, int], capacity: int) -> tuple[Solution, dict[int, int]]:
    """Puts pieces, longest first, into the open bins that they fill best: (bins, pieces that found no room)."""
    out = Counter(bins)
    room: dict[int, list[tuple[int, ...]]] = {}
    for pattern in out:
        room.setdefault(capacity - sum(pattern), []).append(pattern)
    spaces = sorted(s for s in room if s)
    rest = {}
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            at = bisect.bisect_left(spaces, k)
            if at == len(spaces):
                break
            space = spaces[at]
            pattern = room[space].pop()
            if not room[space]:
                spaces.pop(at)
            t = min(out[pattern], n)
            if not t:
                continue
            out[pattern] -= t
            if out[pattern]:
                if not room[space]:
                    bisect.insort(spaces, space)
                room[space].append(pattern)
            else:
                del out[pattern]
            new = tuple(sorted((*pattern, k), reverse=True))
            seen = new in out
            out[new] += t
            n -= t
            if space - k and not seen:
                if not room.get(space - k):
                    bisect.insort(spaces, space - k)
                room.setdefault(space - k, []).append(new)
        if n:
            rest[k] = n
    return dict(out), rest


def taken(bins: Solution) -> Counter:
    out: Counter = Counter()
    for pattern, times in bins.items():
        for k in pattern:
            out[k] += times
    return out


def crossover(a: Solution, b: Solution, pieces: dict[int, int], capacity: int, r: np.random.Generator) -> Solution:
    """Whole well-filled bins of b go into a; a's bins that hold the same pieces go; what else they held is packed again."""
    full = [p for p in b if capacity - sum(p) <= WELL_FILLED * capacity]
    share = r.uniform(0.3, 0.9)
    child = Counter({p: b[p] for p in full if r.random() < share})
    left = Counter(pieces)
    left.subtract(taken(child))
    for p in sorted(a, key=lambda p: (-sum(p), p)):
        if capacity - sum(p) > WELL_FILLED * capacity and r.random() < 0.5:
            continue  # mutation: some badly filled bins are opened as well
        need = Counter(p)
        times = min(a[p], min(left[k] // n for k, n in need.items()))
        if times:
            child[p] += times
            for k, n in need.items():
                left[k] -= times * n
    kept, rest = best_fit(child, {k: n for k, n in left.items() if n}, capacity)
    for p, times in pack_new(rest, capacity, r, 0.3).items():
        kept[p] = kept.get(p, 0) + times
    return kept


def fitness(bins: Solution, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the larger the better)."""
    return -sum(bins.values()), sum(n * (sum(p) / capacity) ** 2 for p, n in bins.items())


def evolve(population: list[Solution], pieces: dict[int, int], capacity: int, generations: int, seed: int) -> list[Solution]:
    """One epoch of an island, best first: children of two tournaments take the place of the worst. It ends early at the lower bound."""
    r = np.random.default_rng(seed)
    least = -(-sum(k * n for k, n in pieces.items()) // capacity)
    population = list(population)
    while len(population) < POPULATION:
        population.append(pack_new(dict(pieces), capacity, r, 0.1 * len(population)))
    rank = lambda: population.sort(key=lambda s: fitness(s, capacity), reverse=True)
    rank()
    for _ in range(generations):
        if -fitness(population[0], capacity)[0] == least:
            break
        for _ in range(POPULATION // 2):
            a, b = (population[min(r.integers(len(population), size=2))] for _ in range(2))
            population.append(crossover(a, b, pieces, capacity, r))
        rank()
        del population[POPULATION:]
    return population


def _packed(s: Solution) -> bytes:
    """A solution as bytes: bins, number of lengths, lengths of each pattern."""
    patterns = sorted(s)
    return np.array([x for p in patterns for x in (s[p], len(p), *p)], np.int64).tobytes()


def _unpacked(data: bytes) -> Solution:
    x, out, at = np.frombuffer(data, np.int64).tolist(), {}, 0
    while at < len(x):
        out[tuple(x[at + 2 : at + 2 + x[at + 1]])] = x[at]
        at += 2 + x[at + 1]
    return out


def solve(spark: SparkSession, pieces: dict[int, int], capacity: int = CAPACITY) -> Solution:
    """Bins for a histogram {length: pieces}, of islands that evolve as Spark tasks.

    The driver holds the islands' populations: ISLANDS * POPULATION solutions of at most some thousand patterns each.
    """
    if not pieces:
        return {}
    least = -(-sum(k * n for k, n in pieces.items()) // capacity)
    population: list[tuple[int, bytes]] = []
    best: Solution = {}
    schema = "island int, place int, solution binary"
    kind = arrow_schema(schema)
    for epoch in range(EPOCHS):
        rows = [(i, [data for j, data in population if j == i]) for i in range(ISLANDS)]
        frame = spark.createDataFrame(rows, "island int, population array<binary>").repartitionByRange(ISLANDS, "island")

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found = evolve([_unpacked(x) for x in row["population"]], pieces, capacity, GENERATIONS, 1000 * epoch + row["island"])
                    yield table_rows({"island": [row["island"]] * len(found), "place": list(range(len(found))), "solution": [_packed(s) for s in found]}, kind)

        found = frame.mapInArrow(run, schema).toArrow().to_pylist()
        found.sort(key=lambda x: (x["island"], x["place"]))
        best = max((_unpacked(x["solution"]) for x in found if x["place"] == 0), key=lambda s: fitness(s, capacity))
        if sum(best.values()) == least:
            break
        population = [(x["island"], x["solution"]) for x in found if x["place"] < POPULATION - 1]
        population += [((x["island"] + 1) % ISLANDS, x["solution"]) for x in found if x["place"] == 0]
    return best


# --- places of pieces --------------------------------------------------------------------------------------------------


def places(bins: Solution, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: pieces `first` and on of a length have `each` places in every bin from `sequence` on, from `offset`."""
    rows, sequence = [], 0
    for pattern in sorted(bins):
        at = 0
        for k, n in sorted(Counter(pattern).items(), reverse=True):
            rows.append((k, n, bins[pattern], sequence, at))
            at += n * k
        sequence += bins[pattern]
    x = np.array(sorted(rows), np.int64).reshape(-1, 5)
    count = x[:, 1] * x[:, 2]
    before = np.cumsum(count) - count
    start = np.searchsorted(x[:, 0], x[:, 0], "left")
    first = before - before[start] if len(x) else before
    return {"key": (x[:, 0] << 48) + first, "first": first, "each": x[:, 1], "sequence": x[:, 3], "offset": x[:, 4]}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its closing 0 alone; a very long one is as many pieces as it needs. Rows with the same id, and equal rows,
    are packed each on its own. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = stored(tokenised(docs, tokenizer_path, capacity), "pieces")
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows = sum(histogram.values())
    sent = spark.sparkContext.broadcast(places(solve(spark, histogram, capacity), capacity))
    kind = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(p["key"], (length << 48) + rank, "right") - 1
            place = rank - p["first"][at]
            columns = {name: batch.column(i) for i, name in enumerate(kind.names[:5])}
            yield table_rows(columns | {"sequence_id": p["sequence"][at] + place // p["each"][at], "offset": p["offset"][at] + place % p["each"][at] * length}, kind)

    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    placed = ranked(pieces, ["length"], key_of("doc_id", "piece", "ids_crc32"), order, rows, "_rank")
    return placed.select(*kind.names[:5], "_rank").mapInArrow(run, SCHEMA)
