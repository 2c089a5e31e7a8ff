"""Substring dedup by collinear chaining: finds passages that a document shares with an earlier one, word by word or nearly so.

1. Seeds: every run of 4 words, and of every 8 consecutive runs of 43 words the one with the smallest hash, packed into buckets by hash, about 9 bytes each on the way.
2. Each seed is matched with its first occurrence (the smallest doc_id, then place), so a passage in any number of documents makes
   matches in proportion to its occurrences, never pairs of them. Steps 3 and 4 follow; then, where a document has no passage yet, they
   are done again with the other occurrences (see rest_matches).
   On their way matches are packed, too (see PACKED): Spark deals out a few rows of bytes, and numpy sorts the numbers in a bucket.
3. Matches of two documents on one diagonal become segments; a Fenwick tree chains segments in both texts' order, with gap costs.
4. Chains are aligned: the words of both texts between segments by edit distance, and around the ends as far as they agree. Passages
   are the longest parts of an alignment of which enough words agree.
"""

from __future__ import annotations

import bisect
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, drop_table, free_name, give_back, mix64, slices, stored, table_rows, windows, word_hashes

SEED_WORDS = 4
#: Long seeds find the document that has a whole passage where short ones are first in documents with a part of it. Equal runs of
#: 50 words share one.
LONG_WORDS, LONG_EVERY = 43, 8
#: Bytes of text whose seeds make a bucket, seeds that a task packs at a time, and tasks at most.
BUCKET_BYTES, HELD_SEEDS, BUCKET_TASKS = 6 << 20, 500_000, 4096
#: Bytes of text beyond which seeds are dealt out in two passes, by half of the hashes each: half of them is on its way at a time.
PASS_BYTES = 1 << 30
#: Bytes of text whose seeds are made at a time.
SEED_BYTES = 1 << 18
#: A passage: so many words at least, of which so many agree with the earlier document's.
LEAST_WORDS, LEAST_SHARE = 50, 0.75
#: A chain pays so much for each word of a gap in either text: two lone seeds may be 50 words apart.
GAP_COST = 0.04
#: Words around a chain's ends that are aligned.
MARGIN = 64
#: Chains whose ends are aligned at a time, and cells of an alignment that are held at most; a larger gap is cut in two.
ALIGNED_CHAINS, GAP_CELLS = 256, 4_000_000
BROADCAST_IDS = 1_000_000
#: Occurrences of a seed, or of seeds in line, that are matched each with each.
FEW = 32
#: Words of the runs that more frequent seeds are joined to, and how far from its start the second half may start (0: at its end).
LINKS = ((8, 0), (16, 0), (32, 0), (LEAST_WORDS, LEAST_WORDS - 32))
#: Chains that share a copy of a text on its way.
TEXT_CHAINS = 64

SCHEMA = "doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, matched_words long, share double"


# --- seeds -------------------------------------------------------------------------------------------------------------


def long_places(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of the long seeds, from the hashes of runs of LONG_WORDS words. doc: the text of each word."""
    n = len(hashes) - LONG_EVERY + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = functools.reduce(np.minimum, (hashes[k : k + n] for k in range(LONG_EVERY)))
    chosen, left = np.zeros(len(hashes), bool), doc[:n] == doc[LONG_WORDS + LONG_EVERY - 2 :][:n]
    for k in range(LONG_EVERY):
        found = left & (hashes[k : k + n] == best)
        chosen[k : k + n] |= found
        left &= ~found
    return np.flatnonzero(chosen)


def planes(x: np.ndarray, width: int) -> list[np.ndarray]:
    """The lowest bytes of the numbers, the next ones, and so on."""
    return [(x >> np.uint64(8 * k)).astype(np.uint8) for k in range(width)]


def unpacked(raw: bytes, width: int, size: int = -1, at: int = 0) -> np.ndarray:
    """The numbers whose planes begin at a place of raw, one behind the other."""
    size = len(raw) // width if size < 0 else size
    out = np.zeros((size, 8), np.uint8)
    if size and width:
        out[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
    return out.view("<u8").ravel()


def seeds_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds, doc_ids and places of a row of seeds()."""
    n = len(row["seeds"]) // 5
    docs, places = (unpacked(row[name], len(row[name]) // n, n).view(np.int64) for name in ("docs", "places"))
    docs = (docs >> 1 & np.int64((1 << 63) - 1)) ^ -(docs & 1)
    return unpacked(row["seeds"], 5), np.cumsum(docs) + row["base"], places


def told_apart(rolled: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, those of a stretch that repeats itself with their place in the stretch.

    A stretch is a series of runs each of which the same text has less than LONG_WORDS words before ("the the the ..."). Without
    their places each of its runs would match the same first one, and make a chain of its own. text: the text of each word."""
    n = len(rolled)
    own = rolled + text[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    again = np.zeros(n, bool)
    for back in range(1, min(LONG_WORDS, n)):
        again[back:] |= own[back:] == own[:-back]
    place = np.arange(n)
    inside = again & np.concatenate([[False], again[:-1]]) if n else again
    place -= np.maximum.accumulate(np.where(inside, 0, place)) if n else 0
    out = rolled.copy()
    out[inside] = mix64(rolled[inside] + place[inside].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    return out


def seeds(docs: DataFrame, bits: int, half: int | None = None) -> DataFrame:
    """(bucket, seeds, places, docs) of every text: packed seeds, 2 ** bits buckets by their top bits. A doc_id is base plus the sum of docs' numbers so far (of which the lowest bit is the sign).
    half: only the seeds whose first bit it is.

    places: twice the place, and 1 for a long seed. seeds: 5 bytes of hash below the bucket's bits. Numbers are stored byte by byte (all lowest bytes first), so that they compress;
    places and docs with as many bytes as the largest of the row needs: few buckets or many, a row costs little beside its seeds.
    """
    schema = "bucket int, base long, seeds binary, places binary, docs binary"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            seed, ids, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            bucket = (seed >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int32)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order].astype(np.int32), prepend=-1))
            ids = ids[order]
            base, ids = ids[cut], np.diff(ids, prepend=0)
            ids[cut] = 0
            ids = (ids << 1) ^ (ids >> 63)  # long seeds come behind a slice's short ones, so some are below 0
            rows = {"bucket": bucket[order[cut]].astype(np.int32), "base": base}
            columns = [("docs", ids, 8), ("places", pos[order], 4), ("seeds", seed[order] << np.uint64(bits) >> np.uint64(24), 5)]
            del seed, ids, pos, bucket, order
            bounds = list(zip(cut.tolist(), [*cut[1:].tolist(), len(columns[0][1])], strict=True))
            while columns:  # from the last, each forgotten when it is packed
                name, x, width = columns.pop()
                x = x.view(np.uint64)
                widths = [width] * len(bounds) if name == "seeds" else [(h.bit_length() + 7) // 8 for h in np.maximum.reduceat(x, cut).tolist()]
                of = planes(x, max(widths))
                rows[name] = [b"".join([y[a:b].tobytes() for y in of[:w]]) for (a, b), w in zip(bounds, widths, strict=True)]
            return table_rows(rows, kind)

        n = 0
        for part, data, offsets in slices(batches, size=SEED_BYTES):
            hashes, _, _, at = word_hashes(data, offsets)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
            rolled = told_apart(windows(hashes, SEED_WORDS), doc)
            where = np.flatnonzero(doc[: len(rolled)] == doc[len(doc) - len(rolled) :])
            if not len(where):
                continue
            ids = part.column(0).to_numpy(zero_copy_only=False)
            here = lambda x: np.ones(len(x), bool) if half is None else x >> np.uint64(63) == half
            where = where[here(rolled[where])]
            held.append((rolled[where], ids[doc[where]], 2 * (where - at[doc[where]])))
            rolled = told_apart(windows(hashes, LONG_WORDS), doc)
            longer = long_places(rolled, doc)
            longer = longer[here(rolled[longer])]
            held.append((rolled[longer], ids[doc[longer]], 2 * (longer - at[doc[longer]]) + 1))
            n += len(where) + len(longer)
            if n > HELD_SEEDS:
                yield packed()
                n = 0
        if held:
            yield packed()

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, schema)


# --- packed rows -------------------------------------------------------------------------------------------------------

#: Rows of numbers on their way, packed by bucket: Spark moves and sorts few of these rows, numpy sorts what is in them.
PACKED = "kind int, bucket int, data binary"
PACKED_KIND = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
#: Kinds: matches that aren't chained yet, those that are (doc_id, source, pos, source_pos, words); runs of words that occur more than
#: twice (a hash, doc_id, the first and the last seed's places, 1 if the document's passages are still open there); passages (doc_id, start, end).
NEW, KNOWN, RUNS, SPANS = range(4)
#: Bytes of text whose matches make a bucket (less until there are 64, so that small tables keep all cores busy), and rows that are
#: packed, or worked on, at a time. Each task makes a row for each bucket, so there are no more buckets than memory asks for.
ROWS_BYTES, FEW_BYTES, HELD_ROWS, STEP_ROWS = 12 << 20, 3 << 20, 500_000, 50_000


def dense(x: np.ndarray) -> np.ndarray:
    """Equal numbers as one small number, in their order."""
    order = np.argsort(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], x[order[1:]] != x[order[:-1]]]))
    return out


def order_of(*keys: np.ndarray) -> np.ndarray:
    """The rows' order by the first key, then the next: one sort of all keys together where they fit in 63 bits. Ties in any order."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    whole, width = np.zeros(len(keys[0]), np.int64), 0
    for key in keys:
        low, high = int(key.min()), int(key.max())
        if high - low >= 1 << 40:
            key = dense(key)
            low, high = 0, int(key.max())
        bits = (high - low).bit_length()
        if width + bits > 63:
            whole = dense(whole)
            width = int(whole.max()).bit_length()
        if width + bits > 63:
            return np.lexsort(keys[::-1])
        whole, width = (whole << bits) | (key - low), width + bits
    return np.argsort(whole)


def cuts(key: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Parts of about `size` rows, cut where the sorted key changes."""
    if not len(key):
        return []
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    at = np.minimum(np.searchsorted(first, np.arange(size, len(key), size)), len(first) - 1)
    bounds = np.unique(np.concatenate([[0], first[at], [len(key)]])).tolist()
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def packed(kind: int, buckets: int, key: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of PACKED: the columns' rows by buckets of their key. Each column is stored as differences from its smallest number, byte by
    byte (all lowest bytes first), with as many bytes as the largest needs."""
    bucket = mix64(key.view(np.uint64)) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([cut, [len(bucket)]]))
    lows, widths, sorted_ = [], [], []
    for x in columns:
        x = x.astype(np.int64, copy=False)[order]
        low = np.minimum.reduceat(x, cut) if len(cut) else cut
        x = x.view(np.uint64) - np.repeat(low, sizes).view(np.uint64)
        high = np.maximum.reduceat(x, cut) if len(cut) else x
        lows.append(low.tolist())
        widths.append([(h.bit_length() + 7) // 8 for h in high.tolist()])
        sorted_.append(planes(x, max(widths[-1], default=0)))
    n, data = len(columns), []
    for k, (a, size) in enumerate(zip(cut.tolist(), sizes.tolist(), strict=True)):
        parts = [struct.pack(f"<q{n}q{n}B", size, *(x[k] for x in lows), *(x[k] for x in widths))]
        parts += [x[a : a + size].tobytes() for of, w in zip(sorted_, widths, strict=True) for x in of[: w[k]]]
        data.append(b"".join(parts))
    return table_rows({"kind": np.full(len(cut), kind, np.int32), "bucket": bucket[cut].astype(np.int32), "data": data}, PACKED_KIND)


def columns_of(kind: int, data: bytes) -> list[np.ndarray]:
    n = 3 if kind == SPANS else 5
    head = f"<q{n}q{n}B"
    size, *rest = struct.unpack_from(head, data)
    at, out = struct.calcsize(head), []
    for low, width in zip(rest[:n], rest[n:], strict=True):
        out.append(unpacked(data, width, size, at).view(np.int64) + np.int64(low))
        at += size * width
    return out


class Packer:
    """Packs rows of one kind when enough of them came."""

    def __init__(self, kind: int, buckets: int, by: int):
        self.kind, self.buckets, self.by, self.held, self.n = kind, buckets, by, [], 0

    def add(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.held.append(columns)
            self.n += len(columns[0])
        if self.n > HELD_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            columns = [np.concatenate(x) for x in zip(*self.held, strict=True)]
            self.held, self.n = [], 0
            for a in range(0, len(columns[0]), 2 * HELD_ROWS):
                yield packed(self.kind, self.buckets, columns[self.by][a : a + 2 * HELD_ROWS], [x[a : a + 2 * HELD_ROWS] for x in columns])


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of PACKED, those of a bucket together."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind")


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[np.ndarray]]]:
    """The columns of each kind, bucket by bucket."""
    held: dict[int, list[list[np.ndarray]]] = {}
    at = -1

    def whole() -> dict[int, list[np.ndarray]]:
        out = {kind: [np.concatenate(x) for x in zip(*parts, strict=True)] for kind, parts in held.items()}
        held.clear()
        return out

    for batch in batches:
        for kind, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and bucket != at:
                yield whole()
                give_back()
            at = bucket
            held.setdefault(kind, []).append(columns_of(kind, data.as_buffer()))
    if held:
        yield whole()
    give_back()


# --- matches -----------------------------------------------------------------------------------------------------------


def matches_of(seed: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """doc_id, source, pos, source_pos and words of a bucket's seeds that an earlier document has, with their first occurrence; seed,
    doc_id and pos of the short ones that occur more than twice, so that first occurrences aren't all (see rest_matches)."""
    if len(seed) < 1 << 24:  # seeds have 40 bits
        order = np.sort(seed << np.uint64(24) | np.arange(len(seed), dtype=np.uint64))
        seed, order = order >> np.uint64(24), (order & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        order = np.argsort(seed)
        seed = seed[order]
    same = seed[1:] == seed[:-1]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])  # seeds that occur again
    seed, order = seed[again], order[again]
    ids, pos = ids[order], pos[order]
    order = order_of(np.cumsum(np.concatenate([[False], seed[1:] != seed[:-1]])[: len(seed)]), ids, pos)
    seed, ids, pos = seed[order], ids[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(seed) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([first, [len(seed)]]))
    more = np.repeat(sizes > 2, sizes) & (pos & 1 == 0)
    first = np.repeat(first, sizes)
    later = ids[first] < ids
    first = first[later]
    found = [ids[later], ids[first], pos[later] >> 1, pos[first] >> 1, np.where(pos[later] & 1, LONG_WORDS, SEED_WORDS)]
    return found, [seed[more], ids[more], pos[more] >> 1]


def matches(docs: DataFrame) -> DataFrame:
    """Rows of PACKED by doc_id: seeds that an earlier document has, with their first occurrence (NEW), and all that occur more than twice (RUNS).
    `.tidemark_buckets` of the result is the number of buckets, `.tidemark_paths` the folders."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, size / BUCKET_BYTES))), 4, 20))
    buckets = int(max(16, min(64, size // FEW_BYTES), size // ROWS_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(NEW, buckets, 0), Packer(RUNS, buckets, 1)

        def found(held: list[tuple], bucket: int) -> Iterator[pa.RecordBatch]:
            arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            columns, (seed, ids, pos) = matches_of(*arrays)
            arrays.clear()
            give_back()
            yield from out[0].add(columns)
            key = (seed + (np.uint64(bucket) << np.uint64(40))).view(np.int64)
            yield from out[1].add([key, ids, pos, pos, np.ones(len(pos), np.int64)])

        held, bucket = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["bucket"] != bucket:
                    yield from found(held, bucket)
                bucket = r["bucket"]
                held.append(seeds_of(r))
        if held:
            yield from found(held, bucket)
        for x in out:
            yield from x.rest()
        give_back()

    tables = []
    for half in (None,) if size <= PASS_BYTES else (0, 1):
        by_hash = seeds(docs, bits, half).repartition(min(1 << bits if half is None else 1 << bits - 1, BUCKET_TASKS), "bucket").sortWithinPartitions("bucket")
        tables.append(stored(by_hash.mapInArrow(run, PACKED), "matches"))
    out = functools.reduce(DataFrame.unionByName, tables)
    out.tidemark_buckets, out.tidemark_paths = buckets, [t.tidemark_path for t in tables]
    return out


# --- occurrences behind the first one ----------------------------------------------------------------------------------


def pairs_of(run: np.ndarray, ids: np.ndarray, opened: np.ndarray, few: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (later, earlier) of places of one run in two documents, the later one open; places of the runs that occur more than `few`
    times and are open anywhere. The arrays are sorted by run and document. skip: runs whose pairs with the first one are known."""
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(run)]]))
    nth = np.arange(len(run)) - np.repeat(first, sizes)
    many = np.repeat(sizes > few, sizes)
    opened = opened > 0
    pairs = [(at := np.flatnonzero(many & opened), np.repeat(first, sizes)[at])]
    for back in range(1, min(few, int(sizes.max()))):
        at = np.flatnonzero(~many & opened & (nth >= back))
        pairs.append((at, at - back))
    later, earlier = (np.concatenate(x) for x in zip(*pairs, strict=True))
    apart = (ids[later] != ids[earlier]) & ~(skip[later] & (earlier == np.repeat(first, sizes)[later]))
    return later[apart], earlier[apart], np.flatnonzero(many & np.repeat(np.logical_or.reduceat(opened, first), sizes))


def linked(ids: np.ndarray, run: np.ndarray, pos: np.ndarray, last: np.ndarray, opened: np.ndarray, words: int, ahead: int) -> list[np.ndarray]:
    """Each run joined with the next one of its document that starts not before its end or, with ahead, so many words behind its start. The arrays are sorted by document and places.

    Seeds are also joined over others: the last one of each series of frequent seeds with the first one of each later series. All of
    them start at most LEAST_WORDS behind the end of what they are joined with. Rare words between them don't matter."""
    of = np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])]) << 40
    place, end = of + pos, of + last + SEED_WORDS
    other = np.searchsorted(place, place + ahead if ahead else end)
    one = np.arange(len(pos))
    if words == 2 * SEED_WORDS:
        broken = place[1:] > place[:-1] + 1
        begins, stops = np.flatnonzero(np.concatenate([[True], broken])), np.flatnonzero(np.concatenate([broken, [True]]))
        low, high = np.searchsorted(place[begins], end[stops]), np.searchsorted(place[begins], end[stops] + LEAST_WORDS, "right")
        counts = high - low
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        over = np.repeat(stops, counts), begins[np.repeat(low, counts) + nth]
        new = over[1] != other[over[0]]
        one, other = np.concatenate([one, over[0][new]]), np.concatenate([other, over[1][new]])
    good = other < len(pos)
    good[good] = place[other[good]] <= end[one[good]] + LEAST_WORDS  # nor in another document
    one, other = one[good], other[good]
    both = mix64(run[one].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix64(run[other].view(np.uint64)) + np.uint64(words))
    return [both.view(np.int64), ids[one], pos[one], last[other], opened[one] | opened[other]]


def link(runs: DataFrame, buckets: int, words: int, ahead: int) -> DataFrame:
    """RUNS by run: those of `runs`, which are by doc_id, joined (see linked)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(RUNS, buckets, 0)
        for kinds in buckets_of(batches):
            run, ids, pos, last, opened = kinds[RUNS]
            order = order_of(ids, pos, last)
            for a, b in cuts(ids[order], STEP_ROWS):
                yield from out.add(linked(*(x[order[a:b]] for x in (ids, run, pos, last, opened)), words, ahead))
        yield from out.rest()

    return dealt(runs).mapInArrow(step, PACKED)


def run_matches(runs: DataFrame, buckets: int, few: int) -> DataFrame:
    """Matches (NEW, by doc_id) of the first and last seed of open runs that an earlier document has; of runs with more than `few` places
    only with the first one, and these runs (RUNS, by doc_id). runs: RUNS by run."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(NEW, buckets, 0), Packer(RUNS, buckets, 1)
        for kinds in buckets_of(batches):
            order = order_of(*kinds[RUNS][:3])
            run = kinds[RUNS][0][order]
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            sizes = np.diff(np.concatenate([first, [len(run)]]))
            order = order[np.repeat((sizes > 1) & (np.maximum.reduceat(kinds[RUNS][4][order], first) > 0), sizes)]
            for a, b in cuts(kinds[RUNS][0][order], STEP_ROWS):
                x = [c[order[a:b]] for c in kinds[RUNS]]
                run, ids, pos, last, opened = x
                later, earlier, many = pairs_of(run, ids, opened, few, last == pos)
                two = last[later] != pos[later]
                ends = [np.concatenate([pos[i], last[i[two]]]) for i in (later, earlier)]
                later, earlier = (np.concatenate([i, i[two]]) for i in (later, earlier))
                yield from out[0].add([ids[later], ids[earlier], *ends, np.full(len(later), SEED_WORDS)])
                yield from out[1].add([c[many] for c in x])
        for x in out:
            yield from x.rest()

    return dealt(runs).mapInArrow(step, PACKED)


def closed(ids: np.ndarray, pos: np.ndarray, spans: list[np.ndarray] | None) -> np.ndarray:
    """Whether any LEAST_WORDS words with the place are all in passages. spans: (doc_id, start, end) of these."""
    if spans is None or not len(ids):
        return np.zeros(len(ids), bool)
    docs, start, end = (x[order_of(*spans)] for x in spans)
    end = np.minimum(end, 1 << 39)
    known = docs[np.concatenate([[True], docs[1:] != docs[:-1]])]
    of = np.searchsorted(known, docs) << 40
    reach = np.maximum.accumulate(of + end)
    new = np.concatenate([[True], (of + start)[1:] > reach[:-1]])  # overlapping ones count as one
    starts = (of + start)[new]
    ends = reach[np.concatenate([np.flatnonzero(new)[1:], [len(new)]]) - 1]
    doc = np.searchsorted(known, ids)
    has = known[np.minimum(doc, len(known) - 1)] == ids
    at = np.searchsorted(starts, (doc << 40) + np.maximum(pos - (LEAST_WORDS - SEED_WORDS), 0), "right") - 1
    return has & (at >= 0) & (ends[np.maximum(at, 0)] >= (doc << 40) + pos + LEAST_WORDS)


def still_open(found: DataFrame, passages: DataFrame, buckets: int) -> DataFrame:
    """Of the matches those where passages don't cover a document yet (KNOWN, by doc_id); all runs (RUNS, by run), with whether they are."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, start, end, at_end = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield packed(SPANS, buckets, ids, [ids, start, np.where(at_end, 1 << 62, end)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(KNOWN, buckets, 0), Packer(RUNS, buckets, 0)
        for kinds in buckets_of(batches):
            if NEW in kinds:
                x = kinds.pop(NEW)
                is_open = ~closed(x[0], x[2], kinds.get(SPANS))
                yield from out[0].add([c[is_open] for c in x])
            if RUNS in kinds:
                run, ids, pos, last, _ = kinds.pop(RUNS)
                yield from out[1].add([run, ids, pos, last, (~closed(ids, pos, kinds.get(SPANS))).astype(np.int64)])
        for x in out:
            yield from x.rest()

    spans_ = passages.select("doc_id", "start_word", "end_word", "at_end").mapInArrow(spans, PACKED)
    return dealt(found.unionByName(spans_)).mapInArrow(step, PACKED)


def rest_matches(found: DataFrame, passages: DataFrame, few: int) -> list[DataFrame]:
    """Tables with matches, in place of found: where passages don't cover a document yet, the known ones, and its seeds with other earlier occurrences than the first.

    A place is open if any LEAST_WORDS words with it aren't all in passages. A seed that at most `few` places have is matched with all
    earlier ones. One that more have is joined with the next such seeds of its text to runs of 8 words, that again are matched with all
    or, if more than `few` places have them, joined to 16, 32 and 50 words. What has those is a passage, so the first one is enough."""
    buckets = found.tidemark_buckets
    tables = [stored(still_open(found, passages, buckets), "open")]
    for path in found.tidemark_paths:
        drop_table(found.sparkSession, path)
    tables.append(stored(run_matches(tables[0].filter(F.col("kind") == RUNS), buckets, few), "rest"))
    for words, ahead in LINKS:
        runs = tables[-1].filter(F.col("kind") == RUNS)
        if runs.isEmpty():
            break
        tables.append(stored(run_matches(link(runs, buckets, words, ahead), buckets, few), "rest"))
    return tables


# --- chains ------------------------------------------------------------------------------------------------------------


def segments(pair: np.ndarray, pos: np.ndarray, source: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (start, end, source_start, matched words) of matches on one diagonal that touch each other (all their words agree), and
    the document pair of each. The arrays are sorted by pair, diagonal and place."""
    end, off = pos + words, pos - source
    other = np.concatenate([[True], (pair[1:] != pair[:-1]) | (off[1:] != off[:-1])])
    room = (np.cumsum(other) - 1) << 32  # so that one running maximum serves all diagonals
    reach = np.maximum.accumulate(end + room) - room
    new = other | np.concatenate([[True], pos[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(pos)]]) - 1
    return np.stack([pos[first], reach[last], source[first], reach[last] - pos[first]], 1), pair[first]


class Fenwick:
    """Prefix maxima: the largest (value, item) at places up to one."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, place: int, value: float, item: int) -> None:
        place += 1
        while place < len(self.best):
            if self.best[place][0] < value:
                self.best[place] = (value, item)
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        out = (-np.inf, -1)
        place += 1
        while place:
            out = max(out, self.best[place])
            place -= place & -place
        return out


def best_chains(parts: np.ndarray) -> Iterator[list[int]]:
    """Chains of segments by falling score, each segment in one chain at most.

    A segment follows one that ends before it in both texts. With s the sum of a gap's words in both texts, it costs GAP_COST * s,
    which is a sum of terms of its two sides, so the best predecessor is a prefix maximum over the source's places. All scores come
    from one pass; then chains are followed back from the best end that is left, up to a segment that another chain has.
    """
    if len(parts) == 1:
        yield [0]
        return
    starts, stops, sources, weights = (parts[:, i].tolist() for i in range(4))
    ends = (parts[:, 2] + parts[:, 1] - parts[:, 0]).tolist()
    places = sorted(set(ends))
    by_end = np.argsort(parts[:, 1], kind="stable").tolist()
    tree, score, before = Fenwick(len(places)), [0.0] * len(parts), [-1] * len(parts)
    waiting = 0
    for i in np.argsort(parts[:, 0], kind="stable").tolist():
        while waiting < len(by_end) and stops[by_end[waiting]] <= starts[i]:  # these end before: they may come first
            j = by_end[waiting]
            tree.put(bisect.bisect_left(places, ends[j]), score[j] + GAP_COST * (stops[j] + ends[j]), j)
            waiting += 1
        value, j = tree.upto(bisect.bisect_right(places, sources[i]) - 1)
        gain = value - GAP_COST * (starts[i] + sources[i])
        score[i], before[i] = weights[i] + max(0.0, gain), j if gain > 0 else -1
    used = [False] * len(parts)
    for i in sorted(range(len(parts)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            yield chain[::-1]


def chains_of(parts: np.ndarray, lone: np.ndarray, fresh: bool) -> Iterator[np.ndarray]:
    """Segments of each chain that may become a passage: of two seeds, if fresh, or one that may belong to a passage by itself (lone)."""
    for chain in best_chains(parts):
        two = parts[chain, 3].sum() >= 2 * SEED_WORDS
        if two and fresh or lone[chain].any() and (fresh or not two):
            yield parts[chain]


def open_windows(ids: np.ndarray, pos: np.ndarray, words: np.ndarray, parts: np.ndarray, of_part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a lone seed may belong to a passage: (running number of such places, where each document starts in it).

    A place is the start of LEAST_WORDS words of which LEAST_SHARE are in seeds that earlier documents have, and which don't stand in one
    piece in one of these. ids, pos, words: matches, ids as numbers from 0 that rise. parts: segments, of_part: their documents."""
    most = np.zeros(ids[-1] + 1, np.int64)
    np.maximum.at(most, ids, pos + words)
    at = np.concatenate([[0], np.cumsum(most + LEAST_WORDS)])  # each document, and room behind it
    edges = np.zeros(at[-1] + 1, np.int32)
    np.add.at(edges, at[ids] + pos, 1)
    np.add.at(edges, at[ids] + pos + words, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
    enough = covered[LEAST_WORDS:] - covered[:-LEAST_WORDS] >= LEAST_SHARE * LEAST_WORDS
    long = parts[:, 1] - parts[:, 0] >= LEAST_WORDS
    edges[:] = 0
    np.add.at(edges, at[of_part[long]] + parts[long, 0], 1)
    np.add.at(edges, at[of_part[long]] + parts[long, 1] - LEAST_WORDS + 1, -1)
    return np.concatenate([[0], np.cumsum(enough & (np.cumsum(edges)[: len(enough)] == 0))]), at


def chains(found: DataFrame, lone_seeds: bool = False) -> DataFrame:
    """(chain, doc_id, source, parts): parts has 4 numbers for each segment of the chain. lone_seeds: a chain may be one seed, too, where
    seeds that any earlier documents have make up enough for a passage. A pair of documents without a fresh match has had its chains."""
    schema = "doc_id long, source long, parts binary"
    kind = arrow_schema(schema)

    def of_docs(ids: np.ndarray, sources: np.ndarray, pos: np.ndarray, source_pos: np.ndarray, words: np.ndarray, fresh: np.ndarray) -> list[tuple]:
        order = order_of(ids, sources, pos - source_pos, pos)
        ids, sources, pos, source_pos, words, fresh = (x[order] for x in (ids, sources, pos, source_pos, words, fresh))
        starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (sources[1:] != sources[:-1])]))
        pair = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(ids)]])))
        parts, of_pair = segments(pair, pos, source_pos, words)
        lone = np.zeros(len(parts), bool)
        at = np.searchsorted(of_pair, np.arange(len(starts) + 1))
        new = np.bincount(pair, fresh, len(starts)) > 0
        enough = new & (np.bincount(of_pair, parts[:, 3], len(starts)) >= 2 * SEED_WORDS)
        if lone_seeds:
            doc = np.concatenate([[0], np.cumsum(ids[1:] != ids[:-1])])
            places, at_doc = open_windows(doc, pos, words, parts, doc[starts][of_pair])
            low = at_doc[doc[starts][of_pair]]
            lone = places[np.minimum(low + parts[:, 0], len(places) - 2) + 1] > places[np.maximum(low + parts[:, 1] - LEAST_WORDS, low)]
        rows = []
        for k in np.flatnonzero(enough | (np.bincount(of_pair, lone, len(starts)) > 0)):
            own = slice(at[k], at[k + 1])
            rows += [(ids[starts[k]], sources[starts[k]], chain.tobytes()) for chain in chains_of(parts[own], lone[own], new[k])]
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in buckets_of(batches):
            parts = [(*kinds[k], np.full(len(kinds[k][0]), k == NEW)) for k in (NEW, KNOWN) if k in kinds]
            kinds.clear()
            x = [np.concatenate(c) for c in zip(*parts, strict=True)]
            if not lone_seeds:  # pairs with one short seed have no chain; two of another pair's hash make no difference
                pair = mix64(mix64(x[0].view(np.uint64)) + x[1].view(np.uint64)) >> np.uint64(64 - max(10, 2 + len(x[0]).bit_length()))
                some = (np.bincount(pair.astype(np.int64))[pair.astype(np.int64)] > 1) | (x[4] > SEED_WORDS)
                x = [c[some] for c in x]
            order = np.argsort(x[0])
            x = [c[order] for c in x]
            for a, b in cuts(x[0], 4 * STEP_ROWS):
                rows = of_docs(*(c[a:b] for c in x))
                if rows:
                    yield table_rows(dict(zip(kind.names, zip(*rows, strict=True), strict=True)), kind)
            del x
            give_back()

    return stored(dealt(found.filter(F.col("kind") <= KNOWN)).mapInArrow(run, schema).withColumn("chain", F.monotonically_increasing_id()), "chains")


# --- alignment ---------------------------------------------------------------------------------------------------------


def regions(parts: np.ndarray) -> np.ndarray:
    """What is aligned, rows (start, end, source_start, source_end): before the chain, between its segments, behind it."""
    start, end, source = parts[:, 0], parts[:, 1], parts[:, 2]
    source_end = source + end - start
    out = [(start[0] - MARGIN, start[0], source[0] - MARGIN, source[0])]
    out += [(end[i], start[i + 1], source_end[i], source[i + 1]) for i in range(len(parts) - 1)]
    out.append((end[-1], end[-1] + MARGIN, source_end[-1], source_end[-1] + MARGIN))
    return np.maximum(np.array(out, np.int64), 0)


def _agreeing_words(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words of x and of each prefix of y agree in their best alignment."""
    best = np.zeros(len(y) + 1, np.int32)
    for word in x:
        np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (y == word)), out=best[1:])
    return best


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each word of x the place of the word of y that it agrees with in the best alignment (longest common subsequence), or -1."""
    out = np.full(len(x), -1)
    if not len(x) or not len(y):
        return out
    if len(x) == len(y) and (same := x == y).mean() >= LEAST_SHARE:
        out[same] = np.flatnonzero(same)
        return out
    if len(x) * len(y) > GAP_CELLS and len(x) > 1:  # cut in two where the best alignments of both halves of x meet
        half = len(x) // 2
        at = int((_agreeing_words(x[:half], y) + _agreeing_words(x[half:][::-1], y[::-1])[::-1]).argmax())
        out[:half] = agreeing(x[:half], y[:at])
        rest = agreeing(x[half:], y[at:])
        out[half:] = np.where(rest >= 0, rest + at, -1)
        return out
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x)):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + (y == x[i])), out=best[i + 1, 1:])
    i, j = len(x), len(y)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out[i] = j
    return out


def extensions(xs: list[np.ndarray], ys: list[np.ndarray]) -> list[np.ndarray]:
    """How far each x and its y agree from their start: as agreeing(), up to the end of the best prefix. A match gains 1, all else costs 1."""
    n, w = len(xs), MARGIN
    x, y = np.full((n, w), -1, np.int64), np.full((n, w), -2, np.int64)
    for k in range(n):
        x[k, : len(xs[k])], y[k, : len(ys[k])] = xs[k], ys[k]
    cells = np.empty((w + 1, n, w + 1), np.int16)
    slope = np.arange(w + 1, dtype=np.int16)
    cells[0] = -slope
    for i in range(w):
        step = cells[i] - np.int16(1)
        step[:, 1:] = np.maximum(step[:, 1:], cells[i, :, :-1] + np.where(y == x[:, i : i + 1], 1, -1).astype(np.int16))
        cells[i + 1] = np.maximum.accumulate(step + slope, 1) - slope
    top = cells.transpose(1, 0, 2).reshape(n, -1).argmax(1)
    i, j = top // (w + 1), top % (w + 1)
    out = [np.full(k, -1) for k in i]
    places = np.full((n, w), -1)
    rows = np.arange(n)
    while len(rows := rows[(i[rows] > 0) & (j[rows] > 0)]):
        a, b = i[rows], j[rows]
        here = cells[a, rows, b]
        equal = x[rows, a - 1] == y[rows, b - 1]
        diagonal = here == cells[a - 1, rows, b - 1] + np.where(equal, 1, -1)
        up = ~diagonal & (here == cells[a - 1, rows, b] - 1)
        hit = diagonal & equal
        places[rows[hit], a[hit] - 1] = b[hit] - 1
        i[rows], j[rows] = a - (diagonal | up), b - (diagonal | ~up)
    for k in range(n):
        out[k][:] = places[k, : len(out[k])]
    return out


def passages(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """The longest (start, end) of which LEAST_SHARE agrees (places: -1 where a word doesn't), then the longest before it and behind it."""
    waiting = [(0, len(places))]
    while waiting:
        a, b = waiting.pop()
        hits = np.flatnonzero(places[a:b] >= 0) + a
        if not len(hits) or hits[-1] + 1 - hits[0] < LEAST_WORDS:
            continue
        order = np.arange(len(hits))
        before = order - LEAST_SHARE * hits  # an interval of hits i to j has j - i + 1 of hits[j] - hits[i] + 1 words
        behind = np.maximum.accumulate((before + 1 - LEAST_SHARE)[::-1])[::-1]
        last = len(hits) - np.searchsorted(behind[::-1], before - 1e-9, "left") - 1  # the last hit that makes enough
        last = np.maximum(last, order)
        i = int(np.argmax(hits[last] - hits))
        start, end = int(hits[i]), int(hits[last[i]]) + 1
        if end - start >= LEAST_WORDS:
            yield start, end
            waiting += [(a, start), (end, b)]


def aligned(chained: list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]) -> Iterator[Iterator[tuple[int, int, int, int, int, bool]]]:
    """(start, end, source_start, source_end, matched words, whether the text is known to end there) of the passages of each chain: (parts, words of each region, the source's)."""
    before = extensions([own[0][::-1] for _, own, _ in chained], [other[0][::-1] for _, _, other in chained])
    behind = extensions([own[-1] for _, own, _ in chained], [other[-1] for _, _, other in chained])
    for (parts, own, other), front, back in zip(chained, before, behind, strict=True):
        start, source = int(parts[0, 0]) - len(front), int(parts[0, 2])
        places = [np.where(front >= 0, source - 1 - front, -1)[::-1]]
        for k, (a, b, c, _) in enumerate(parts.tolist()):
            places.append(np.arange(c, c + b - a))
            gap = back if k == len(parts) - 1 else agreeing(own[k + 1], other[k + 1])
            places.append(np.where(gap >= 0, c + b - a + gap, -1))
        of_word = np.concatenate(places)
        stop = int(parts[-1, 1]) + len(own[-1]) if len(own[-1]) < MARGIN else -1
        yield ((start + a, start + b, int(of_word[a]), int(of_word[b - 1]) + 1, int((of_word[a:b] >= 0).sum()), start + b == stop) for a, b in passages(of_word))


def hopeful(rows: list[dict]) -> list[dict]:
    """Rows of chains (parts, own, own_counts, other) that may have a passage: if each word of their regions that the source's have, too,
    agreed, enough words of a long enough part would."""
    counts = [np.frombuffer(r["own_counts"], np.int32) for r in rows]
    parts = [np.frombuffer(r["parts"], np.int64).reshape(-1, 4) for r in rows]
    numbers = np.arange(len(rows), dtype=np.uint64) << np.uint64(32)
    own, other = (np.frombuffer(b"".join(r[k] for r in rows), np.uint32) + np.repeat(numbers, [len(r[k]) // 4 for r in rows]) for k in ("own", "other"))
    pieces, kinds = [], []  # for each chain a place before it, then regions (0) and segments (1) in turn
    for n, p in zip(counts, parts, strict=True):
        sizes = np.ones(2 * len(n), np.int64)
        sizes[1::2] = n
        sizes[2::2] = p[:, 1] - p[:, 0]
        pieces.append(sizes)
        kinds.append(np.arange(len(sizes)) % 2)
        kinds[-1][0] = 2
    sizes, kinds = np.concatenate(pieces), np.concatenate(kinds)
    chain = np.repeat(np.repeat(np.arange(len(rows)), [len(x) for x in pieces]), sizes)
    kinds = np.repeat(kinds, sizes)
    gain = np.where(kinds == 0, 4 - round(4 * LEAST_SHARE), 0)
    gain[kinds == 1] = np.where(np.isin(own, other), 4, 0) - round(4 * LEAST_SHARE)
    score = np.cumsum(gain) - chain * (8 * len(gain))  # so that one running minimum serves all chains
    low = np.minimum.accumulate(score)
    good = (score[LEAST_WORDS:] >= low[:-LEAST_WORDS]) & (chain[LEAST_WORDS:] == chain[:-LEAST_WORDS])
    hope = np.zeros(len(rows), bool)
    hope[chain[LEAST_WORDS:][good]] = True
    return [r for r, x in zip(rows, hope.tolist(), strict=True) if x]


def region_words(chained: DataFrame, docs: DataFrame) -> DataFrame:
    """(chain, role, words): the words of the chains' regions as 32-bit hashes, and how many each region has; role 0: the document's, 1: the source's."""
    wanted = chained.select("chain", "parts", F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("doc_id")), F.struct(F.lit(1).alias("role"), F.col("source").alias("doc_id")))).alias("x"))
    wanted = wanted.select("chain", "x.role", "x.doc_id", "parts")
    # about TEXT_CHAINS chains meet a copy of a text, however many a passage's first document has
    ids = stored(wanted.groupBy("doc_id").agg(F.ceil(F.count("*") / TEXT_CHAINS).alias("_groups")), "ids")
    few = ids.count() <= BROADCAST_IDS
    ids = F.broadcast(ids) if few else ids
    groups = wanted.join(ids, "doc_id").groupBy("doc_id", F.pmod(F.xxhash64("chain"), F.col("_groups")).alias("_group")).agg(F.collect_list(F.struct("chain", "role", "parts")).alias("wanted"))
    texts = docs.join(ids, "doc_id", "left_semi")
    schema = "chain long, role int, words binary, counts binary"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            hashes, _, _, at = word_hashes(data, offsets)
            small = hashes.astype(np.uint32)
            rows = []
            for group, a, b in zip(part.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                for r in group:
                    spans = np.minimum(regions(np.frombuffer(r["parts"], np.int64).reshape(-1, 4))[:, 2 * r["role"] : 2 * r["role"] + 2] + a, b)
                    rows.append((r["chain"], r["role"], b"".join(small[x:y].tobytes() for x, y in spans), np.maximum(spans[:, 1] - spans[:, 0], 0).astype(np.int32).tobytes()))
            yield table_rows(dict(zip(kind.names, zip(*rows, strict=True), strict=True)), kind)

    return groups.join(texts, "doc_id").select("wanted", "text").mapInArrow(run, schema)


def chain_passages(chained: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of SCHEMA: the passages of aligned chains; at_end: whether one is known to reach the end of its document."""
    own = words.filter("role = 0").select("chain", F.col("words").alias("own"), F.col("counts").alias("own_counts"))
    other = words.filter("role = 1").select("chain", F.col("words").alias("other"), F.col("counts").alias("other_counts"))
    joined = chained.join(own, "chain").join(other, "chain").select("doc_id", "source", "parts", "own", "own_counts", "other", "other_counts")
    schema = f"{SCHEMA}, at_end boolean"
    kind = arrow_schema(schema)

    def cut(words: bytes, counts: bytes) -> list[np.ndarray]:
        return np.split(np.frombuffer(words, np.uint32), np.cumsum(np.frombuffer(counts, np.int32))[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            some = [r for a in range(0, batch.num_rows, 8 * ALIGNED_CHAINS) for r in hopeful(batch.slice(a, 8 * ALIGNED_CHAINS).to_pylist())]
            for a in range(0, len(some), ALIGNED_CHAINS):
                part = some[a : a + ALIGNED_CHAINS]
                chained = [(np.frombuffer(r["parts"], np.int64).reshape(-1, 4), cut(r["own"], r["own_counts"]), cut(r["other"], r["other_counts"])) for r in part]
                for r, found in zip(part, aligned(chained), strict=True):
                    rows += [(r["doc_id"], start, end, r["source"], first, last, n, n / (end - start), at_end) for start, end, first, last, n, at_end in found]
            if rows:
                yield table_rows(dict(zip(kind.names, zip(*rows, strict=True), strict=True)), kind)
        give_back()

    return joined.mapInArrow(run, schema)


def shared_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", few: int = FEW) -> DataFrame:
    """One row per passage of LEAST_WORDS words or more that a document shares with an earlier one (a smaller doc_id).

    Places are words (runs without white space, A-Z as a-z), ends are exclusive. share: matched words over the passage's words.
    A document gets a row for each chain, so rows may overlap. Null ids and texts have no passages; rows that repeat a doc_id share
    nothing with each other, and if their texts differ, places refer to one of them. Ties go to the smallest doc_id, then place. Texts
    of any length are searched whole. Empty tables give no rows. Other columns are ignored.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    found = matches(docs)
    chained = chains(found)
    words = stored(region_words(chained, docs), "words")
    first = stored(chain_passages(chained, words).distinct(), "passages")
    for table in (chained, words):
        drop_table(docs.sparkSession, table.tidemark_path)
    rest = rest_matches(found, first, few)
    chained = chains(functools.reduce(DataFrame.unionByName, rest), lone_seeds=True)
    for table in rest:
        drop_table(docs.sparkSession, table.tidemark_path)
    words = stored(region_words(chained, docs), "words")
    return first.unionByName(chain_passages(chained, words)).drop("at_end").distinct()


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs (with its columns) without the words of the passages; documents of which nothing is left go. n_chars follows the text.

    Null texts and ids stay as they are, and so do columns of any other name. Rows that repeat a doc_id lose the same places.
    """
    own = free_name(docs, "spans")
    few = passages.count() <= BROADCAST_IDS  # two numbers each
    spans = passages.groupBy(F.col("doc_id").alias(free_name(docs, "id"))).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(own))  # at most a document's seeds
    spans = F.broadcast(spans) if few else spans
    joined = docs.join(spans, docs["doc_id"] == spans[free_name(docs, "id")], "left").drop(free_name(docs, "id"))
    changed = joined.filter(F.col(own).isNotNull())
    names = docs.columns
    schema = docs.schema

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            _, starts, ends, at = word_hashes(data, offsets)
            raw, texts = data.tobytes(), []
            for spans, a, b, lo, hi in zip(part.column(part.num_columns - 1).to_pylist(), at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True):
                kept, done = [], int(lo)
                for span in spans:
                    x, y = a + span["start_word"], min(a + span["end_word"], b)
                    if x < b and ends[y - 1] > done:
                        kept.append(raw[done : max(done, starts[x])])
                        done = int(ends[y - 1])
                kept.append(raw[done:hi])
                texts.append(b"".join(kept).decode("utf-8", "replace"))
            left = [bool(t.strip()) for t in texts]
            columns = {name: pa.array(texts, kind.field(name).type) if name == "text" else part.column(i) for i, name in enumerate(names)}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in texts], kind.field("n_chars").type)
            yield table_rows(columns, kind).filter(pa.array(left))

    return joined.filter(F.col(own).isNull()).select(*names).unionByName(changed.select(*names, own).mapInArrow(run, schema))
