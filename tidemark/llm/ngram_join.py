"""N-gram Jaccard join: links documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more, exactly.

1. Documents with equal sets are one class; its smallest doc_id stands for it from here on.
2. Two sets can only be linked if they share a token among the first quarter of each in a common order (prefix filter). Tokens that
   many documents share come last in that order. Documents that share such a token are a block.
3. Seeds: the documents of a block are tested against the one that leads it, the two most frequent ones for each document. That joins
   large groups of near copies with a number of tests that is linear in their size.
4. Trees: blocks that still hold several components become signature trees. A node has the OR of its documents' token bitmaps,
   their range of sizes and, if they agree, their component. Large blocks are cut by size. A dual traversal drops pairs of nodes whose largest possible overlap is
   too small for their sizes, or that are of one component. What reaches the leaves is tested: first, for each block, a forest
   of them, then, with the components that it makes, all that is left.

Every test counts the shingles of both whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, arrow_schema, drop_table, mix64, signed, slices, stored, table_rows, windows, word_hashes

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: The order of tokens puts those last that are found in most documents. Counted are tokens found at least HEAVY_LEAST times among
#: HEAVY_CHUNK shingles; of these the most frequent HEAVY_TOKENS. The order bears on speed only: any order gives the same links.
HEAVY_LEAST, HEAVY_CHUNK, HEAVY_TOKENS = 4, 1_000_000, 200_000
#: Prefix tokens that a group of the block search should hold, and documents of a block that go into one tree.
GROUP_TOKENS, TREE_ROWS = 400_000, 512
#: Linked sets are no further apart in size than 100 / PERCENT, so at most one such step.
STEP = 1.334
#: Seeds of a document.
SEEDS = 2
FANOUT = 8
#: Documents in candidate pairs that are looked up by a broadcast set of ids; more are looked up by a join.
BROADCAST_IDS = 1_000_000
#: Parts that a label's nodes are dealt to where labels are too many to be sent.
SALTS = 64


# --- sets ------------------------------------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has all of them as one shingle."""
    hashes, _, _, at = word_hashes(data, offsets)
    rolled = windows(hashes, words)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            x = np.sort(rolled[a : b - words + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        else:
            out.append(mix64(windows(hashes[a:b], int(b - a)) + np.uint64(b - a)) if b > a else hashes[:0])
    return out


def least_overlap(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The smallest intersection of sets of these sizes that links them."""
    return -((-PERCENT * (a + b)) // (100 + PERCENT))


def prefix_size(n: int) -> int:
    """Tokens of which two linked sets share one, in any common order."""
    return n - -(-PERCENT * n // 100) + 1


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """One bit for each token, in at least four times as many bits; a power of two of bytes."""
    bits = max(64, 1 << int(4 * len(tokens) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap as it were in `size` bytes."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def heavy_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that many documents share, and the binary logarithm of how many (at least)."""
    kind = arrow_schema("token long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            n = np.diff(np.concatenate([at, [len(x)]]))
            return table_rows({"token": signed(x[at[n >= HEAVY_LEAST]]), "n": n[n >= HEAVY_LEAST]}, kind)

        for _, data, offsets in slices(batches):
            held += [x for x in shingle_sets(data, offsets) if len(x)]
            if sum(map(len, held)) > HEAVY_CHUNK:
                yield counted()
                held = []
        if held:
            yield counted()

    found = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    table = found.orderBy(F.desc("n"), "token").limit(HEAVY_TOKENS).toArrow()
    tokens = table.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(table.column("n").to_numpy()[order]).astype(np.uint8)


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n, ha, hb (which tell sets apart), prefix (tokens, 8 bytes each), bits, and core, of every document.

    core: how many thousandths of the prefix are tokens that many documents share. In a group of near copies it is largest for those
    that have least of their own, which are the likeliest to be linked with the others."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy_tokens(docs))
    schema = "doc_id long, n long, ha long, hb long, prefix binary, bits binary, core int"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, level = sent.value
        for part, data, offsets in slices(batches):
            n, ha, hb, prefix, bits, core = [], [], [], [], [], []
            for tokens in shingle_sets(data, offsets):
                n.append(len(tokens))
                ha.append(int(signed(mix64(tokens).sum(keepdims=True, dtype=np.uint64))[0]))
                hb.append(int(signed(mix64(tokens ^ np.uint64(0x5DEECE66D1234567)).sum(keepdims=True, dtype=np.uint64))[0]))
                core.append(0)
                if len(tokens):
                    size, ordered = prefix_size(len(tokens)), tokens
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
                        rank = np.where(heavy[at] == tokens, level[at] + 1, 0)
                        order = np.argsort(rank, kind="stable")
                        ordered = tokens[order]
                        core[-1] = int(1000 * np.count_nonzero(rank[order[:size]]) / size)
                    prefix.append(ordered[:size].tobytes())
                    bits.append(bitmap(tokens).tobytes())
                else:
                    prefix.append(b"")
                    bits.append(b"")
            yield table_rows({"doc_id": part.column(0), "n": n, "ha": ha, "hb": hb, "prefix": prefix, "bits": bits, "core": core}, kind)

    return stored(docs.mapInArrow(run, schema), "sets")


# --- blocks ----------------------------------------------------------------------------------------------------------

PACKED = "part int, tokens binary, docs binary, sizes binary, cores binary"


def packed_tokens(reps: DataFrame, parts: int) -> DataFrame:
    """reps: doc_id, n, prefix, core. Prefix tokens dealt to parts by token; a task sends each part its tokens in one row."""
    kind = arrow_schema(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def dealt() -> pa.RecordBatch:
            tokens, docs, sizes, cores = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (tokens >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            first = part[order][np.concatenate([[0], cuts])].astype(np.int32)
            columns = {name: [y.tobytes() for y in np.split(x[order], cuts)] for name, x in (("tokens", tokens), ("docs", docs), ("sizes", sizes), ("cores", cores))}
            return table_rows({"part": first, **columns}, kind)

        for batch in batches:
            for i, n, prefix, core in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(prefix, np.uint64)
                held.append((tokens, np.full(len(tokens), i, np.int64), np.full(len(tokens), n, np.int32), np.full(len(tokens), core, np.int16)))
                count += len(tokens)
                if count > GROUP_TOKENS:
                    yield dealt()
                    held, count = [], 0
        if count:
            yield dealt()

    return reps.select("doc_id", "n", "prefix", "core").mapInArrow(run, PACKED)


def blocks_of(rows: list[dict]) -> dict[str, np.ndarray] | None:
    """From the packed rows of a part: the blocks of its tokens that several documents have, equal sets of documents once.

    Columns block (a hash of its documents), m (how many they are), w (tokens that have just these), lead, doc_id, n. A block is led
    by its document with the largest core, of equal ones by the smallest.
    """
    joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
    tokens, docs = joined("tokens", np.uint64), joined("docs", np.int64)
    order = np.lexsort((docs, tokens))
    tokens = tokens[order]
    same = tokens[1:] == tokens[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    if not shared.any():
        return None
    order, tokens = order[shared], tokens[shared]
    docs, sizes, cores = docs[order], joined("sizes", np.int32)[order].astype(np.int64), joined("cores", np.int16)[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    m = np.diff(np.concatenate([first, [len(tokens)]]))
    of = np.repeat(np.arange(len(first)), m)
    lead = docs[np.lexsort((docs, -cores, of))[first]]
    key = np.add.reduceat(mix64(docs.view(np.uint64)), first)
    key, pick, w = np.unique(key, return_index=True, return_counts=True)
    m, lead = m[pick], lead[pick]
    take = np.repeat(first[pick] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
    spread = lambda x: np.repeat(x, m)
    return {"block": signed(spread(key)), "m": spread(m), "w": spread(w), "lead": spread(lead), "doc_id": docs[take], "n": sizes[take]}


def block_table(reps: DataFrame, parts: int) -> DataFrame:
    """block, m, w, lead, doc_id, n of all blocks of several documents: one shuffle of the prefix tokens."""
    schema = "block long, m long, w long, lead long, doc_id long, n long"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["part"] != row["part"]:
                    if found := blocks_of(held):
                        yield table_rows(found, kind)
                    held = []
                held.append(row)
        if held and (found := blocks_of(held)):
            yield table_rows(found, kind)

    found = packed_tokens(reps, parts).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, schema)
    once = found.groupBy("block", "doc_id").agg(F.sum("w").alias("w"), F.first("m").alias("m"), F.first("lead").alias("lead"), F.first("n").alias("n"))
    return stored(once, "blocks")


def seed_pairs(blocks: DataFrame) -> DataFrame:
    """(a, b): each document with the documents that lead its blocks, those of most tokens."""
    counted = blocks.filter("lead <> doc_id").groupBy("lead", "doc_id").agg(F.sum("w").alias("shared"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("shared"), "lead"))
    chosen = counted.withColumn("_place", best).filter(F.col("_place") <= SEEDS)
    return chosen.select(F.least("lead", "doc_id").alias("a"), F.greatest("lead", "doc_id").alias("b")).distinct()


def open_blocks(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """(block, m, main, doc_id, n, comp): documents of blocks of several components, blocks with the same smallest component put
    together; `main` is the component that most of a block's documents have.

    So a document stands once among the near copies of a group, however many blocks it shares with them.
    """
    named = blocks.join(labels.select(F.col("node").alias("doc_id"), "label"), "doc_id", "left").select("block", "doc_id", "n", F.coalesce("label", "doc_id").alias("comp"))
    named = stored(named, "named")
    several = named.groupBy("block").agg(F.min("comp").alias("lead"), F.max("comp").alias("_b")).filter("lead <> _b").select("block", "lead")
    rows = named.join(stored(several, "open"), "block").select("lead", "doc_id", "n", "comp").distinct()
    rows = stored(rows, "rows")
    counts = rows.groupBy("lead", "comp").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("lead").agg(F.sum("c").alias("m"), F.max_by("comp", F.struct("c", "comp")).alias("main"))
    return rows.join(stored(sizes, "sizes"), "lead").withColumnRenamed("lead", "block")


# --- signature trees ---------------------------------------------------------------------------------------------------


class Node:
    """A node of a signature tree: OR of bitmaps, range of sizes, the component if there is one only, and what is below."""

    __slots__ = ("bits", "children", "comp", "high", "leaf", "low", "slack")

    def __init__(self, low: int, high: int, bits: np.ndarray, slack: dict[int, int], comp: int | None, children: list[Node], leaf: int):
        self.low, self.high, self.bits, self.slack, self.comp, self.children, self.leaf = low, high, bits, slack, comp, children, leaf


def _ones(bits: np.ndarray) -> int:
    return int(np.bitwise_count(bits.view(np.uint64)).sum())


def leaf_of(place: int, n: int, comp: int, bits: bytes) -> Node:
    """slack: by bitmap size, how many tokens share a bit with another one."""
    x = np.frombuffer(bits, np.uint8)
    slack, y = {}, x
    while True:
        slack[len(y)] = n - _ones(y)
        if len(y) == 8:
            break
        y = fold(y, len(y) // 2)
    return Node(n, n, x, slack, comp, [], place)


def tree_of(leaves: list[Node]) -> Node:
    """Leaves by size, those of one component together, FANOUT to a node, level by level."""
    several = {c for c, n in Counter(x.comp for x in leaves).items() if n > 1}
    level = sorted(leaves, key=lambda x: (x.comp if x.comp in several else -1, x.low, x.leaf))
    while len(level) > 1:
        above = []
        for i in range(0, len(level), FANOUT):
            under = level[i : i + FANOUT]
            size = min(len(x.bits) for x in under)
            bits = np.bitwise_or.reduce([fold(x.bits, size) for x in under])
            slack = {s: max(x.slack[s] for x in under) for s in under[0].slack if all(s in x.slack for x in under)}
            comp = under[0].comp if all(x.comp == under[0].comp for x in under) else None
            above.append(Node(min(x.low for x in under), max(x.high for x in under), bits, slack, comp, under, -1))
        level = above
    return level[0]


def may_link(x: Node, y: Node) -> bool:
    """Whether documents below x and y may be linked and of different components."""
    if x.comp is not None and x.comp == y.comp:
        return False
    if 100 * x.high < PERCENT * y.low or 100 * y.high < PERCENT * x.low:
        return False
    size = min(len(x.bits), len(y.bits))
    common = _ones(fold(x.bits, size) & fold(y.bits, size)) + min(x.slack[size], y.slack[size])
    low = max(x.low, -(-PERCENT * y.low // 100)), max(y.low, -(-PERCENT * x.low // 100))  # sizes that may meet at all
    return common >= least_overlap(*low)


def dual_traversal(x: Node, y: Node) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that may be linked; of x with itself if y is x."""
    stack = [(x, y)]
    while stack:
        x, y = stack.pop()
        if x is y:
            below = x.children
            stack += [(below[i], below[j]) for i in range(len(below)) for j in range(i, len(below))]
        elif may_link(x, y):
            if not x.children and not y.children:
                yield x.leaf, y.leaf
            elif not y.children or (x.children and x.high - x.low >= y.high - y.low):
                stack += [(z, y) for z in x.children]
            else:
                stack += [(x, z) for z in y.children]


def tree_parts(rows: DataFrame) -> DataFrame:
    """Rows of open_blocks() once for each group that they are in: block, sub, i, j, own (their part, i or j), doc_id, n, comp.

    Of a block of at most TREE_ROWS documents those stay that have one of a linkable size beside them. A larger one is cut by size. Sizes go by steps of a little more than the largest ratio of linked
    sets, so a group `sub` needs the documents of a step and of the next larger one, and no two of the larger ones meet in it. Nor
    need two of the main component. What must meet in a group is cut into parts of TREE_ROWS, and each pair of these is a tree pair.
    """
    by_size = Window.partitionBy("block").orderBy("n")
    near = F.coalesce(100 * F.lag("n").over(by_size) >= PERCENT * F.col("n"), F.lit(False)) | F.coalesce(100 * F.col("n") >= PERCENT * F.lead("n").over(by_size), F.lit(False))
    small = rows.filter(F.col("m") <= TREE_ROWS).withColumn("near", near).filter("near").drop("near")
    rows = small.unionByName(rows.filter(F.col("m") > TREE_ROWS))
    whole, step = F.col("m") <= TREE_ROWS, F.floor(F.log("n") / float(np.log(STEP))).cast("int")
    rows = rows.withColumn("step", step).withColumn("sub", F.explode(F.when(whole, F.array(F.lit(-9))).otherwise(F.array(F.col("step"), F.col("step") - 1))))
    larger = F.when(~whole & (F.col("step") > F.col("sub")), 2).otherwise(0)
    # 0, 1: of the step; 2, 3: of the next; odd: not of the main component
    rows = rows.withColumn("kind", F.when(whole, 1).otherwise(larger + (F.col("comp") != F.col("main")).cast("int")))
    rows = stored(rows.select("block", "sub", "kind", "doc_id", "n", "comp"), "parts")
    counts = rows.groupBy("block", "sub").agg(*[F.ceil(F.count_if(F.col("kind") == k) / TREE_ROWS).alias(f"p{k}") for k in range(4)])
    first = [F.lit(0), F.col("p0"), F.col("p0") + F.col("p1"), F.col("p0") + F.col("p1") + F.col("p2")]
    counts = stored(counts.select("block", "sub", F.array(*[F.col(f"p{k}") for k in range(4)]).alias("parts"), F.array(*first).alias("first")), "counts")
    rows = rows.join(counts, ["block", "sub"])
    start = lambda k: F.col("first")[k]
    kind = F.col("kind")
    meets = lambda i: F.when(kind == 0, (i >= start(1)) & ((i < start(2)) | (i >= start(3)))).when(kind == 1, True).when(kind == 2, (i >= start(1)) & (i < start(2))).otherwise(i < start(2))
    own = F.col("first")[kind] + F.pmod(F.xxhash64("doc_id"), F.col("parts")[kind])
    rows = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), (start(3) + F.col("parts")[3] - 1).cast("int")), meets)))
    return rows.select("block", "sub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "n", "comp")


def tree_pairs(rows: DataFrame, reps: DataFrame, forest: bool) -> DataFrame:
    """(a, b, more) that the trees of open blocks leave over. Each pair of parts is a task's group.

    forest: a group gives no candidate that its others make needless, should they be links; `more` tells that it held some back."""
    schema = "a long, b long, more boolean"
    kind = arrow_schema(schema)
    rows = tree_parts(rows).join(reps.select("doc_id", "bits"), "doc_id").select("block", "sub", "i", "j", "own", "doc_id", "n", "comp", "bits")
    dealt = rows.repartition("block", "sub", "i", "j").sortWithinPartitions("block", "sub", "i", "j", "doc_id")

    def of_group(group: list[dict]) -> tuple[list[int], list[int], bool]:
        leaves = [leaf_of(k, r["n"], r["comp"], r["bits"]) for k, r in enumerate(group)]
        if group[0]["i"] == group[0]["j"]:
            root = tree_of(leaves)
            found = dual_traversal(root, root)
        else:
            left = [x for x, r in zip(leaves, group, strict=True) if r["own"] == r["i"]]
            right = [x for x, r in zip(leaves, group, strict=True) if r["own"] != r["i"]]
            found = dual_traversal(tree_of(left), tree_of(right)) if left and right else iter(())
        a, b, more = [], [], False
        above = {r["comp"]: r["comp"] for r in group}  # components, as far as this group's candidates would join them

        def top(c: int) -> int:
            while above[c] != c:
                above[c] = c = above[above[c]]
            return c

        for i, j in found:
            if forest:
                c, d = top(group[i]["comp"]), top(group[j]["comp"])
                if c == d:
                    more = True
                    continue
                above[max(c, d)] = min(c, d)
            x, y = group[i]["doc_id"], group[j]["doc_id"]
            a.append(min(x, y))
            b.append(max(x, y))
        return a, b, more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in ("block", "sub", "i", "j")):
                    a, b, more = of_group(held)
                    if a:
                        yield table_rows({"a": a, "b": b, "more": [more] * len(a)}, kind)
                    held = []
                held.append(row)
        if held:
            a, b, more = of_group(held)
            if a:
                yield table_rows({"a": a, "b": b, "more": [more] * len(a)}, kind)

    return dealt.mapInArrow(run, schema).groupBy("a", "b").agg(F.bool_or("more").alias("more"))


# --- tests and components ------------------------------------------------------------------------------------------------


def plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose sizes and bitmaps allow a link."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    kind = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            good = [r for r in rows if may_link(leaf_of(0, r["n_a"], 0, r["bits_a"]), leaf_of(1, r["n_b"], 1, r["bits_b"]))]
            if good:
                yield table_rows({"a": [r["a"] for r in good], "b": [r["b"] for r in good]}, kind)

    return joined.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a long, b long")


def tested(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b, linked) by the shingles of both texts."""
    schema = "a long, b long, linked boolean"
    kind = arrow_schema(schema)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = stored(ids, "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def sets(part: pa.RecordBatch, text: str) -> list[np.ndarray]:
        return [x for _, data, offsets in slices(iter([part]), text) for x in shingle_sets(data, offsets, words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in slices(batches, "text_a"):
            linked = []
            for x, y in zip(sets(part, "text_a"), sets(part, "text_b"), strict=True):
                z = np.sort(np.concatenate([x, y]))
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield table_rows({"a": part.column(0), "b": part.column(1), "linked": linked}, kind)

    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return stored(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, schema), "tested")


def _followed(lower: DataFrame) -> DataFrame:
    """(node, was, label): each label replaced by the label that it has itself. lower: node, was, label, stored.

    Most nodes may have one label, so it is no join by label of all of them: labels that fall are few rows, distinct on both
    sides, and go to every task, or beyond BROADCAST_ROWS to SALTS parts of their nodes.
    """
    used = lower.select("label").distinct()
    falling = lower.filter("label < node").select(F.col("node").alias("label"), F.col("label").alias("next")).join(used, "label", "left_semi")
    falling = stored(falling, "falling")
    if falling.count() <= BROADCAST_ROWS:
        met = lower.join(F.broadcast(falling), "label", "left")
    else:
        salted = falling.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = lower.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["label", "_salt"], "left")
    return met.select("node", "was", F.coalesce("next", "label").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all ends of edges (a, b): label is the smallest node that can be reached. Labels fall to the neighbours'
    smallest and then to their label's label, so the turns grow with the logarithm of a component's width."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = stored(labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "lower")
        new = stored(_followed(lower), "labels")
        moved = new.filter("was <> label").limit(1).count()
        for done in (labels, lower):
            drop_table(new.sparkSession, done.tidemark_path)
        labels = new
        if not moved:
            return labels.select("node", "label")


# --- the operator --------------------------------------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links lead to, the document's own included).

    Documents without words, or with a null text, link with nothing. A null doc_id is left with a null component and links with
    nothing. Rows that repeat a doc_id are one node of the graph, linked with whatever any of them is. Equal texts are one class, very
    long ones are compared whole. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    sets = set_table(docs)
    filled = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(filled.groupBy("n", "ha", "hb").agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "prefix", "bits", "core")
    reps = stored(reps, "reps")
    members = stored(sets.select("doc_id", "n", "ha", "hb").join(classes, ["n", "ha", "hb"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")), "members")
    drop_table(spark, sets.tidemark_path)
    total = reps.agg(F.sum(F.octet_length("prefix")) / 8).first()[0] or 0
    parts = max(64, int(total // GROUP_TOKENS) + 1)

    blocks = block_table(reps, parts)
    done = tested(stored(plausible(seed_pairs(blocks), reps), "seeds"), docs)
    for forest in (True, False):
        labels = components(done.filter("linked"))
        found = stored(tree_pairs(open_blocks(blocks, labels), reps, forest), "candidates")
        fresh = stored(found.join(done.select("a", "b"), ["a", "b"], "left_anti"), "fresh")
        if fresh.take(1):
            done = stored(done.unionByName(tested(fresh, docs)), "tested")
        if not found.filter("more").take(1):
            break
    # rows that repeat a doc_id may stand in several classes
    repeated = members.filter("rep IS NOT NULL AND rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    edges = done.filter("linked").select("a", "b").unionByName(repeated.join(reps.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b"))
    labels = components(edges)
    out = members.join(labels, members["rep"] == labels["node"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
