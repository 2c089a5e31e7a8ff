"""Conversation structure repair: the cheapest edits that give a conversation's turns the roles `(s?(ua)+)?`, none of them blank or repeated.

Costs to go come from a dynamic program that runs backwards over turns and the four states of the grammar. A walk forwards then takes,
among the transitions that cost no more than their state's cost to go, the ASCII-least one. From its edits the turns are rebuilt and
hashed.

Rows are sorted by ranges of (conversation, turn), so a conversation of any size is cut over tasks, and tasks cut it into pieces of a
bounded size. One that lies in a single piece is repaired where it is read. Of the others each piece gives the matrix of costs from its
first states to its last ones; these are multiplied from the end to give each piece its costs to go; with these, each piece tells where
each state leads, which is followed from the start. Then all pieces are walked, each by itself. What goes through one task for a whole
conversation is a row for each piece: matrices, states, and in the end the rebuilt pieces, in order, one at a time in memory, since a
digest of it all is taken in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, shared_folder, stored, table_rows

#: Rows and characters of a piece; a longer text is in a piece by itself or ends one.
PIECE_ROWS, PIECE_CHARS = 4096, 4 << 20
#: Costs of edits, and what is added for a truncated turn that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Fixed values of the grammar: states are the start, after a system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": 1, "u": 2, "a": 3}
#: By state: where each initial's number leads, and where the turn that must or may follow does (a user's, or an assistant's).
NEXT = ({1: SYSTEM, 2: USER}, {2: USER}, {3: ASSISTANT}, {2: USER})
FOLLOWS = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Faults of a row, in the order in which they count.
SOUND, BLANK, DUPLICATE, CUT = range(4)
WHITE = " \t\n\v\f\r"
FAR = 1 << 60

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text after damage by crc32(`conv_id:turn`) % 20; nulls count as one space (a turn stays null besides)."""
    given = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(given(conv_id), F.lit(":"), given(turn))) % 20
    rows = conversations.select(conversations[conv_id].alias("conv"), conversations[turn].cast("long").alias("turn"), given(role).alias("role"), given(text).alias("text"), kind.alias("kind"))
    rows = rows.filter("kind <> 0").withColumn("_copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text_ = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"))


# --- one piece of a conversation -------------------------------------------------------------------------------------


def fault(text: str, repeated: bool) -> int:
    end = text.rstrip(WHITE)
    return BLANK if not end else DUPLICATE if repeated else CUT if end[-1] not in ".!?" else SOUND


def codes_of(roles: list[str], texts: list[str], repeated: set[int]) -> bytes:
    """A byte for each row: its role's number (0 if it is no role of the grammar) and its fault."""
    return bytes(INITIALS.get(r[:1], 0) | fault(t, i in repeated) << 2 for i, (r, t) in enumerate(zip(roles, texts, strict=True)))


def repeats(roles: list[str], texts: list[str]) -> set[int]:
    """Places of rows whose role and text were seen earlier, of a whole conversation."""
    seen: set[tuple[str, str]] = set()
    out = set()
    for i, x in enumerate(zip(roles, texts, strict=True)):
        if x in seen:
            out.add(i)
        seen.add(x)
    return out


def with_inserts(g: list[int]) -> list[int]:
    """Costs to go if turns may be inserted first."""
    u, a = min(g[USER], g[ASSISTANT] + INSERT), min(g[ASSISTANT], g[USER] + INSERT)
    return [min(g[START], u + INSERT), min(g[SYSTEM], u + INSERT), u, a]


END = with_inserts([0, FAR, FAR, 0])


def costs_to_go(codes: bytes, after: list[int]) -> list[list[int]]:
    """By row, and after the last one: each state's cost to go. after: that of what follows."""
    out = [after]
    for code in reversed(codes):
        known, wrong = code & 3, code >> 2
        f = out[-1]
        g = [DELETE + x for x in f]
        if wrong not in (BLANK, DUPLICATE):
            more = TRUNCATED if wrong == CUT else 0
            for q in range(4):
                g[q] = min(g[q], REROLE + more + f[FOLLOWS[q]])
                if known in NEXT[q]:
                    g[q] = min(g[q], more + f[NEXT[q][known]])
        out.append(with_inserts(g))
    return out[::-1]


def walk(codes: bytes, f: list[list[int]], state: int, last: bool) -> tuple[str, list[tuple[int, int]], int]:
    """Edits from `state` on, the turns they give (row, or -1 for an inserted one; the state it leads to), and the last state."""
    edits, turns, i = [], [], 0
    while True:
        here = f[i][state]
        if i == len(codes):
            if not last or here == 0:
                return "".join(edits), turns, state
            edits.append("I")
            state = FOLLOWS[state]
            turns.append((-1, state))
            continue
        known, wrong, after = codes[i] & 3, codes[i] >> 2, f[i + 1]
        more = TRUNCATED if wrong == CUT else 0
        if DELETE + after[state] == here:
            edits.append("D")
            i += 1
        elif INSERT + f[i][FOLLOWS[state]] == here:
            edits.append("I")
            state = FOLLOWS[state]
            turns.append((-1, state))
        else:  # what is blank or repeated was deleted above
            kept = NEXT[state].get(known)
            keep = kept is not None and more + after[kept] == here
            edits.append("K" if keep else "R")
            state = kept if keep else FOLLOWS[state]
            turns.append((i, state if not keep else -1))
            i += 1


def rebuilt(turns: list[tuple[int, int]], roles: list[str], texts: list[str]) -> list[str]:
    return [f"{NAMES[q]}:" if i < 0 else f"{roles[i] if q < 0 else NAMES[q]}:{texts[i]}" for i, q in turns]


def told(turns: list[int | None], roles: list[str], codes: bytes) -> dict[str, object]:
    """What the pieces of a conversation say besides their edits; joined by Told."""
    own = [t for t in turns if t is not None]
    wrong = [c >> 2 for c in codes]
    return {
        "low": own[0] if own else None,
        "high": own[-1] if own else None,
        "distinct": sum(a != b for a, b in pairwise(own)) + bool(own),
        "blank": wrong.count(BLANK),
        "duplicate": wrong.count(DUPLICATE),
        "truncated": wrong.count(CUT),
        "illegal": sum(a[:1] + b[:1] not in LEGAL for a, b in pairwise(roles)),
        "head": roles[0][:1],
        "tail": roles[-1][:1],
    }


class Told:
    """A conversation's result, from its pieces in order."""

    def __init__(self, cost: int):
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
        self.low = self.high = self.tail = None
        self.cost, self.audit, self.sha, self.lines = cost, [], hashlib.sha256(), 0

    def add(self, piece: dict, audit: str, text: str, lines: int) -> None:
        for k in self.sums:
            self.sums[k] += piece[k]
        if self.tail is not None:
            self.sums["illegal"] += self.tail + piece["head"] not in LEGAL
        self.tail = piece["tail"]
        if piece["low"] is not None:
            self.sums["distinct"] -= self.high is not None and self.high == piece["low"]
            self.low = piece["low"] if self.low is None else self.low
            self.high = piece["high"]
        self.audit.append(audit)
        if lines:
            self.sha.update((("\n" if self.lines else "") + text).encode("utf-8", "surrogatepass"))
            self.lines += lines

    def row(self) -> dict[str, object]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["distinct"]
        counts = {k: self.sums[k] for k in ("blank", "duplicate", "truncated", "illegal")}
        return {"gaps": gaps, **counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def repaired(turns: list[int | None], roles: list[str], texts: list[str]) -> dict[str, object]:
    """The result for a whole conversation in memory."""
    codes = codes_of(roles, texts, repeats(roles, texts))
    f = costs_to_go(codes, END)
    edits, made, _ = walk(codes, f, START, True)
    out, lines = Told(f[0][START]), rebuilt(made, roles, texts)
    out.add(told(turns, roles, codes), edits, "\n".join(lines), len(lines))
    return out.row()


# --- conversations over many tasks ------------------------------------------------------------------------------------


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def read_pieces(rows: DataFrame) -> DataFrame:
    """Sorted rows to results of the conversations that lie within one piece inside a task, and, with `piece` set, pieces of all others.
    The first and the last conversation of a task may go on in the next ones, so they are always given as pieces."""
    conv = dict(rows.dtypes)["conv"]
    schema = f"conv {conv}, {RESULT}, part int, piece int, turns array<long>, roles array<string>, texts array<string>"
    kind = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        held: list[dict] = []
        size = number = 0  # number: of the task's next piece
        first, cut = True, False  # cut: pieces of the conversation at hand were given

        def piece() -> dict:
            columns = {f"{k}s": [r[k] for r in held] for k in ("turn", "role", "text")}
            return {"conv": held[0]["conv"], "part": part, "piece": number, **columns}

        def batch() -> pa.RecordBatch:
            made = table_rows({n: [r.get(n) for r in out] for n in kind.names}, kind)
            out.clear()
            return made

        ready = 0
        for row in _rows(batches):
            if held and (row["conv"] != held[0]["conv"] or len(held) >= PIECE_ROWS or size >= PIECE_CHARS):
                ends = row["conv"] != held[0]["conv"]
                if ends and not first and not cut:
                    out.append({"conv": held[0]["conv"], **repaired(*([r[k] for r in held] for k in ("turn", "role", "text")))})
                else:
                    out.append(piece())
                    ready += size
                    number += 1
                cut = not ends
                first = first and not ends
                held, size = [], 0
                if len(out) >= PIECE_ROWS or ready >= PIECE_CHARS:
                    yield batch()
                    ready = 0
            held.append(row)
            size += len(row["text"]) + len(row["role"])
        if held:
            out.append(piece())
        if out:
            yield batch()

    return rows.mapInArrow(run, schema)


def repeated_rows(pieces: DataFrame) -> DataFrame:
    """part, piece, repeated (places of rows whose role and text come earlier in the conversation). The first place of each text is an
    aggregate; the rows that are not such a place follow by a join on places, which are all different."""
    each = pieces.select("conv", "part", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "row"))
    digest = F.sha2(F.concat(F.octet_length("row.roles").cast("string"), F.lit(":"), F.col("row.roles"), F.col("row.texts")), 256)
    each = stored(each.select("conv", "part", "piece", "pos", digest.alias("digest")), "turns")
    first = each.groupBy("conv", "digest").agg(F.min(F.struct("part", "piece", "pos")).alias("at")).select("at.*")
    return each.join(first, ["part", "piece", "pos"], "left_anti").groupBy("part", "piece").agg(F.collect_list("pos").alias("repeated"))


def in_order(pieces: DataFrame, forwards: bool) -> DataFrame:
    order = [F.asc("part"), F.asc("piece")] if forwards else [F.desc("part"), F.desc("piece")]
    return pieces.repartition("conv").sortWithinPartitions("conv", *order)


def costs_after(coded: DataFrame) -> DataFrame:
    """part, piece, after (costs to go behind the piece), last. Matrices in parallel, their products from each conversation's end."""
    conv = dict(coded.dtypes)["conv"]
    schema = f"conv {conv}, part int, piece int, matrix array<long>"
    kind = arrow_schema(schema)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            units = [[0 if p == q else FAR for p in range(4)] for q in range(4)]
            columns = [costs_to_go(r["codes"], unit)[0] for unit in units]
            yield table_rows({"conv": [r["conv"]], "part": [r["part"]], "piece": [r["piece"]], "matrix": [[min(columns[q][p], FAR) for p in range(4) for q in range(4)]]}, kind)

    after_kind = arrow_schema("part int, piece int, after array<long>, last boolean")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list = []
        f: list[int] = []
        for r in _rows(batches):
            last = not at or at[0] != r["conv"]
            if last:
                at, f = [r["conv"]], END
            yield table_rows({"part": [r["part"]], "piece": [r["piece"]], "after": [f], "last": [last]}, after_kind)
            m = r["matrix"]
            f = [min(FAR, *(m[4 * p + q] + f[q] for q in range(4))) for p in range(4)]

    found = coded.select("conv", "part", "piece", "codes").mapInArrow(matrices, schema)
    return in_order(found, False).mapInArrow(products, "part int, piece int, after array<long>, last boolean")


def states_before(coded: DataFrame) -> DataFrame:
    """part, piece, state (at the piece's start). coded has after and last. Where each state leads is found in parallel."""
    conv = dict(coded.dtypes)["conv"]
    schema = f"conv {conv}, part int, piece int, leads array<int>"
    kind, out_kind = arrow_schema(schema), arrow_schema("part int, piece int, state int")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            f = costs_to_go(r["codes"], r["after"])
            leads = [walk(r["codes"], f, q, r["last"])[2] if f[0][q] < FAR else START for q in range(4)]
            yield table_rows({"conv": [r["conv"]], "part": [r["part"]], "piece": [r["piece"]], "leads": [leads]}, kind)

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list = []
        state = START
        for r in _rows(batches):
            if not at or at[0] != r["conv"]:
                at, state = [r["conv"]], START
            yield table_rows({"part": [r["part"]], "piece": [r["piece"]], "state": [state]}, out_kind)
            state = r["leads"][state]

    found = coded.select("conv", "part", "piece", "codes", "after", "last").mapInArrow(maps, schema)
    return in_order(found, True).mapInArrow(followed, "part int, piece int, state int")


def repair_pieces(pieces: DataFrame) -> DataFrame:
    """conv and results of the conversations that are given in pieces."""
    conv = dict(pieces.dtypes)["conv"]
    code_schema = f"conv {conv}, part int, piece int, codes binary"
    code_kind = arrow_schema(code_schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            yield table_rows({"conv": [r["conv"]], "part": [r["part"]], "piece": [r["piece"]], "codes": [codes_of(r["roles"], r["texts"], set(r["repeated"] or []))]}, code_kind)

    at = ["part", "piece"]
    coded = pieces.join(repeated_rows(pieces), at, "left").select("conv", *at, "roles", "texts", "repeated").mapInArrow(encode, code_schema)
    coded = stored(coded, "coded")
    coded = stored(coded.join(costs_after(coded), at), "costs")
    ready = pieces.join(coded.drop("conv").join(states_before(coded), at), at)

    facts = "low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, head string, tail string"
    made_schema = f"conv {conv}, part int, piece int, cost long, audit string, text string, lines int, {facts}"
    made_kind, out_kind = arrow_schema(made_schema), arrow_schema(f"conv {conv}, {RESULT}")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            f = costs_to_go(r["codes"], r["after"])
            edits, turns, _ = walk(r["codes"], f, r["state"], r["last"])
            lines = rebuilt(turns, r["roles"], r["texts"])
            row = {"conv": r["conv"], "part": r["part"], "piece": r["piece"], "cost": f[0][START], "audit": edits, "text": "\n".join(lines), "lines": len(lines), **told(r["turns"], r["roles"], r["codes"])}
            yield table_rows({k: [row[k]] for k in made_kind.names}, made_kind)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: list = []
        whole: Told | None = None
        given = lambda: table_rows({k: [v] for k, v in {"conv": at[0], **whole.row()}.items()}, out_kind)
        for r in _rows(batches):
            if not at or at[0] != r["conv"]:
                if whole:
                    yield given()
                at, whole = [r["conv"]], Told(r["cost"])
            whole.add(r, r["audit"], r["text"], r["lines"])
        if whole:
            yield given()

    return in_order(ready.mapInArrow(make, made_schema), True).mapInArrow(join, f"conv {conv}, {RESULT}")


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation id, a null one included: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256, of its rows after damage (see damaged).

    Rows go by turn, nulls first, those of one turn by role and text. Null roles and texts are one space: such a text is blank, such a
    role none of the grammar's. Rows that repeat another one are duplicates of it. Texts of any length count whole. A conversation of
    which no row is left has zeros, an empty audit and the hash of nothing. An empty table gives no rows. Other columns are ignored.
    """
    shared_folder(conversations.sparkSession)
    rows = damaged(conversations, conv_id, turn, role, text)
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role")]
    dealt = rows.repartitionByRange(*order, F.asc(F.substring("text", 1, 64))).sortWithinPartitions(*order, "text")
    read = stored(read_pieces(dealt), "conversations")
    done = read.filter("piece IS NULL").drop("part", "piece", "turns", "roles", "texts")
    pieces = read.filter("piece IS NOT NULL").select("conv", "part", "piece", "turns", "roles", "texts")
    done = done.unionByName(repair_pieces(pieces))
    given = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    left = F.crc32(F.concat(given(conv_id), F.lit(":"), given(turn))) % 20 != 0
    gone = conversations.select(conversations[conv_id].alias("conv"), left.alias("left")).groupBy("conv").agg(F.bool_or("left").alias("left")).filter("NOT left")
    zeros = [F.lit(0).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    gone = gone.select("conv", *zeros, F.lit("").alias("audit"), F.lit(EMPTY_SHA).alias("repaired_sha256"))
    return done.unionByName(gone).withColumnRenamed("conv", "conv_id")
