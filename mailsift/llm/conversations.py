"""Conversations whose turns follow no legal order, repaired by the cheapest edits.

A repaired conversation is empty, or user and assistant in turn from a user to an assistant, with at
most one system row before. The edits of a row are Keep (0), Rerole to user or assistant (2) and Delete
(3, required for blank rows and for those whose role and text stood earlier in the conversation); an
empty row of user or assistant may be put in anywhere (Insert, 2), and a truncated row that stays costs
1. Of equally cheap edits the ones whose initials come first in ASCII order are taken.

How: the rows' roles and faults are a string of symbols, and four states say what the next row may be.
A symbol is a 4 x 4 min-plus matrix of costs from state to state. Equal neighbours are one run, and a run
is advanced by the cached binary powers of its matrix. Blocks of at most 2^16 rows are worked on by
themselves: their matrices, then the costs behind each block, then the choices in the blocks for every
state they may begin in, at last the states they do begin in. So no conversation is held whole by one
task, whatever its length. What the result itself asks for stays: the audit is one cell, and the digest
of a conversation is one pass over its rows, sorted and streamed, a batch in memory at a time.

Order and ties: rows stand by turn (nulls first), then role, then SHA-256 of the text; equal rows stand
together. A null role or text is one space, an empty role has no legal place. Null ids are one
conversation. Empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.frames import map_rows
from mailsift.operators.scaling import cut_lineage

# 2 to this power: rows of a conversation that one task works on at most.
BLOCK_BITS = 16
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
INITIALS = "sua"
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}
DELETE, CHANGE, INSERT = 3, 2, 2
# States: nothing yet, after the system row, after a user, after an assistant.
STATES = range(4)
DONE = (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
# The state after an inserted or changed row, and its role.
FORCED = (2, 2, 3, 2)
ROLE_INTO = {2: "u", 3: "a"}
FAR = 1 << 60

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


def _applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(a[i][k] + v[k] for k in STATES) for i in STATES)


def _inserts() -> Matrix:
    """Costs of going from state to state by inserted rows alone."""
    rows = []
    for i in STATES:
        row = [FAR] * 4
        state, cost = i, 0
        while cost < row[state]:
            row[state] = cost
            state, cost = FORCED[state], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


INSERTS = _inserts()
UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)
# Cheapest way to an end, from each state.
END: Vector = tuple(min(INSERTS[i][j] for j in DONE) for i in STATES)


def _symbol(code: str) -> tuple[str, int]:
    """Initial and fault of a code, a hexadecimal digit."""
    n = int(code, 16)
    return (INITIALS + "?")[n >> 2], n & 3


def _moves(code: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row met in ``state``, inserts aside, in ASCII order of the edits."""
    initial, fault = _symbol(code)
    moves = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        stays = int(fault == TRUNCATED)
        if (state, initial) in STEP:
            moves.append(("K", stays, STEP[state, initial]))
        moves.append(("R", CHANGE + stays, FORCED[state]))
    return moves


@lru_cache(maxsize=None)
def _power(code: str, k: int) -> Matrix:
    """The transition of 2^k rows of one symbol."""
    if k:
        half = _power(code, k - 1)
        return _times(half, half)
    rows = []
    for i in STATES:
        row = [FAR] * 4
        for _, cost, j in _moves(code, i):
            row[j] = min(row[j], cost)
        rows.append(tuple(row))
    return _times(INSERTS, tuple(rows))


@lru_cache(maxsize=1 << 14)
def _run(code: str, length: int) -> Matrix:
    out = UNIT
    for k in range(length.bit_length()):
        if length >> k & 1:
            out = _times(out, _power(code, k))
    return out


def _runs(codes: str) -> list[tuple[str, int]]:
    return [(code, sum(1 for _ in same)) for code, same in groupby(codes)]


@lru_cache(maxsize=1 << 14)
def _block(runs: tuple[tuple[str, int], ...]) -> Matrix:
    out = UNIT
    for code, length in runs:
        out = _times(out, _run(code, length))
    return out


def unrolled(codes: str, behind: Vector, state: int, last: bool) -> tuple[int, str]:
    """The state after a block begun in ``state`` and the initials of its edits, first in ASCII order.

    ``behind`` holds the cheapest costs of all that follows the block.
    """
    runs = _runs(codes)
    ends = [behind]
    for code, length in reversed(runs):
        v = ends[-1]
        for k in range(length.bit_length()):
            if length >> k & 1:
                v = _applied(_power(code, k), v)
        ends.append(v)
    ends.reverse()
    out: list[str] = []
    for (code, length), after in zip(runs, ends[1:], strict=True):
        rows = [after]
        for _ in range(length):
            rows.append(_applied(_power(code, 0), rows[-1]))
        for here, then in zip(rows[:0:-1], rows[-2::-1], strict=True):
            while True:
                edit, _, after_it = min(
                    m
                    for m in [*_moves(code, state), ("I", INSERT, FORCED[state])]
                    if m[1] + (here if m[0] == "I" else then)[m[2]] == here[state]
                )
                out.append(edit)
                state = after_it
                if edit != "I":
                    break
    while last and state not in DONE:
        out.append("I")
        state = FORCED[state]
    return state, "".join(out)


_short = lru_cache(maxsize=1 << 15)(unrolled)


def choices(codes: str, behind: Vector, state: int, last: bool) -> tuple[int, str]:
    """``unrolled``; short conversations are much alike, so theirs are kept."""
    return (_short if len(codes) <= 64 else unrolled)(codes, behind, state, last)


def edited(codes: str, audit: str, state: int) -> Iterator[tuple[int, str, str | None]]:
    """(row of the block, edit, new role) of every row of the repaired block, in order."""
    row = 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        if edit == "K":
            state = STEP[state, _symbol(codes[row])[0]]
            yield row, "Keep", None
        else:
            state = FORCED[state]
            role = NAMES[ROLE_INTO[state]]
            # Rows put in behind the last one count as that one's.
            yield min(row, len(codes) - 1), "Rerole" if edit == "R" else "Insert", role
        row += edit != "I"


def _counts(codes: str) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated and illegal of a block."""
    symbols = [_symbol(c) for c in codes]
    faults = [f for _, f in symbols]
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(symbols, symbols[1:], strict=False))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest and ``ord``, a number that grows along every conversation.

    The rows are sorted by ranges, so a conversation may lie in many tasks; equal rows too, by their place.
    """
    plain = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    keyed = plain.withColumn("digest", F.sha2("text", 256)).withColumn("place", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest", "place")]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place")
    return cut_lineage(dealt.withColumn("ord", F.monotonically_increasing_id()))


def _codes(rows: DataFrame) -> DataFrame:
    """conv_id, ord and the row's symbol: four times the number of its role's initial, plus its fault."""
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("ord").alias("ord"))
    text = F.col("text")
    place = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    initial = F.when((place < 0) | (F.col("role") == ""), len(INITIALS)).otherwise(place)
    # The faults that lie in the text are found before the join, which then carries no texts.
    narrow = rows.select(
        "conv_id",
        "ord",
        initial.alias("_initial"),
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(0)
        .alias("_fault"),
    )
    marked = narrow.join(first.select("ord", F.lit(True).alias("_first")), "ord", "left")
    fault = F.when((F.col("_fault") != BLANK) & F.col("_first").isNull(), DUPLICATE).otherwise(F.col("_fault"))
    return marked.select("conv_id", "ord", F.lower(F.hex((F.col("_initial") * 4 + fault).cast("long"))).alias("code"))


def _gathered(df: DataFrame, *columns: str) -> DataFrame:
    """The blocks of each conversation in order, as the array ``blocks``."""
    return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("blocks"))


def _outlines(slices: Iterator[dict]) -> Iterable[list[tuple]]:
    for part in slices:
        out = []
        for conv, start, codes in zip(part["conv_id"], part["start"], part["codes"], strict=True):
            matrix = _block(tuple(_runs(codes))) if len(codes) <= 64 else _block.__wrapped__(tuple(_runs(codes)))
            ends = _symbol(codes[0])[0] + _symbol(codes[-1])[0]
            out.append((conv, start, [x for row in matrix for x in row], ends))
        yield out


def _behind(slices: Iterator[dict]) -> Iterable[list[tuple]]:
    for part in slices:
        out = []
        for blocks in part["blocks"]:
            behind = END
            for i in range(len(blocks) - 1, -1, -1):
                flat = blocks[i]["matrix"]
                before = _applied(tuple(tuple(flat[4 * k : 4 * k + 4]) for k in STATES), behind)
                seam = int(i > 0 and blocks[i - 1]["ends"][1] + blocks[i]["ends"][0] not in LEGAL)
                cost = before[0] if i == 0 else 0
                out.append((blocks[i]["start"], list(behind), i == 0, i == len(blocks) - 1, seam, cost))
                behind = before
        yield out


def _unroll(slices: Iterator[dict]) -> Iterable[list[tuple]]:
    for part in slices:
        out = []
        columns = ("conv_id", "start", "codes", "behind", "first", "last", "seam", "cost")
        for conv, start, codes, behind, first, last, seam, cost in zip(*(part[c] for c in columns), strict=True):
            # The first block begins with nothing before; others may begin in any state.
            found = [choices(codes, tuple(behind), s, last) for s in (STATES[:1] if first else STATES)]
            blank, duplicate, truncated, illegal = _counts(codes)
            ends, audits = [e for e, _ in found], [a for _, a in found]
            out.append((conv, start, codes, ends, audits, blank, duplicate, truncated, illegal + seam, cost))
        yield out


def _begin(slices: Iterator[dict]) -> Iterable[list[tuple]]:
    for part in slices:
        out = []
        for blocks in part["blocks"]:
            state = 0
            for block in blocks:
                out.append((block["start"], state))
                state = block["ends"][state]
        yield out


def _edits(slices: Iterator[dict]) -> Iterable[list[tuple]]:
    for part in slices:
        for start, codes, audit, state in zip(*(part[c] for c in ("start", "codes", "audit", "state")), strict=True):
            out = []
            for slot, (row, edit, role) in enumerate(edited(codes, audit, state)):
                out.append((start + row, slot, edit, role))
                if len(out) == 1 << 12:
                    yield out
                    out = []
            yield out


@dataclass(frozen=True)
class Repaired:
    """What ``repair`` finds; both tables lie in the shared folder.

    ``blocks``: conv_id, start, codes, state, audit, blank, duplicate, truncated, illegal, cost, one row a
    block; the sums and the audits joined by ``start`` are a conversation's. ``rows``: conv_id, turn, role,
    text, ord, as the conversations were, in order.
    """

    blocks: DataFrame
    rows: DataFrame

    def report(self) -> DataFrame:
        """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost and audit."""
        counts = ("blank", "duplicate", "truncated", "illegal", "cost")
        audits = F.array_sort(F.collect_list(F.struct("start", "audit")))
        found = self.blocks.groupBy("conv_id").agg(
            *[F.sum(c).alias(c) for c in counts], F.array_join(F.transform(audits, lambda x: x["audit"]), "").alias("audit")
        )
        gap = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
        gaps = self.rows.groupBy("conv_id").agg(F.coalesce(gap, F.lit(0)).cast("long").alias("gaps"))
        return merged(
            found.withColumn("gaps", F.lit(0).cast("long")),
            gaps.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in counts], F.lit("").alias("audit"), "gaps"),
        )

    def conversations(self) -> DataFrame:
        """The rows of the repaired conversations: conv_id, ord and slot (their order), edit, role, text."""
        edits = map_rows(
            self.blocks.select("start", "codes", "audit", "state"), _edits, "ord long, slot int, edit string, new string"
        )
        text = F.when(F.col("edit") == "Insert", "").otherwise(F.col("text"))
        return edits.join(self.rows, "ord").select(
            "conv_id", "ord", "slot", "edit", F.coalesce("new", "role").alias("role"), text.alias("text")
        )


def merged(*reports: DataFrame) -> DataFrame:
    """Reports of the same conversations added up: numbers are summed, of texts the greatest stays."""
    union = reports[0]
    for other in reports[1:]:
        union = union.unionByName(other)
    kinds = {f.name: f.dataType.typeName() for f in union.schema.fields}
    made = [(F.sum if kinds[c] == "long" else F.max)(c).alias(c) for c in union.columns if c != "conv_id"]
    return union.groupBy("conv_id").agg(*made)


def repair(rows: DataFrame, block_bits: int = BLOCK_BITS) -> Repaired:
    """Cheapest edits of every conversation of a table with conv_id, turn, role and text."""
    kept = ordered(rows)
    start = F.min("ord").alias("start")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "code"))), lambda x: x["code"])
    # Numbers of one conversation's rows are consecutive within a task, so a block holds a stretch of it.
    block = F.shiftright("ord", block_bits).alias("block")
    blocks = _codes(kept).groupBy("conv_id", block).agg(start, F.array_join(codes, "").alias("codes")).drop("block")
    blocks = cut_lineage(blocks)
    conv = blocks.schema["conv_id"].dataType.simpleString()

    outlines = map_rows(blocks, _outlines, f"conv_id {conv}, start long, matrix array<long>, ends string")
    behind = map_rows(
        _gathered(outlines, "start", "matrix", "ends").select("blocks"),
        _behind,
        "start long, behind array<long>, first boolean, last boolean, seam long, cost long",
    )
    found = map_rows(
        blocks.join(behind, "start"),
        _unroll,
        f"conv_id {conv}, start long, codes string, ends array<int>, audits array<string>, "
        "blank long, duplicate long, truncated long, illegal long, cost long",
    )
    found = cut_lineage(found)
    begun = map_rows(_gathered(found, "start", "ends").select("blocks"), _begin, "start long, state int")
    audit = F.element_at("audits", F.col("state") + 1).alias("audit")
    kinds = ("blank", "duplicate", "truncated", "illegal", "cost")
    told = found.join(begun, "start").select("conv_id", "start", "codes", "state", audit, *kinds)
    return Repaired(cut_lineage(told), kept.drop("digest"))


def digests(rows: DataFrame, line: Column) -> DataFrame:
    """conv_id and sha256 of each conversation's lines, joined by newlines, in order of ord and slot."""
    keyed = rows.select("conv_id", "ord", "slot", line.alias("line"))
    dealt = keyed.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "ord", "slot")

    def streamed(slices: Iterator[dict]) -> Iterable[list[tuple]]:
        now, open_ = None, None
        for part in slices:
            out = []
            for conv, text in zip(part["conv_id"], part["line"], strict=True):
                if open_ is None or conv != now:
                    if open_ is not None:
                        out.append((now, open_.hexdigest()))
                    now, open_ = conv, hashlib.sha256()
                else:
                    open_.update(b"\n")
                open_.update(text.encode())
            yield out
        if open_ is not None:
            yield [(now, open_.hexdigest())]

    conv = rows.schema["conv_id"].dataType.simpleString()
    return map_rows(dealt.select("conv_id", "line"), streamed, f"conv_id {conv}, sha256 string")
