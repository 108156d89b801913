"""Conversation structure repair: the cheapest edits that make a conversation alternate, by a square-root checkpointed DP.

A repaired conversation's role initials match ``(s?(ua)+)?``.  Its automaton has four states (start, after s, after u, after a), and in each the next
user or assistant turn is fixed, so a string of edit initials over the rows says everything: K(eep), R(erole), D(elete), I(nsert).
Costs: R 3, D 4, I 3, and 3 for each truncated row that is not deleted; blank rows and duplicates have to go.

*DP.*  A vector holds the least cost to the end of the conversation from each state.  ``walk`` goes backward once, storing vectors only at every
sqrt(n)-th row, then forward, recomputing one stretch of vectors at a time from its checkpoint, and takes at each step the ASCII-least edit that is tight
(D < I < K < R).  The edits so found are the ASCII-least of all cheapest ones.

*Spark.*  Rows shrink to cells (conversation, turn, role, SHA-256 of the text) with a count, combined before the exchange, so texts are not moved for the
DP and a row in very many copies is one cell.  Cells are range-partitioned in the order of the conversations and cut into blocks of at most
``block_rows`` rows, so a conversation of any length spreads over tasks.  Block ends are the outer checkpoints: a conversation of several
blocks gets its vectors from the blocks' 4 x 4 cost matrices, then its states at block starts from the blocks' walks from each state; both
steps hold a few numbers a block.  Then every block walks by itself.

Defined cases: a null role or text counts as one space, a null turn comes first, rows without an id are one conversation.  Rows of one turn are ordered by role
and SHA-256 of the text; equal rows are adjacent.  A role counts by its first character; an empty one fits nowhere.  ``gaps`` is null where it
does not fit a long.  Columns other than the four named ones are not looked at.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotlens.llm.common import ceil_div, stored

BLOCK_ROWS = 4096
CELLS_PER_TASK = 20_000

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: start, after s, after u, after a; the state after the next user or assistant turn, and that turn's role.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLE = ("user", "user", "assistant", "user")
#: Least cost from each state once all rows are gone.
END = (0, 2 * INSERT, INSERT, 0)
#: More than any cost.
NEVER = 1 << 60

# A row's code: its role's initial (other, s, u, a), whether it has to go, whether it is truncated, whether it is blank.
S, U, A = 1, 2, 3
GONE, CUT, BLANK = 4, 8, 16


# --- the DP --------------------------------------------------------------------------------------

def before(after: tuple, code: int) -> tuple:
    """Cost vector before a row from the one after it."""
    c0, c1, c2, c3 = (x + DELETE for x in after)
    if not code & GONE:
        extra = TRUNCATED if code & CUT else 0
        initial = code & 3
        to_u = after[AFTER_U] + extra + (0 if initial == U else REROLE)
        to_a = after[AFTER_A] + extra + (0 if initial == A else REROLE)
        c0, c1, c2, c3 = min(c0, to_u), min(c1, to_u), min(c2, to_a), min(c3, to_u)
        if initial == S:
            c0 = min(c0, after[AFTER_S] + extra)
    c2, c3 = min(c2, c3 + INSERT), min(c3, c2 + INSERT)
    return min(c0, c2 + INSERT), min(c1, c2 + INSERT), c2, c3


def vectors(codes: bytes, after: tuple) -> list[tuple]:
    """Vectors before each row, and ``after``."""
    out = [after]
    for code in reversed(codes):
        after = before(after, code)
        out.append(after)
    out.reverse()
    return out


def checkpoints(codes: bytes, after: tuple, step: int) -> list[tuple]:
    """Vectors before rows step, 2 step, ... and after the last row: all that is stored of the backward pass."""
    out = [after]
    for start in range((len(codes) - 1) // step * step, 0, -step):
        for code in reversed(codes[start:start + step]):
            after = before(after, code)
        out.append(after)
    out.reverse()
    return out


def matrix(codes: bytes) -> list[int]:
    """Least cost over a block from each state (row) to each state (column), 16 numbers."""
    columns = []
    for state in range(4):
        after = [NEVER] * 4
        after[state] = 0
        # what is inserted after the block's last row belongs to the next block
        columns.append(vectors(codes, tuple(after))[0])
    return [columns[j][i] for i in range(4) for j in range(4)]


def walk(codes: bytes, after: tuple, state: int, last: bool) -> tuple[str, int]:
    """(ASCII-least cheapest edits from ``state``, state at the end); with ``last`` also the insertions after the last row."""
    n = len(codes)
    step = max(1, math.isqrt(n))
    ends = checkpoints(codes, after, step) if n else []
    edits: list[str] = []
    for k, start in enumerate(range(0, n, step)):
        part = codes[start:start + step]
        costs = vectors(part, ends[k])
        row = 0
        while row < len(part):
            here, there, code = costs[row], costs[row + 1], part[row]
            want, to = here[state], NEXT[state]
            if there[state] + DELETE == want:
                edits.append("D")
                row += 1
                continue
            if here[to] + INSERT == want:
                edits.append("I")
                state = to
                continue
            extra = TRUNCATED if code & CUT else 0
            initial = code & 3
            row += 1
            if initial == S and state == START and there[AFTER_S] + extra == want:
                edits.append("K")
                state = AFTER_S
                continue
            edits.append("K" if initial == to and there[to] + extra == want else "R")
            state = to
    if last:
        while END[state]:
            edits.append("I")
            state = NEXT[state]
    return "".join(edits), state


def outcome(edits: str, codes: bytes, state: int) -> tuple[list[tuple[int | None, str | None]], int]:
    """((row or None where inserted, role it gets or None where it keeps its own) of every repaired row in order, cost)."""
    out: list[tuple[int | None, str | None]] = []
    row = cost = 0
    for edit in edits:
        if edit == "I":
            out.append((None, ROLE[state]))
            cost += INSERT
            state = NEXT[state]
            continue
        code = codes[row]
        if edit == "D":
            cost += DELETE
        else:
            cost += (TRUNCATED if code & CUT else 0) + (REROLE if edit == "R" else 0)
            out.append((row, ROLE[state] if edit == "R" else None))
            state = AFTER_S if edit == "K" and code & 3 == S else NEXT[state]
        row += 1
    return out, cost


# --- damage (the contract's test input) ------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after faults put in by crc32(conv_id:turn) % 20; nulls in texts are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


# --- Spark ---------------------------------------------------------------------------------------

_ORDER = ["known", "turn", "role", "digest"]  # of rows in a conversation, null turns first
_BLOCK = ("k string, known boolean, turn long, role string, digest binary, block long, codes binary, roles array<string>, digests array<binary>, "
          "blank long, duplicate long, truncated long, illegal long, first_initial int, last_initial int, turns long, last_turn long, min_turn long, max_turn long, costs array<long>")


def _key(conv: str) -> Column:
    return F.when(F.col(conv).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(k, known, turn, role, digest, code, text) of every row."""
    base = conversations.select(_key(conv).alias("k"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(0)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    code = initial + F.when(blank, BLANK).when(cut, CUT).otherwise(0)
    return base.select("k", F.col("turn").isNotNull().alias("known"), "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), code.cast("int").alias("code"), "text")


def _ordered(rows: DataFrame, tasks: int) -> DataFrame:
    """Cells in the order of the conversations; ahead of a cell that holds the first of its equal rows, a row with ``n`` 0."""
    cells = rows.groupBy("k", *_ORDER, "code").agg(F.count(F.lit(1)).alias("n"))
    firsts = cells.groupBy("k", "role", "digest", "code").agg(F.min(F.struct("known", "turn")).alias("at"))
    marks = firsts.select("k", "at.known", "at.turn", "role", "digest", "code", F.lit(0).cast("long").alias("n"))
    return cells.unionByName(marks).repartitionByRange(tasks, "k", *_ORDER).sortWithinPartitions("k", *_ORDER, "n")


class _Block:
    """Rows of one conversation gathered in order."""

    def __init__(self, cell: dict):
        self.first = cell
        self.codes = bytearray()
        self.roles: list[str] = []
        self.digests: list[bytes] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last_turn = self.min_turn = self.max_turn = None

    def add(self, cell: dict, n: int, first: bool) -> None:
        """``n`` equal rows; ``first``: the first of them is the first of its kind in the conversation."""
        code, turn = cell["code"], cell["turn"]
        initial = code & 3
        if self.codes:
            self.illegal += not _legal(self.codes[-1] & 3, initial)
        self.illegal += (n - 1) * (not _legal(initial, initial))
        if turn is not None:
            if turn != self.last_turn:
                self.turns += 1
            self.last_turn = self.max_turn = turn
            self.min_turn = turn if self.min_turn is None else self.min_turn
        if code & BLANK:
            self.blank += n
            self.codes += bytes([initial | GONE | BLANK]) * n
            return
        if first:
            self.truncated += code & CUT > 0
            self.codes.append(code)
            self.roles.append(cell["role"])
            self.digests.append(cell["digest"])
            n -= 1
        self.duplicate += n
        self.codes += bytes([initial | GONE]) * n

    def row(self, block: int, several: bool) -> tuple:
        """``several``: its conversation may have other blocks."""
        c = self.first
        return (c["k"], c["known"], c["turn"], c["role"], c["digest"], block, bytes(self.codes), self.roles, self.digests, self.blank, self.duplicate, self.truncated,
                self.illegal, self.codes[0] & 3, self.codes[-1] & 3, self.turns, self.last_turn, self.min_turn, self.max_turn, matrix(bytes(self.codes)) if several else None)


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((S, U), (U, A), (A, U))


def _table(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def _fields(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _blocks(ordered: DataFrame, block_rows: int) -> DataFrame:
    fields = _fields(_BLOCK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        block, k, alone, first = None, None, False, False  # alone: the conversation began in this task and has no earlier block
        for batch in batches:
            for cell in batch.to_pylist():
                if cell["k"] != k:
                    if block:
                        out.append(block.row(number, not alone))
                        number, block = number + 1, None
                    k, alone = cell["k"], k is not None
                n = cell["n"]
                if not n:
                    first = True
                while n:
                    block = block or _Block(cell)
                    take = min(n, block_rows - len(block.codes))
                    block.add(cell, take, first)
                    n, first = n - take, False
                    if len(block.codes) >= block_rows:
                        out.append(block.row(number, True))
                        number, block, alone = number + 1, None, False
                if len(out) >= 500:
                    yield _table(out, fields)
                    out.clear()
        if block:
            out.append(block.row(number, True))
        yield _table(out, fields)

    return ordered.mapInArrow(cut, _BLOCK)


_SORT = [(c, "ascending") for c in (*_ORDER, "block")]
_ENDS = "k string, known boolean, turn long, role string, digest binary, block long, after array<long>, begins boolean, ends boolean"
_STARTS = "block long, after array<long>, ends boolean, state int, place long"


def _states(blocks: DataFrame) -> DataFrame:
    """(block, after, ends, state, place) of the blocks of conversations that may have several: the cost vector after the block, whether it is
    the last one, the state it starts in and how many repaired rows come before it.  A group holds some 30 numbers for each ``block_rows`` rows."""
    ends_fields, starts_fields = _fields(_ENDS), _fields(_STARTS)

    def backward(table: pa.Table) -> pa.Table:
        rows = table.sort_by(_SORT).to_pylist()
        after, out = END, []
        for at in range(len(rows) - 1, -1, -1):
            r = rows[at]
            out.append((r["k"], r["known"], r["turn"], r["role"], r["digest"], r["block"], after, at == 0, at == len(rows) - 1))
            costs = r["costs"]
            after = tuple(min(costs[4 * i + j] + after[j] for j in range(4)) for i in range(4))
        return pa.Table.from_batches([_table(out, ends_fields)])

    def forward(table: pa.Table) -> pa.Table:
        state, place, out = START, 0, []
        for r in table.sort_by(_SORT).to_pylist():
            out.append((r["block"], r["after"], r["ends"], state, place))
            place += r["places"][state]
            state = r["to"][state]
        return pa.Table.from_batches([_table(out, starts_fields)])

    walked_ddl = f"{_ENDS}, to array<int>, places array<long>"
    walked_fields = _fields(walked_ddl)

    def from_each_state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                walks = [walk(r["codes"], tuple(r["after"]), s, r["ends"]) if s == START or not r["begins"] else ("", s) for s in range(4)]
                out.append((*(r[f.name] for f in ends_fields), [state for _, state in walks], [len(edits) - edits.count("D") for edits, _ in walks]))
            yield _table(out, walked_fields)

    several = blocks.where("costs IS NOT NULL")
    ends = several.select("k", *_ORDER, "block", "costs").groupBy("k").applyInArrow(backward, _ENDS)
    walked = several.select("block", "codes").join(ends, "block").mapInArrow(from_each_state, walked_ddl)
    return walked.groupBy("k").applyInArrow(forward, _STARTS)


_WALKED = _BLOCK.replace("codes binary, roles array<string>, digests array<binary>, ", "").replace(", costs array<long>", "") + (
    ", audit string, cost long, repaired array<struct<place: long, edit: string, role: string, own: string, digest: binary>>")


def _walk(blocks: DataFrame) -> DataFrame:
    """Every block's edits, and the repaired rows it gives."""
    fields = _fields(_WALKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(at, 200).to_pylist():
                    codes = r["codes"]
                    ends, state, place = (True, START, 0) if r["ends"] is None else (r["ends"], r["state"], r["place"])
                    audit, _ = walk(codes, END if ends else tuple(r["after"]), state, ends)
                    rows, cost = outcome(audit, codes, state)
                    own = [i for i, code in enumerate(codes) if not code & GONE]
                    which = dict(zip(own, range(len(own))))
                    kept = iter(e for e in audit if e != "D")
                    repaired = [(place + i, next(kept), role if role else r["roles"][which[row]], None if row is None else r["roles"][which[row]],
                                 None if row is None else r["digests"][which[row]]) for i, (row, role) in enumerate(rows)]
                    named = {"audit": audit, "cost": cost, "repaired": [dict(zip(("place", "edit", "role", "own", "digest"), x)) for x in repaired]}
                    out.append(tuple(named[f.name] if f.name in named else r[f.name] for f in fields))
                yield _table(out, fields)

    states = _states(blocks)
    return blocks.join(states, "block", "left").mapInArrow(run, _WALKED)


def _summary(walked: DataFrame, conv: str, kind: str) -> DataFrame:
    """One row per conversation from its blocks; what happens between two blocks is added from their ends."""
    between = F.struct(*_ORDER, "block", "audit", "first_initial", "last_initial", "last_turn")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "turns")]
    one = walked.groupBy("k").agg(*sums, F.min("min_turn").alias("low"), F.max("max_turn").alias("high"), F.array_sort(F.collect_list(between)).alias("blocks"))
    n = F.size("blocks")
    pairs = F.arrays_zip(F.slice("blocks", F.lit(1), n - 1).alias("x"), F.slice("blocks", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("y"))
    legal = lambda p: F.struct(p["x"]["last_initial"], p["y"]["first_initial"]).isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in ((S, U), (U, A), (A, U))])
    illegal = F.size(F.filter(pairs, lambda p: ~legal(p)))
    shared = F.size(F.filter(pairs, lambda p: F.coalesce(p["x"]["last_turn"] == p["y"]["turn"], F.lit(False))))
    gaps = F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - (F.col("turns") - shared)
    return one.select(
        F.when(F.col("k") != "", F.substring("k", 2, 1 << 30).cast(kind)).alias(conv), F.coalesce(gaps, F.lit(0)).try_cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        (F.col("illegal") + illegal).alias("illegal"), "cost", F.array_join(F.transform("blocks", lambda b: b["audit"]), "").alias("audit"))


def repair(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block_rows: int = BLOCK_ROWS, cells_per_task: int = CELLS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired).

    ``summary``: one row per conversation: its id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.
    ``repaired``: one row per row of the repaired conversations: id, ``place`` (from 0), ``role``, ``text``, ``edit`` (K, R or I).
    """
    kind = conversations.schema[conv].dataType
    rows = _rows(conversations, conv, turn, role, text)
    tasks = max(1, ceil_div(conversations.count(), cells_per_task))
    blocks = stored(_blocks(_ordered(rows.drop("text"), tasks), block_rows))
    walked = stored(_walk(blocks))
    edited = walked.select("k", F.explode("repaired").alias("r")).select("k", "r.*")
    texts = rows.where(F.col("code") < BLANK).groupBy("k", F.col("role").alias("own"), "digest").agg(F.min("text").alias("text"))
    kept = edited.where("edit <> 'I'").join(texts, ["k", "own", "digest"]).select("k", "place", "role", "text", "edit")
    added = edited.where("edit = 'I'").select("k", "place", "role", F.lit("").alias("text"), "edit")
    conv_id = F.when(F.col("k") != "", F.substring("k", 2, 1 << 30).cast(kind)).alias(conv)
    return _summary(walked, conv, kind), kept.unionByName(added).select(conv_id, "place", "role", "text", "edit")


def text_digests(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, repaired_sha256): SHA-256 of a conversation's ``role:text`` lines in order.  Lines stream through the hash, so a task holds none."""
    line = F.concat("role", F.lit(":"), "text").cast("binary")
    keyed = repaired.select(_key(conv).alias("k"), F.col(conv).alias("conv"), "place", line.alias("line"))
    schema = f"conv {repaired.schema[conv].dataType.simpleString()}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, conv_id, digest = None, None, None
        for batch in batches:
            out: list[tuple] = []
            convs = batch.column("conv")
            for i, (k, text) in enumerate(zip(batch.column("k").to_pylist(), batch.column("line").to_pylist())):
                if k == at:
                    digest.update(b"\n")
                else:
                    if digest:
                        out.append((conv_id, digest.hexdigest()))
                    at, conv_id, digest = k, convs[i].as_py(), hashlib.sha256()
                digest.update(text)
            yield _table(out, fields)
        yield _table([(conv_id, digest.hexdigest())] if digest else [], fields)

    fields = _fields(schema)
    return keyed.repartition("k").sortWithinPartitions("k", "place").mapInArrow(run, schema).withColumnRenamed("conv", conv)
