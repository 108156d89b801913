"""Conversation repair: the DP against all edit scripts, blocks against one walk, and the tables against a plain model."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from depotlens.llm import conversation_repair as repair
from depotlens.llm.queries import op12_conversation_repair
from pyspark.sql import functions as F

FITS = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, edits, repaired lines) by a plain forward DP over (role, text, fault) rows."""
    def insert(best):
        for _ in range(3):
            for state, (cost, edits, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    put(best, STEP.get((state, role[0])), (cost + 3, edits + "I", lines + [f"{role}:"]))
        return best

    def put(best, state, value):
        if state is not None and (state not in best or value[:2] < best[state][:2]):
            best[state] = value

    best = insert({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for state, (cost, edits, lines) in best.items():
            put(after, state, (cost + 4, edits + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 * (fault == "truncated")
            put(after, STEP.get((state, role[:1])), (cost, edits + "K", lines + [f"{role}:{text}"]))
            for new in ("user", "assistant"):
                put(after, STEP.get((state, new[0])), (cost + 3, edits + "R", lines + [f"{new}:{text}"]))
        best = insert(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda v: v[:2])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]), st.sampled_from([None, "truncated", "blank"])), max_size=4))
def test_plain_dp_against_all_scripts(rows):
    """The model itself against every script of edits."""
    best = None
    for n in range(len(rows) + 4):
        for script in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in script) != len(rows):
                continue
            for reroles in itertools.product("ua", repeat=sum(e in "RI" for e in script)):
                cost, initials, left, new = 0, "", iter(rows), iter(reroles)
                for e in script:
                    if e == "I":
                        cost, initials = cost + 3, initials + next(new)
                        continue
                    role, fault = next(left)
                    if e == "D":
                        cost += 4
                    elif fault == "blank":
                        cost = 999
                        break
                    else:
                        cost += 3 * (fault == "truncated") + 3 * (e == "R")
                        initials += next(new) if e == "R" else role[0]
                if cost < 999 and FITS.fullmatch(initials) and (best is None or (cost, "".join(script)) < best):
                    best = (cost, "".join(script))
    if len(rows) <= 3:
        assert cheapest([(r, "t.", f) for r, f in rows])[:2] == best


def codes_of(rows):
    initial = {"s": repair.S, "u": repair.U, "a": repair.A}
    return bytes(initial.get(r[:1], 0) | {"blank": repair.GONE | repair.BLANK, "duplicate": repair.GONE, "truncated": repair.CUT}.get(f, 0) for r, _, f in rows)


ROWS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x", ""]), st.just("t"), st.sampled_from([None, None, None, "truncated", "blank", "duplicate"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ROWS, st.lists(st.integers(0, 60), max_size=4))
def test_walk_and_blocks(rows, cuts):
    codes = codes_of(rows)
    audit, _ = repair.walk(codes, repair.END, repair.START, True)
    cost, want, _ = cheapest(rows)
    assert audit == want and repair.outcome(audit, codes, repair.START)[1] == cost
    ends = sorted({0, len(codes), *(c for c in cuts if c < len(codes))})
    parts = [codes[a:b] for a, b in zip(ends, ends[1:])] or [b""]
    after = [repair.END]
    for part in reversed(parts):
        m = repair.matrix(part)
        after.append(tuple(min(m[4 * i + j] + after[-1][j] for j in range(4)) for i in range(4)))
    state, got = repair.START, ""
    for k, (part, vector) in enumerate(zip(parts, reversed(after[:-1]))):
        edits, state = repair.walk(part, vector, state, k == len(parts) - 1)
        got += edits
    assert got == want


def test_checkpoints_hold_few_vectors():
    assert len(repair.checkpoints(bytes([repair.U]) * 10_000, repair.END, 100)) == 100


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def model(rows):
    """One conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    seen, faults, count = set(), [], collections.Counter()
    for _, _, role, text in rows:
        body = text.strip(BLANK)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        count[fault] += 1
    turns = [t for _, t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest([(r, t, f) for (_, _, r, t), f in zip(rows, faults)])
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": count["blank"], "duplicate": count["duplicate"], "truncated": count["truncated"],
            "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), "cost": cost, "audit": audit}, lines


def conversations(seed, n=900):
    rng = random.Random(seed)
    texts = ["One.", "One", " Two! \n", "Three?", "", " \t", None, "four. five", "Ü é.", "long " * 200 + "."]
    return [(rng.choice([None, 1, 2, 2, 2, 2, 3, rng.randrange(4, 60), 2**40]), rng.choice([None, rng.randrange(-3, 40), rng.randrange(10_000)]),
             rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*texts, f"text {rng.randrange(400)}."])) for _ in range(n)]


COLUMNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block_rows,cells_per_task", [(3, 40), (64, 100), (4096, 20_000)])
def test_tables_equal_model(spark, block_rows, cells_per_task):
    rows = conversations(3)
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]].append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    extra = [F.lit("x").alias(c) for c in ("k", "n", "block", "place", "edit", "own")]
    table = spark.createDataFrame(rows, COLUMNS).repartition(3).select("*", *extra)
    summary, repaired = repair.repair(table, block_rows=block_rows, cells_per_task=cells_per_task)
    lines = collections.defaultdict(list)
    for r in sorted(repaired.collect(), key=lambda r: r.place):
        assert r.place == len(lines[r.conv_id])
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    got = {r.conv_id: r.asDict() for r in summary.collect()}
    assert got.keys() == by.keys()
    for conv, own in by.items():
        want, want_lines = model(own)
        assert {"conv_id": conv, **want} == got[conv] and want_lines == lines[conv]


def test_query_equals_model(spark, tmp_path):
    rows = conversations(4, 400) + [(70, 5, "user", "Gone.") for _ in range(1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r.asDict() for r in op12_conversation_repair(spark, str(tmp_path)).collect()}
    by = {r[0]: [] for r in rows}
    for r in damage(rows):
        by[r[0]].append(r)
    for conv, own in by.items():
        want, lines = model(own)
        assert got[conv] == {"conv_id": conv, **want, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    assert len(got) == len(by)


def test_very_many_copies_and_far_turns(spark):
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    far = spark.createDataFrame([(2, -2**63, "user", "a."), (2, 2**63 - 1, "assistant", "b.")], COLUMNS)
    summary, repaired = repair.repair(rows.unionByName(far), block_rows=1000)
    got = {r.conv_id: r for r in summary.collect()}
    assert got[1].duplicate == 29_999 and got[1].illegal == 29_999 and got[1].cost == 4 * 29_999 + 3
    assert got[1].audit == "K" + "D" * 29_999 + "I" and repaired.where("conv_id = 1").count() == 2
    assert got[2].gaps is None and got[2].audit == "KK"


def test_empty(spark):
    summary, repaired = repair.repair(spark.createDataFrame([], COLUMNS))
    assert summary.count() == 0 and repaired.count() == 0
