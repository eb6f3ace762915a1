"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mailsift.llm import conversations, queries

DDL = "conv_id long, turn long, role string, text string, ord string, start int, codes string"
BODY = re.compile(r"[^\x20\x09-\x0D]")


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 0, "y") for r in rows], DDL).repartition(3)


def in_order(rows):
    def key(r):
        return (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())

    return sorted([(t, " " if role is None else role, " " if x is None else x) for t, role, x in rows], key=key)


def plain(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines of one conversation."""
    rows = in_order(rows)
    turns = {t for t, _, _ in rows if t is not None}
    seen, faults = set(), []
    for _, role, text in rows:
        marks = BODY.findall(text)
        if not marks:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    # Rows written so far may end in nothing, s, u or a; the least (cost, audit) of each ending is kept.
    best = {"": (0, "", [])}

    def offer(into, end, value):
        if end not in into or value[:2] < into[end][:2]:
            into[end] = value

    def follows(end, initial):
        return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[end]

    def with_inserts(best):
        for _ in range(3):
            more = dict(best)
            for end, (cost, audit, out) in best.items():
                for role in ("user", "assistant"):
                    if follows(end, role[0]):
                        offer(more, role[0], (cost + 2, audit + "I", [*out, role + ":"]))
            best = more
        return best

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for end, (cost, audit, out) in with_inserts(best).items():
            offer(after, end, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cost += fault == "truncated"
            if role and follows(end, role[0]):
                offer(after, role[0], (cost, audit + "K", [*out, f"{role}:{text}"]))
            for new in ("user", "assistant"):
                if follows(end, new[0]):
                    offer(after, new[0], (cost + 2, audit + "R", [*out, f"{new}:{text}"]))
        best = after
    final = with_inserts(best)
    cost, audit, out = min((final[e] for e in ("", "a") if e in final), key=lambda v: v[:2])
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, out


def made(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", " \n", "", "a b!", "end.  \n", None]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in range(n):
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            text = rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}{rng.choice(['.', ''])}"
            rows.append((conv or None, rng.choice([None, *range(12)]), rng.choice(roles), text))
    return rows


def by_conversation(rows):
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(tuple(rest))
    return groups


def lines_of(found):
    rows = found.conversations().orderBy("conv_id", "ord", "slot").collect()
    out = {}
    for r in rows:
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    return out


# Blocks of one, four and very many rows: the same results.
@pytest.mark.parametrize("bits", [0, 2, conversations.BLOCK_BITS])
def test_equals_the_plain_search(spark, bits):
    rows = made(bits, 60)
    found = conversations.repair(table(spark, rows), block_bits=bits)
    report = {r.conv_id: r for r in found.report().collect()}
    lines = lines_of(found)
    hashed = {r.conv_id: r.sha256 for r in conversations.digests(found.conversations(), F.concat("role", F.lit(":"), "text")).collect()}
    groups = by_conversation(rows)
    assert set(report) == set(groups)
    for conv, group in groups.items():
        r, want = report[conv], plain(group)
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[:-1], conv
        assert lines.get(conv, []) == want[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in want[-1]))
        if want[-1]:
            assert hashed[conv] == hashlib.sha256("\n".join(want[-1]).encode()).hexdigest()
        else:
            assert conv not in hashed


def test_one_long_conversation_lies_in_many_blocks(spark):
    rng = random.Random(5)
    rows = [(7, i // 2, rng.choice(["user", "user", "assistant"]), f"t{i}.") for i in range(3000)]
    rows += [(7, 10_000, "user", "same!")] * 1500 + [(8, 0, "user", "Hi.")]
    found = conversations.repair(table(spark, rows), block_bits=5)
    assert found.blocks.filter("conv_id = 7").count() > 100
    report = {r.conv_id: r for r in found.report().collect()}
    want = plain(by_conversation(rows)[7])
    assert (report[7].duplicate, report[7].cost, report[7].audit) == (1499, want[5], want[6])
    assert lines_of(found)[7] == want[-1]
    assert (report[8].cost, report[8].audit) == (2, "KI")


def test_long_runs_by_powers():
    for code in "0159":
        for n in (1, 2, 7, 300):
            step = conversations.UNIT
            for _ in range(n):
                step = conversations._times(step, conversations._power(code, 0))
            assert step == conversations._run(code, n)


def test_very_long_and_spaced_texts(spark):
    rows = [(1, 0, "user", "a. " * 100_000), (1, 1, "assistant", "b" * 200_000 + "\n" * 1000)]
    r = conversations.repair(table(spark, rows)).report().first()
    assert (r.truncated, r.cost, r.audit) == (1, 1, "KK")


def test_empty_table(spark):
    found = conversations.repair(table(spark, []))
    assert found.report().count() == 0 and found.conversations().count() == 0


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    import zlib

    rows = made(1, 40)
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    table(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    hurt = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        hurt += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    groups = by_conversation(hurt)
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        want = plain(groups[conv]) if conv in groups else (0, 0, 0, 0, 0, 0, "", [])
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[:-1]
        assert r.repaired_sha256 == hashlib.sha256("\n".join(want[-1]).encode()).hexdigest()
    assert dropped not in groups
