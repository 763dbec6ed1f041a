"""Conversation repair against a brute-force search over edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from lineforge.llm import conversation_repair as C
from lineforge.llm import q_conversation_repair as Q

GRAMMAR = {"": "su", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def search(initials, faults):
    """Least (cost, audit) by trying every edit at every place; the grammar is an automaton here."""
    @lru_cache(None)
    def best(i, last, inserted):
        options = []
        if i == len(initials) and last in ("", "a"):
            options.append((0, ""))
        if i < len(initials):
            c, a = best(i + 1, last, 0)
            options.append((4 + c, "D" + a))
            if faults[i] not in (C.BLANK, C.DUPLICATE):
                torn = 3 * (faults[i] == C.TRUNCATED)
                for to in GRAMMAR[last]:
                    if initials[i] == to:
                        c, a = best(i + 1, to, 0)
                        options.append((torn + c, "K" + a))
                    elif to != "s":
                        c, a = best(i + 1, to, 0)
                        options.append((torn + 3 + c, "R" + a))
        if inserted < 2:
            to = GRAMMAR[last][-1]
            c, a = best(i, to, inserted + 1)
            options.append((3 + c, "I" + a))
        return min(options, default=(10**9, ""))
    return best(0, "", 0)


@pytest.mark.parametrize("block", [2, 256])
def test_alignment_against_search(monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(3000):
        n = rng.randint(0, 9)
        roles = [rng.choice("suuaaaxu ") for _ in range(n)]
        faults = bytes(rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n))
        cost, audit, _, _ = C.Alignment(roles, faults).best()
        assert (cost, audit.decode()) == search("".join(roles), faults), (roles, faults)


def test_long_conversations():
    import sys
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        rng = random.Random(5)
        for n in (300, 700, 1200):
            roles = [("ua"[k % 2] if rng.random() < .8 else rng.choice("sua")) for k in range(n)]
            faults = bytes(rng.choice([0] * 12 + [1, 2, 3]) for _ in range(n))
            cost, audit, _, _ = C.Alignment(roles, faults).best()
            assert (cost, audit.decode()) == search("".join(roles), faults)
    finally:
        sys.setrecursionlimit(limit)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    result = {}
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in left if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            end = text.rstrip("\t\n\x0b\x0c\r ")
            faults.append(C.BLANK if not end else C.DUPLICATE if (role, text) in seen else C.TRUNCATED if end[-1] not in ".!?" else C.GOOD)
            seen.add((role, text))
        initials = "".join(r[2][:1] or "-" for r in own)
        cost, audit = search(initials, bytes(faults))
        kept = len(audit) - audit.count("D")
        roles, texts, i = ["s"] * (kept % 2) + ["u", "a"] * (kept // 2), [], 0
        for e in audit:
            if e != "D":
                to = roles[len(texts)]
                texts.append(":".join([own[i][2], own[i][3]] if e == "K" else [FULL[to], "" if e == "I" else own[i][3]]))
            i += e != "I"
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        result[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit,
                        hashlib.sha256("\n".join(texts).encode()).hexdigest(), texts)
    return result


def made(seed, conversations=120):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "well", "", " \t\n", "é" * 3000 + ".", "Same."]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), rng.choice(["user", "assistant", "system", None, "tool", ""]) if rng.random() < .3
                         else ["user", "assistant"][turn % 2], rng.choice([*texts, None, f"Words {rng.random()}."])))
    return rows + [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hi."), (None, None, None, None)] + rows[:20]


def test_query_against_brute_force(spark, tmpdir_path):
    rows = made(3)
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, phase int, digest string") \
        .repartition(5).write.parquet(f"{tmpdir_path}/conversations.parquet")
    got = Q.op13_conversation_repair(spark, tmpdir_path).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id][:-1], r.conv_id


def test_given_table(spark):
    import pyarrow.parquet as pq
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    got = {r.conv_id: tuple(r)[1:] for r in Q.op13_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: v[:-1] for k, v in expected(rows).items()}


def test_repaired_turns(spark):
    rows = made(4, 60)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in C.repaired(Q.damaged(turns)).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got == {k: v[-1] for k, v in expected(rows).items() if v[-1]}
    for lines in got.values():
        assert re.fullmatch("s?(ua)+", "".join(x[0] for x in lines))


def test_conversations_without_rows_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert C.audits(empty).collect() == [] and C.repaired(empty).collect() == []
    one = C.audits(empty, spark.createDataFrame([(7,), (7,)], "conv_id long")).collect()
    assert [tuple(r) for r in one] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
