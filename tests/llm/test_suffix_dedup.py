"""Removed bytes against a table of all strings."""

import random

import pytest

from lineforge.llm import suffix_dedup as S
from lineforge.llm.q_suffix_dedup import ROW, digest


def plain(rows):
    first = {}
    for i, t in rows:
        d = (t or "").encode()
        if i is not None:
            for k in range(len(d) - 49):
                first[d[k:k + 50]] = min(first.get(d[k:k + 50], i), i)
    out = []
    for i, t in rows:
        d = (t or "").encode()
        gone = bytearray(len(d))
        if i is not None:
            for k in range(len(d) - 49):
                if first[d[k:k + 50]] < i:
                    gone[k:k + 50] = b"\1" * 50
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, *digest(d, left, sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)))))
    return sorted(map(str, out))


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS spans", "'g' AS gone", "2 AS anchor").repartition(4)
    return sorted(str(tuple(r)) for r in S.dedup(docs, ROW, digest).collect())


def make(rng, n):
    words = ["th", "er", "on", "ing", "é", " ", "the ", "and ", "\n"]
    text = lambda k: "".join(rng.choice(words) for _ in range(k))
    shared = [text(rng.randint(20, 60)) for _ in range(4)]
    rows = []
    for _ in range(n):
        body = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            if rng.random() < 0.4:
                k = rng.randrange(len(s))
                s = s[:k] + rng.choice(["x", "", "yy"]) + s[k + 1:]
            body += [s, text(rng.randint(0, 30))]
        rows.append((rng.randint(0, 3 * n), "".join(body)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(S, "MANY", 3)  # strings of common anchors are grouped by Spark
    if seed == 2:
        monkeypatch.setattr(S, "BROADCAST_KEYS", 0)  # shuffle joins
        monkeypatch.setattr(S, "FILTER_ANCHORS", 0)
    rng = random.Random(seed)
    rows = make(rng, 60)
    rows += [(500, "a" * 400), (501, "a" * 333 + "b"), (502, "ab" * 120), (503, "ba" * 100), (504, "a" * 49), (505, "a" * 50),
             (506, None), (507, ""), (None, rows[0][1]), (508, rows[0][1]), (508, rows[0][1]), (2, rows[5][1]), (509, "short"), (510, "short")]
    assert got(spark, rows) == plain(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup(docs, ROW, digest).count() == 0


def test_intervals_hold_all_repeated_strings():
    rng = random.Random(9)
    for _ in range(200):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode() for _ in range(rng.randint(1, 6))]
        where = {}
        for c, p in enumerate(parts):
            for k in range(len(p) - 9):
                where.setdefault(p[k:k + 10], set()).add((c, k))
        interval, context, offset = S.equal_strings(parts, 10)
        found = {}
        for i, c, o in zip(interval.tolist(), context.tolist(), offset.tolist()):
            found.setdefault(i, set()).add((c, o))
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in where.values() if len(v) > 1)


def test_equal_strings_have_equal_anchors():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abc ") for _ in range(3000))
    anchor, at, size = S.runs(data)
    names = {}
    for a, s, n in zip(anchor.tolist(), at.tolist(), size.tolist()):
        for k in range(s, s + n):
            assert names.setdefault(data[k:k + 50], a) == a
    assert int(size.sum()) == len(data) - 49


def test_empty_table_with_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, anchor long, at int, size int, holder long, spans string")
    assert S.dedup(empty).count() == 0
