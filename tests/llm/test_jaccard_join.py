"""Components against all pairs."""

import random

import pytest

from lineforge.llm import jaccard_join as J
from lineforge.llm.components import components


def grams(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def plain(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[top(i)] = top(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[top(i)] = min(names.get(top(i), d), d)
    return sorted((str(d), len(sets[i]), str(names.get(top(i), d) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def rows_of(rng, n):
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        body = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            if body:
                body[rng.randrange(len(body))] = rng.choice(words)
        if rng.random() < 0.4:
            body += passage
        rows.append((i, " ".join(body)))
    return rows


@pytest.mark.parametrize("seed,k,percent", [(1, 4, 85), (2, 5, 80), (3, 4, 60)])
def test_random_near_copies(spark, seed, k, percent, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(J, "BROADCAST_CLASSES", 0)
    rng = random.Random(seed)
    rows = rows_of(rng, 150)
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "b a"), (None, rows[0][1]), (905, rows[0][1].upper()), (7, rows[7][1]), (906, " ".join(["x"] * 5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS k1", "3 AS component_id").repartition(5)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.join_components(docs, k, percent).collect())
    assert got == plain(rows, k, percent)


def test_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (1, text), (1, text), (2, text + " more"), (5, "x y z a b c"), (6, None), (7, ""), (None, text), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS k1", "doc_id AS component_id")
    out = J.one_of_each(docs, 5, 80)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted([("1", text), ("5", rows[4][1]), ("6", "None"), ("7", ""), ("8", "None")])
    assert J.one_of_each(docs.limit(0)).count() == 0 == J.join_components(docs.limit(0)).count()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
