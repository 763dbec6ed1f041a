"""Statistics by brute force, learned lists and the classifier on held-out rows."""

import random
import re

import numpy as np
import pytest

from lineforge.llm import quality_classifier as C
from lineforge.llm import quality_rules as Q
from lineforge.llm.q_quality_classifier import op10_quality_classifier
from lineforge.llm.q_quality_rules import op5_quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    words = re.findall(WORD, text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_statistics_match_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["a ", "b ", "a ", "é ", "c\n", "\n", "#| ", "\x1c", "\t", "dd\r"]) for _ in range(rng.randint(0, 60)))
        assert Q.text_stats(text)[:5] == plain(text), repr(text)
    line = " ".join(f"w{i % 23}" for i in range(200))
    assert Q.text_stats(line)[:5] == plain(line)
    assert Q.text_stats("")[:5] == (0, 0, 0, 0, 0)


def test_rules_find_planted_thresholds():
    rng = np.random.default_rng(1)
    x = rng.random((900, len(Q.FEATURES)))
    quality = np.where((x[:, 0] > 0.7) | (x[:, 3] > 0.8) & (x[:, 4] < 0.5), 0, 1)
    rules = Q.fit_rules(x, quality)
    names = list(Q.FEATURES)
    hit = np.zeros(900, bool)
    for rule in rules:
        hit |= Q.covers([(names.index(c.feature), c.above, c.threshold) for c in rule], x)
    assert (hit == (quality == 0)).mean() > 0.97
    assert Q.fit_rules(x, np.ones(900, int)) == [] == Q.fit_rules(x[:0], quality[:0])


def test_rules_query(spark):
    rows = op5_quality_rules(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    seen = [r for r in rows if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in seen if labels[r.doc_id] == 1]
    bad = [r.kept for r in seen if labels[r.doc_id] == 0]
    assert len(rows) == 1000 and sum(good) / len(good) > 0.99 and sum(bad) / max(len(bad), 1) < 0.2
    assert all(not r.kept for r in rows if r.base_failed)


def test_statistics_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (3, "")], "doc_id long, text string").selectExpr("*", "5 AS n_words", "'x' AS kept")
    got = sorted((str(r.doc_id), r.n_words) for r in Q.document_stats(docs).collect())
    assert got == [("1", 0), ("1", 0), ("3", 0), ("None", 2)]
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert Q.learn_rules(Q.document_stats(docs), labels) == []
    assert Q.document_stats(docs.limit(0)).count() == 0


def test_classifier_on_held_out_rows(spark):
    rows = op10_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_features_are_indicators():
    h = C.Hashes()
    once, twice = C.features("ab cd ef", h), C.features("ab cd ef ab cd ef", h)
    assert set(once) - {*C.features("ab cd ef", C.Hashes())} == set() and len(set(twice)) == len(twice)
    assert len(C.features("", h)) > 0
    assert C.shape("Hello") == "a" and C.shape("IT!!") == "A!!" and C.shape("a12,") == "a0,"


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_one_class_or_no_labels(spark, marks):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None), (None, "x")], "doc_id long, text string").selectExpr("*", "0.5 AS score")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = C.train(docs, labels)
    got = C.scores(docs, model).collect()
    assert len(got) == 4 and len({r.score for r in got}) == 1 and 0 < got[0].score < 1
    kept = C.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 4
    assert C.scores(docs.limit(0), model).count() == 0


def sample(seed, n=60):
    rng = np.random.default_rng(seed)
    texts = [np.unique(rng.integers(0, 40, rng.integers(3, 12))).astype(np.int32) * 7 for _ in range(n)]
    good = np.array([(7 * 3 in x) ^ (rng.random() < 0.15) for x in texts])
    return texts, good


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ratios_recomputed(seed):
    texts, good = sample(seed)
    r = C.ratios(texts, good)
    count = {True: {}, False: {}}
    for x, y in zip(texts, good):
        for k in x.tolist():
            count[bool(y)][k] = count[bool(y)].get(k, 0) + 1
    total = {y: sum(count[y].values()) + C.SMOOTHING * C.BUCKETS for y in count}
    for k in {0, 5, 7, 21, 40 * 7, *count[True], *count[False]}:
        p, q = ((count[y].get(k, 0) + C.SMOOTHING) / total[y] for y in (True, False))
        assert abs(r[k] - np.log(p / q)) < 1e-9


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_descent_reaches_the_least_loss(seed):
    """The hinge-loss objective against projected gradient steps on the dual with a dense kernel."""
    texts, good = sample(seed)
    r = C.ratios(texts, good)
    w, b = C.descend(texts, good, r)
    y = np.where(good, 1.0, -1.0)
    cost = C.COST * np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    x = np.zeros((len(texts), C.BUCKETS // 64))
    for n, t in enumerate(texts):
        x[n, t] = r[t] / np.sqrt((r[t] ** 2).sum())
    kernel = (x @ x.T + 1) * np.outer(y, y)
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(kernel)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha + step * (1 - kernel @ alpha), 0, cost)
    least = alpha.sum() - alpha @ kernel @ alpha / 2      # the dual's value bounds the objective from below
    margin = y * (x @ w[:x.shape[1]] + b)
    loss = (w @ w + b * b) / 2 + (cost * np.maximum(0, 1 - margin)).sum()
    assert least * (1 - 1e-6) <= loss <= least * 1.01
