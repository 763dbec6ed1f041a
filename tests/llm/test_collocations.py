"""Phrase collocations against counts of every phrase on its own."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lineforge.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, size int, w1 string, c long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, text, lang, 1, "x", 2) for i, (text, lang) in enumerate(rows)], SCHEMA)


def expected(rows, top, least, order=3, cover=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, order + 1):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        phrases = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in phrases.items():
            inside = lambda q: any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and inside(q) and 100 * b >= cover * a for q, b in phrases.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((" ".join(p), a, left, right, n[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(found[:top])]
    return sorted(out)


def corpus(seed, docs=150):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "é", "été", " x", "a\x1cb", "\x00", "don't", "co-op", "日本", "z" * 40]
    rows = []
    for _ in range(docs):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts += rng.choice([["new", "York", "City"], ["of", "the"], [rng.choice(words)], [rng.choice(words)]])
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "\x0b"]))
            parts.append(" ")
        rows.append((" ".join(parts), rng.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \t ", "fr"), ("one", "it"), rows[0], rows[0]]


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("common", [4096, 20])
@pytest.mark.parametrize("seed,top,least,order", [(1, 2000, 10, 3), (2, 5, 3, 3), (3, 50, 2, 4), (4, 9, 1, 2)])
def test_against_separate_counts(spark, monkeypatch, common, seed, top, least, order):
    monkeypatch.setattr(C, "COMMON", common)
    rows = corpus(seed)
    assert got(C.mine(frame(spark, rows), top, least, order)) == expected(rows, top, least, order)


def test_long_text_in_parts_and_small_flushes(spark, monkeypatch):
    rows = corpus(5, 60)
    rows.append((". ".join(t for t, _ in rows if t), "en"))
    want = expected(rows, 100, 5)
    assert got(C.mine(frame(spark, rows), 100, 5)) == want
    monkeypatch.setattr(C, "BYTES_AT_ONCE", 50)
    whole = [w for part in C.words_of(rows[-1][0]) for w in part]
    monkeypatch.setattr(C, "BYTES_AT_ONCE", 1 << 23)
    assert whole == [w for part in C.words_of(rows[-1][0]) for w in part]


def test_empty_table(spark):
    assert C.mine(frame(spark, [])).collect() == []


def test_clashing_hashes_take_another_seed(spark, monkeypatch):
    words = spark.createDataFrame([("en", w, 1) for w in ("a", "b")] + [("de", "a", 1)], "lang string, word string, n long")
    real = C.hash_of
    assert C.hashed(words)[1] == 0
    monkeypatch.setattr(C, "hash_of", lambda w, seed: 5 if seed < 2 else real(w, seed))
    # workers import the module anew, so the clash is made with a word list that holds one word twice
    twice = words.union(spark.createDataFrame([("en", "a", 1)], words.schema))
    monkeypatch.setattr(C, "SEEDS", 2)
    with pytest.raises(RuntimeError):
        C.hashed(twice)


def test_score_is_exact_beyond_64_bits(spark):
    rows = [(10**13, 10**13 + 1, 10**13 + 3), (3, 7, 11), (10**15, 10**15, 10**15), (123456789012, 987654321098, 555555555555)]
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", C.score_of(F.col("a"), F.col("l"), F.col("r")))
    assert [r.s for r in df.collect()] == [1000000 * a * a // (b * c) for a, b, c in rows]
