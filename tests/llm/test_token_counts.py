"""Trie counts against every segmentation of short words and a plain Viterbi of long ones."""

import random

import public_tokenizers

from lineforge.llm import token_counts as K

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(word, pieces, byte):
    """(score, -tokens) by dynamic programming over one word alone."""
    text = K.MARK + word
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        width = len(text[end - 1].encode())
        options = [(best[end - 1][0] + width * byte, best[end - 1][1] - width)]
        options += [(best[b][0] + pieces[text[b:end]], best[b][1] - 1) for b in range(end) if text[b:end] in pieces]
        best[end] = max(options)
    return best[-1]


def every(text, pieces, byte):
    if not text:
        return [(0.0, 0)]
    out = [(s + len(text[0].encode()) * byte, n - len(text[0].encode())) for s, n in every(text[1:], pieces, byte)]
    for k in range(1, len(text) + 1):
        if text[:k] in pieces:
            out += [(s + pieces[text[:k]], n - 1) for s, n in every(text[k:], pieces, byte)]
    return out


def test_small_vocabulary_against_all_segmentations():
    pieces = {K.MARK: -1.0, "a": -2.0, "b": -2.5, "ab": -3.0, "ba": -4.4, K.MARK + "ab": -3.5, "aba": -5.0}
    trie = K.Trie(pieces)
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("abé") for _ in range(rng.randint(1, 7)))
        at = trie.node(word)
        want = max((round(s, 9), n) for s, n in every(K.MARK + word, pieces, trie.byte))
        assert (round(trie.score[at], 9), -trie.count[at]) == want


def test_public_vocabulary_and_restarts(monkeypatch):
    pieces = K.vocabulary(PATH)
    assert len(pieces) > 31_000 and abs(sum(map(K.math.exp, pieces.values())) - 1) < 1e-6
    trie = K.Trie(pieces)
    monkeypatch.setattr(K, "MAX_NODES", 60)
    small = K.Trie(pieces)
    words = "the them theme themes Über 日本語 🙂 naïve xqzzkj 12345 l'été don't".split() + ["ab" * 500]
    for word in words * 2:
        a, b = trie.node(word), small.node(word)
        s, n = plain(word, pieces, trie.byte)
        assert abs(trie.score[a] - s) < 1e-6 and trie.count[a] == -n
        assert (small.count[b], small.bytes[b]) == (trie.count[a], trie.bytes[a])


def test_rows(spark):
    docs = spark.createDataFrame([(1, "the them"), (1, "the them"), (2, None), (3, ""), (None, "a\n b")],
                                 "doc_id long, text string").selectExpr("*", "'x' AS n_tokens")
    got = K.count_tokens(docs, PATH).collect()
    by = {(r.doc_id, r.n_words): r.n_tokens for r in got}
    assert len(got) == 5 and by[2, 0] == 0 == by[3, 0] and by[1, 2] == 2 and by[None, 2] >= 2
    assert K.count_tokens(docs.limit(0), PATH).count() == 0
