"""Packing against whole-text tokenisation: every id in one piece, windows full and gapless."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lineforge.llm import packing as P
from lineforge.llm.q_packing import digest

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, window):
    plain = Tokenizer.from_file(PATH)
    want = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in docs}
    parts, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids.tobytes())
    for i, ids in want.items():
        at = 0
        for r in sorted(parts[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    assert sorted(fill) == list(range(len(fill)))
    for s, spans in fill.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at == window or s == max(fill) and at <= window


def test_awkward_texts(spark):
    texts = ["", None, "a", "It's 10,5 km or\x1cso\x85\t!", "é ́x  \n\n y", "ΣΑΣ Σ", "<|endoftext|> x<|startoftext|>",
             "日本語 テキスト", "x" * 5000, "word " * 3000, "🙂🙂 don't WE'LL"]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "y").selectExpr("*", "1 AS ids", "2 AS part")
    for window in (8, 64, 4096):
        check(digest(P.pack(frame.repartition(3), PATH, window)).collect(), docs, window)
    assert P.pack(frame.limit(0), PATH).count() == 0


def test_given_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    check(digest(P.pack(frame.repartition(5), PATH)).collect(), docs, 4096)


def test_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 3)
    docs = [(i, "ab cd " * (i % 7)) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(23)
    check(digest(P.pack(frame, PATH, 16)).collect(), docs, 16)


def test_repeated_rows_are_packed_each(spark):
    frame = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "d")], "doc_id long, text string")
    rows = P.pack(frame, PATH, 4).collect()
    assert sum(r.length for r in rows) == 3 * 4 + 2
    assert {r.doc_id for r in rows} == {1, None}


def test_words_cut_here_have_the_tokenizers_ids():
    plain, words = Tokenizer.from_file(PATH), P.WordIds(PATH)
    assert words.cut is not None
    import itertools
    import random
    rng = random.Random(4)
    texts = ["".join(x) for x in itertools.product("aZ9'.é<|s ", repeat=4)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 127), rng.randint(128, 0x2FFF)])) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(words.of(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
