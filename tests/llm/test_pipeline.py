"""Each stage against a brute-force version, on its own input; the pipeline keeps clean documents."""

import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from lineforge.llm import pii
from lineforge.llm import quality_classifier as C

from test_jaccard_join import plain as components  # this folder is on the path of its tests

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_classifier", "jaccard_join", "decontamination", "pii", "packing"] and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    frames = []
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF), f"test-{name}")
        frames.append(docs)
    assert all(f.columns == COLUMNS for f in frames[:-1])
    good, single, clean, masked = ({r.doc_id: r for r in f.collect()} for f in frames[:-1])

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = C.train(source, spark.read.parquet(f"{SF}/labels.parquet"))
    hashes = C.Hashes()
    assert set(good) == {i for i, r in before.items() if model.score(C.features(r.text, hashes)) >= 0.3}
    known = [i for i in before if i in labels]
    assert sum((i in good) == (labels[i] == 1) for i in known) / len(known) > 0.93
    assert all(good[i] == before[i] for i in good)

    rows = [(i, r.text) for i, r in good.items()]
    assert set(single) == {int(d) for d, n, c in components(rows, 5, 80) if d == c}

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(single) - set(clean) == {i for i, r in single.items() if any(x in r.text for x in items)}

    assert set(masked) == set(clean)
    for i, r in masked.items():
        assert r.text == pii.masked(clean[i].text) and r.n_chars == len(r.text) and (r.lang, r.source) == (clean[i].lang, clean[i].source)
        assert not re.search(r"\S@mail\d\.example", r.text)

    plain = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    got, fill = {}, {}
    for r in frames[-1].collect():
        got.setdefault(r.doc_id, {})[r.start] = bytes(r.ids)
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert {i: zlib.crc32(b"".join(x[k] for k in sorted(x))) for i, x in got.items()} == {
        i: zlib.crc32(np.array(plain.encode(r.text, add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, r in masked.items()}
    assert all(n == 4096 for s, n in fill.items() if s != max(fill))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, SF), f"none-{name}")
        assert docs.count() == 0


def test_columns_of_any_name_pass_through(spark):
    """Nulls, empty, long and repeated texts, with extra columns named as the operators' own."""
    labelled = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    texts = [(None, None), (9001, None), (9002, ""), (9003, " \n"), (9004, "word " * 30_000), (9005, "same text of a few words"), (9005, "same text of a few words")]
    own = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS long) AS n_chars")
    extra = ["h", "hash", "_id", "_hash", "item_id", "part", "ids", "score", "kind", "place", "component_id", "n", "before", "text_hash"]
    docs = labelled.unionByName(own).selectExpr("*", *[f"concat('x', doc_id) AS {c}" for c in extra])
    for name, stage in P.STAGES[:-1]:
        was = {(r.doc_id, r.source): r for r in docs.collect()}
        docs = P.written(stage(spark, docs, SF), f"extra-{name}")
        assert docs.columns == COLUMNS + extra
        for r in docs.collect():
            assert all(r[c] == was[r.doc_id, r.source][c] for c in extra)
    assert P.STAGES[-1][1](spark, docs, SF).count() > 0
