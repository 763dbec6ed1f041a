"""Exact duplicates against a dictionary of texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lineforge.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, h long, kept string, bucket int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, 7, "x", 3) for r in rows], SCHEMA)


def expected(rows, normal=lambda t: t or ""):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, sha))
            first = first and i != keep
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ROWS = ([(i, f"text {i % 40}") for i in range(200)]
        + [(300, None), (301, ""), (302, None), (303, " "), (None, "text 3"), (None, "alone"), (None, "none"), (None, "none"),
           (400, "twice"), (400, "twice"), (401, "twice"), (401, "twice"), (402, "é" * 300_000), (403, "é" * 300_000), (404, "é" * 299_999)]
        + [(1000 + i, "hot") for i in range(400)])


@pytest.mark.parametrize("capacity", [E.CAPACITY, 4, 1])
def test_against_a_dictionary(spark, capacity):
    assert got(E.groups(frame(spark, ROWS), capacity=capacity)) == expected(ROWS)


def test_one_of_equal_rows_stays(spark):
    kept = [r.doc_id for r in E.groups(frame(spark, [(5, "a"), (5, "a"), (5, "a"), (None, "b"), (None, "b")])).where("kept").collect()]
    assert sorted(kept, key=str) == [5, None]


def test_empty_table_and_normalised_text(spark):
    assert E.groups(frame(spark, [])).collect() == []
    rows = [(1, "A b"), (2, "a B"), (3, "a  b")]
    assert got(E.groups(frame(spark, rows), F.lower("text"))) == expected(rows, lambda t: (t or "").lower())


def test_buckets_fit_and_cover_all_slots(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    slots, depth = E.directory(keys, 100)
    rows = slots.collect()
    assert sorted(r.slot for r in rows) == list(range(1 << depth))
    assert max(r.n for r in rows) <= 100 and sum({r.bucket: r.n for r in rows}.values()) == 3000
    sizes = {r.bucket: r.n for r in keys.join(slots, E.leading("h", depth) == F.col("slot")).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert sizes == {r.bucket: r.n for r in rows}
    parents = {}
    for r in rows:
        parents.setdefault((r.depth, r.bucket >> (depth - r.depth) >> 1), set()).add((r.bucket, r.n))
    assert all(len(pair) == 1 or sum(n for _, n in pair) > 100 for pair in parents.values())  # no split without need


def test_chains_of_equal_keys(spark, monkeypatch):
    """Keys cut to two bits: many texts share a key and only their bytes tell them apart."""
    real = F.xxhash64
    monkeypatch.setattr(E.F, "xxhash64", lambda *c: F.shiftleft(F.shiftrightunsigned(real(*c), 62), 62))
    rows = [(i, f"t{i % 30}") for i in range(90)]
    assert got(E.groups(frame(spark, rows))) == expected(rows)


def test_bitmap_has_no_false_negative(spark):
    entries = spark.range(2000).select(F.xxhash64("id").alias("h"), (F.col("id") % 2 + 1).alias("n"))
    docs = entries.withColumn("text", F.lit("x"))
    kept = E.maybe_met_twice(docs, E.keys_met_twice(entries))
    assert kept.where("n = 2").count() == 1000 and kept.where("n = 1").count() < 5
