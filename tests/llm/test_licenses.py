"""License notices against exact containment by sets of words."""

import random
import re

from lineforge.llm import licenses as L


def normal(text):
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def found(spark, docs, templates=L.TEMPLATES):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS license", "1 AS t")
    return {(r.doc_id, r.license): r for r in L.scan(frame, templates).collect()}


def test_every_template_at_any_place(spark):
    rng = random.Random(1)
    fill = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    docs, want = [], {}
    for n, (name, text) in enumerate(L.TEMPLATES.items()):
        for k in range(9):
            lead = 7 * k + n
            docs.append((100 * n + k, f"{fill(lead)}\n{text.upper() if k % 2 else text}. {fill(rng.randint(0, 40))}"))
            want[100 * n + k, name] = lead
    got = found(spark, docs)
    assert {k for k in want if k not in got} == set()
    assert all(got[k].share == 1 and got[k].place == lead for k, lead in want.items())


def test_near_and_scattered(spark):
    text = L.TEMPLATES["MIT-permission"]
    words = text.split()
    almost = " ".join([*words[:20], "oddly", *words[21:]])  # 3 of about 50 shingles differ
    half = " ".join(words[: len(words) // 2])
    scattered = " ".join(" ".join(words[i:i + 3]) + " x" * 200 for i in range(0, len(words), 3))
    got = found(spark, [(1, almost), (2, half), (3, scattered), (4, None), (5, ""), (6, "MIT"), (None, text), (1, almost), (7, "y " * 30000 + text)])
    assert {k for k in got if k[1] == "MIT-permission"} == {(1, "MIT-permission"), (None, "MIT-permission"), (7, "MIT-permission")}
    assert 0.8 <= got[1, "MIT-permission"].share < 1


def test_empty_table_and_no_templates(spark):
    frame = spark.createDataFrame([(1, "All rights reserved")], "doc_id long, text string")
    assert L.scan(frame.limit(0)).count() == 0
    assert L.scan(frame, {"short": "a b"}).count() == 0


def test_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = found(spark, docs)
    want = {(d, n) for d, t in docs for n, x in L.TEMPLATES.items() if f" {' '.join(normal(x))} " in f" {' '.join(normal(t))} "}
    assert want <= set(got) and len(want) > 10


def test_one_shingle_templates_at_the_start(spark):
    """1,000 notices of three words, each the first, second .. eighth shingle of a text."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    templates = {f"n{i}": f"{word()} {word()} {word()}" for i in range(1000)}
    docs = [(i, " ".join([*(word() for _ in range(i % 8)), templates[f"n{i}"], *(word() for _ in range(30))])) for i in range(1000)]
    got = found(spark, docs, templates)
    assert sum((i, f"n{i}") in got for i in range(1000)) >= 999 and all(f"n{d}" == n for d, n in got)
