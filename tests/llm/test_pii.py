"""Personal data against the contract's expressions run as they stand."""

import hashlib
import random
import re

from lineforge.llm import pii
from lineforge.llm.q_pii import SCHEMA, digest
from lineforge.llm.common import map_rows

SHAPES = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def plain(text):
    out = []
    for place, (kind, shape) in enumerate(SHAPES):
        for m in re.finditer(shape, text):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and max(map(int, m.group().split("."))) <= 255 if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def base(text):
    return [x for x in pii.joined(pii.find_spans(text)).split(",") if x.split(":")[0] in pii.KINDS[:4]] if text else []


def test_random_texts_match_the_expressions():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "@x.y", ".", "1", "12.3", "255.1", "256.", "4111 1111 1111 1111", "-", " ", "+1 (2", "34) 555-1234", "é", "\n", "+", "%", "0.0.0.0", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base(text) == plain(text), text


def test_added_kinds_need_checksum_or_context():
    assert "iban:3:30" in pii.joined(pii.find_spans("to GB82 WEST 1234 5698 7654 32, now"))
    assert not pii.find_spans("to GB83 WEST 1234 5698 7654 32, now")
    assert pii.joined(pii.find_spans("SSN 123-45-6789")) == "ssn:4:15"
    assert not pii.find_spans("part 123-45-6789")
    assert pii.joined(pii.find_spans("password=e3b3ed3cc8548923d6")) == "secret:9:27"
    assert not pii.find_spans("build e3b3ed3cc8548923d6")
    assert pii.joined(pii.find_spans("call 555-123-4567")) == "local_phone:5:17"


def test_long_runs_are_linear():
    for unit in ("a", "1", "1.", "+1", " ", "a@", "1-", "@a."):
        pii.find_spans(unit * 200_000)


def test_masking():
    assert pii.masked("mail a.b@c.de or 10.0.0.1!") == "mail <EMAIL> or <IP>!"


def test_query_rows(spark):
    rows = [(1, "mail a.b@c.de", "x"), (1, "mail a.b@c.de", "x"), (2, None, "y"), (3, "", None), (None, "10.0.0.1", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [r.asDict() for r in map_rows(docs, ["doc_id", "text"], SCHEMA, digest).collect()]
    assert len(got) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["base_sha256"] == empty and r["spans"] == "" for r in got if r["doc_id"] in (2, 3))
    assert [r["n_ip"] for r in got if r["doc_id"] is None] == [1]
    assert [r["base_sha256"] for r in got if r["doc_id"] == 1] == [hashlib.sha256(b"email:5:13").hexdigest()] * 2
    assert map_rows(docs.limit(0), ["doc_id", "text"], SCHEMA, digest).count() == 0
    spans = pii.pii_spans(docs).collect()
    assert {(s.doc_id, s.kind, s.value) for s in spans} == {(1, "email", "a.b@c.de"), (None, "ip", "10.0.0.1")}
    out = {(r.doc_id, r.text, r.spans) for r in pii.redact(docs).collect()}
    assert out == {(1, "mail <EMAIL>", "x"), (2, None, "y"), (3, "", None), (None, "<IP>", "z")}
