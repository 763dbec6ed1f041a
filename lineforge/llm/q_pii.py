"""op1_pii: personal data in every document."""

from __future__ import annotations

import hashlib

from . import pii
from .common import map_rows, no_nulls, read
from .registry import register

SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, "
          "base_sha256 string, spans string, scores string")


def digest(doc_id, text):
    found = pii.find_spans(no_nulls(text))
    base = [s for s in found if s[1] < pii.N_BASE]
    counts = [sum(s[1] == n for s in base) for n in range(pii.N_BASE)]
    yield (doc_id, *counts, len(found) - len(base), hashlib.sha256(pii.joined(base).encode()).hexdigest(),
           pii.joined(found), ",".join(f"{s[3]:.2f}" for s in found))


@register("op1_pii")
def op1_pii(spark, sf_dir):
    return map_rows(read(spark, sf_dir, "documents"), ["doc_id", "text"], SCHEMA, digest)
