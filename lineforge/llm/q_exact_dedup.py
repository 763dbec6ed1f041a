"""op11_exact_dedup: groups of documents of identical text."""

from __future__ import annotations

from . import exact_dedup as E
from .common import read
from .registry import register

SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@register("op11_exact_dedup", SQL)
def op11_exact_dedup(spark, sf_dir):
    return E.groups(read(spark, sf_dir, "documents"))
