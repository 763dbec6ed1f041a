"""op8_jaccard_join: components of documents whose four-word shingles overlap by 85 per cent."""

from __future__ import annotations

from . import jaccard_join as J
from .common import read
from .registry import register

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
        ELSE list_distinct([w[i:i + 3] FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
g AS (SELECT doc_id, hash(unnest(s)) AS g, len(s) AS n FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = s.doc_id
"""


@register("op8_jaccard_join", SQL)
def op8_jaccard_join(spark, sf_dir):
    return J.join_components(read(spark, sf_dir, "documents"))
