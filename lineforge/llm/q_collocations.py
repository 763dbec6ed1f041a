"""op12_collocations: each language's 2000 best phrases of two or three words."""

from __future__ import annotations

from . import collocations as C
from .common import read
from .registry import register

SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, [x FOR x IN regexp_split_to_array(p, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
x AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM spots),
u AS (SELECT lang, w1, CAST(count(*) AS HUGEINT) AS f FROM x GROUP BY ALL),
b AS (SELECT lang, w1, w2, CAST(count(*) AS HUGEINT) AS f FROM x WHERE w2 IS NOT NULL GROUP BY ALL),
t AS (SELECT lang, w1, w2, w3, CAST(count(*) AS HUGEINT) AS f FROM x WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cover AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM t UNION ALL SELECT lang, w2, w3, f FROM t) GROUP BY lang, w1, w2),
two AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, p.f AS l, q.f AS r, 1000000 * b.f * b.f // (p.f * q.f) AS score
  FROM b JOIN u p ON p.lang = b.lang AND p.w1 = b.w1 JOIN u q ON q.lang = b.lang AND q.w1 = b.w2
  LEFT JOIN cover c ON c.lang = b.lang AND c.w1 = b.w1 AND c.w2 = b.w2 WHERE b.f >= 10 AND (c.f IS NULL OR 100 * c.f < 50 * b.f)),
cuts AS (SELECT t.*, p.f AS l1, q.f AS r1, m.f AS l2, n.f AS r2, 1000000 * t.f * t.f // (p.f * q.f) AS s1, 1000000 * t.f * t.f // (m.f * n.f) AS s2
  FROM t JOIN u p ON p.lang = t.lang AND p.w1 = t.w1 JOIN b q ON q.lang = t.lang AND q.w1 = t.w2 AND q.w2 = t.w3
  JOIN b m ON m.lang = t.lang AND m.w1 = t.w1 AND m.w2 = t.w2 JOIN u n ON n.lang = t.lang AND n.w1 = t.w3),
found AS (SELECT * FROM two UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, f, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found)
SELECT k.lang, k.rank, k.phrase, CAST(k.a AS BIGINT) AS a, CAST(k.l AS BIGINT) AS l, CAST(k.r AS BIGINT) AS r,
  (SELECT CAST(sum(f) AS BIGINT) FROM u WHERE u.lang = k.lang) AS n, CAST(k.score AS BIGINT) AS score
FROM ranked k WHERE k.rank <= 2000
"""


@register("op12_collocations", SQL)
def op12_collocations(spark, sf_dir):
    return C.mine(read(spark, sf_dir, "documents"))
