"""Queries over the validation-rule table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rules as R
from . import derived as D
from . import oracle as O
from .registry import register, validated

SEEDED, CHANGED = "TIMESTAMP '2024-01-01 00:00:00'", "TIMESTAMP '2024-06-30 12:00:00'"
RULES = f"WITH rules AS ({O.run_rules_sql()}), lines AS ({O.DOC_LINES})"


@register("rules_source", f"""{RULES},
c AS (SELECT file_pattern, count(*) AS line_count FROM lines GROUP BY file_pattern)
SELECT r.id, r.file_pattern, r.table_name, r.expected_tab_count, r.validation_enabled, r.auto_fix_enabled,
  r.reject_on_violation, r.transformer_class_name, {SEEDED} AS created_at, {SEEDED} AS updated_at, coalesce(c.line_count, 0) AS line_count
FROM rules r LEFT JOIN c USING (file_pattern)""")
def q_rules_source(spark, sf):
    r = D.run_rules(spark)
    c = D.doc_lines(spark, sf).groupBy("file_pattern").agg(F.count("*").alias("line_count"))
    j = r.join(c, "file_pattern", "left")
    return j.select("id", "file_pattern", "table_name", "expected_tab_count", "validation_enabled",
                    "auto_fix_enabled", "reject_on_violation", "transformer_class_name", "created_at", "updated_at",
                    F.coalesce("line_count", F.lit(0)).cast("long").alias("line_count"))


def _changed():
    return F.expr("TIMESTAMP_NTZ '2024-06-30 12:00:00'")


def _updates(spark, sf):
    d = D.doc_lines(spark, sf)
    seen = d.groupBy("file_pattern").agg(
        (F.max(tx.count_tabs("line")) % 20).cast("int").alias("expected_tab_count"))
    seen = seen.select("file_pattern", "expected_tab_count", F.lit(False).alias("auto_fix_enabled"))
    docs = D.table(spark, sf, "documents").select(
        F.concat(F.lit("DOC_"), F.upper("lang")).alias("file_pattern")).distinct()
    new = docs.select("file_pattern", F.lit(0).alias("expected_tab_count"), F.lit(True).alias("auto_fix_enabled"))
    return seen.unionByName(new)


@register("rule_upsert", f"""{RULES},
u AS (SELECT file_pattern, CAST(max(length(line) - length(replace(line, chr(9), ''))) % 20 AS INTEGER) AS expected_tab_count,
             FALSE AS auto_fix_enabled FROM lines GROUP BY file_pattern
      UNION ALL SELECT DISTINCT 'DOC_' || upper(lang), 0, TRUE FROM documents)
SELECT CAST(coalesce(r.id, (SELECT max(id) FROM rules) + row_number() OVER (PARTITION BY r.id IS NULL ORDER BY u.file_pattern)) AS BIGINT) AS id,
  coalesce(r.file_pattern, u.file_pattern) AS file_pattern, r.table_name,
  coalesce(u.expected_tab_count, r.expected_tab_count) AS expected_tab_count,
  coalesce(u.auto_fix_enabled, r.auto_fix_enabled) AS auto_fix_enabled, r.validation_enabled,
  CASE WHEN r.file_pattern IS NULL THEN 'inserted' WHEN u.file_pattern IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS action,
  CASE WHEN r.file_pattern IS NULL THEN {CHANGED} ELSE {SEEDED} END AS created_at,
  CASE WHEN u.file_pattern IS NOT NULL THEN {CHANGED} ELSE {SEEDED} END AS updated_at
FROM rules r FULL OUTER JOIN u ON r.file_pattern = u.file_pattern""")
def q_rule_upsert(spark, sf):
    out = R.rule_upsert(D.run_rules(spark), _updates(spark, sf), at=_changed())
    return out.select("id", "file_pattern", "table_name", "expected_tab_count", "auto_fix_enabled",
                      "validation_enabled", "action", "created_at", "updated_at")


@register("rule_toggle", f"""WITH {O.base_ctes()},
crit AS (SELECT DISTINCT file_pattern FROM v WHERE tab_severity = 'CRITICAL')
SELECT id, file_pattern, CASE WHEN file_pattern IN (SELECT file_pattern FROM crit) THEN FALSE ELSE validation_enabled END
  AS validation_enabled, CASE WHEN file_pattern IN (SELECT file_pattern FROM crit) THEN {CHANGED} ELSE {SEEDED} END AS updated_at
FROM rules""")
def q_rule_toggle(spark, sf):
    # a flag per pattern rather than a filter on a computed column, which would repeat the cleaning inside it
    critical = F.max(F.coalesce(F.col("tab_severity") == "CRITICAL", F.lit(False)))
    crit = validated(spark, sf).groupBy("file_pattern").agg(critical.alias("critical")).where("critical").select("file_pattern")
    return R.rule_toggle(D.run_rules(spark), crit, enabled=False, at=_changed()).select("id", "file_pattern", "validation_enabled", "updated_at")


@register("rule_delete", f"""{RULES}
SELECT id, file_pattern FROM rules WHERE file_pattern IN (SELECT DISTINCT file_pattern FROM lines)""")
def q_rule_delete(spark, sf):
    r = D.run_rules(spark)
    used = D.doc_lines(spark, sf).select("file_pattern").distinct()
    unused = r.join(used, "file_pattern", "left_anti").select("id")
    return R.rule_delete(r, unused).select("id", "file_pattern")
