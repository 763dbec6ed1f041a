"""Registered queries: one Spark callable and (where SQL can state it) one
DuckDB oracle string per operator key.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole given tables.  Column names and types match the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validate as V
from . import oracle as O

from .registry import ORACLE, QUERIES, register, validated  # noqa: F401


# --------------------------------------------------------------------------
# flagship: documents -> lines -> rules -> clean -> tab check -> quality


def batch_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validated(spark, sf_dir)
    ci = lambda c: (F.col(c) > 0).cast("int")
    fixed = ci("n_control") + ci("n_non_latin") + ci("n_collapsed") + F.col("tab_fixed").cast("int")
    agg = v.groupBy("batch_id", "file_name").agg(
        F.count("*").alias("line_count"),
        F.sum(fixed).cast("long").alias("corrected_records"),
        F.sum(fixed).cast("int").alias("warning_count"),
        F.sum((F.col("tab_issue").isNotNull() & ~F.col("tab_fixed")).cast("int")).cast("int").alias("error_count"),
        F.max(F.coalesce(F.col("tab_severity") == "CRITICAL", F.lit(False))).alias("rejected"),
    )
    return agg.withColumn("data_quality_status", V.quality_status(
        "corrected_records", "warning_count", "error_count", failed="rejected"))


register("quality_status", f"""
WITH {O.base_ctes()}
SELECT batch_id, file_name, count(*) AS line_count,
  CAST(sum((n_control > 0)::INT + (n_non_latin > 0)::INT + (n_collapsed > 0)::INT + tab_fixed::INT) AS BIGINT) AS corrected_records,
  CAST(sum((n_control > 0)::INT + (n_non_latin > 0)::INT + (n_collapsed > 0)::INT + tab_fixed::INT) AS INTEGER) AS warning_count,
  CAST(sum((tab_issue IS NOT NULL AND NOT tab_fixed)::INT) AS INTEGER) AS error_count,
  bool_or(coalesce(tab_severity = 'CRITICAL', FALSE)) AS rejected,
  {O.quality_case('sum((n_control > 0)::INT + (n_non_latin > 0)::INT + (n_collapsed > 0)::INT + tab_fixed::INT)',
                  'sum((n_control > 0)::INT + (n_non_latin > 0)::INT + (n_collapsed > 0)::INT + tab_fixed::INT)',
                  'sum((tab_issue IS NOT NULL AND NOT tab_fixed)::INT)',
                  failed="bool_or(coalesce(tab_severity = 'CRITICAL', FALSE))")} AS data_quality_status
FROM v GROUP BY batch_id, file_name
""")(batch_quality_report)


# the other query families register themselves on import
from . import q_archives, q_ingest, q_lines, q_load, q_manifest, q_names, q_rules, q_sources  # noqa: E402,F401
