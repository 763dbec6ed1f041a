"""Issue reports: per-batch validation report and severity roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas


def validation_report(issues: DataFrame) -> DataFrame:
    """Per batch: total issues, auto-fixed, count per severity, first/last issue line.

    One partial aggregation; the per-line issue list stays in the issue table
    (read it with ``issues_by_batch``) instead of being collected per batch.
    """
    sev = [F.count_if(F.col("severity") == s).cast("long").alias(f"{s.lower()}_issues")
           for s in schemas.SEVERITIES]
    return issues.groupBy("batch_id").agg(
        F.count("*").alias("total_issues"),
        F.count_if(F.col("auto_fixed")).cast("long").alias("auto_fixed_count"),
        *sev,
        F.min("line_number").alias("first_issue_line"),
        F.max("line_number").alias("last_issue_line"),
    )


def severity_counts(issues: DataFrame) -> DataFrame:
    """Issues per batch and severity."""
    return issues.groupBy("batch_id", "severity").agg(F.count("*").alias("issue_count"))


def issues_by_batch(manifest: DataFrame, issues: DataFrame) -> DataFrame:
    """Manifest rows joined with their issues (ordered by line on read)."""
    return manifest.join(issues, "batch_id")


def filter_issues(issues: DataFrame, batch_id: str | None = None, severity: str | None = None) -> DataFrame:
    """Issues of one batch and/or one severity (both optional)."""
    out = issues
    if batch_id is not None:
        out = out.where(F.col("batch_id") == batch_id)
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    return out
