"""Rule-driven line validation: rule lookup, cleaning, tab check, issues,
quality metrics and the reject gate.

Input is a ``lines`` DataFrame ``(batch_id, file_name, file_pattern,
line_number, line, ...)``; everything here is a projection or a partial
aggregation, so a delivery with a third of all lines is spread over as many
tasks as its splits -- nothing is grouped into one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from .common import bounded_broadcast

RULE_FLAGS = (
    "validation_enabled", "auto_fix_enabled", "reject_on_violation", "replace_control_chars",
    "replace_non_latin_chars", "collapse_consecutive_replaced", "enable_data_transformation",
)


def rules_df(spark: SparkSession, seeds=schemas.RULE_SEEDS, overrides: dict | None = None, at: dt.datetime | None = None) -> DataFrame:
    """The rule table from seed tuples, with optional per-pattern field overrides; created and updated ``at`` (now, in UTC)."""
    at = at or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    names = ("file_pattern", "table_name", "expected_tab_count", "validation_enabled",
             "auto_fix_enabled", "reject_on_violation", "replace_control_chars",
             "replace_non_latin_chars", "collapse_consecutive_replaced",
             "enable_data_transformation", "transformer_class_name", "description")
    rows = []
    for i, seed in enumerate(seeds, start=1):
        rec = dict(zip(names, seed))
        rec.update((overrides or {}).get(rec["file_pattern"], {}))
        rows.append((i, rec["file_pattern"], rec["table_name"], rec["expected_tab_count"],
                     *[rec[f] for f in RULE_FLAGS], rec["transformer_class_name"],
                     rec["description"], at, at, "system"))
    return spark.createDataFrame(rows, schemas.RULE_SCHEMA)


def rule_join(lines: DataFrame, rules: DataFrame, key: str = "file_pattern") -> DataFrame:
    """``lines ⟕ rules`` on the file pattern; ``rule_found`` marks a match.

    The rule table holds one row per file pattern, so it is broadcast after
    a row-count check; a larger table falls back to a shuffle join.
    """
    r = rules.select(
        F.col("file_pattern").alias("_rule_pattern"), "expected_tab_count", *RULE_FLAGS,
        "transformer_class_name", F.lit(True).alias("rule_found"))
    r = bounded_broadcast(r)
    out = lines.join(r, lines[key] == r["_rule_pattern"], "left").drop("_rule_pattern")
    return out.withColumn("rule_found", F.coalesce(F.col("rule_found"), F.lit(False)))


def validate_lines(lines_with_rules: DataFrame) -> DataFrame:
    """Clean and tab-check every line under its rule.

    Adds: ``validated`` (rule present and enabled), ``cleaned``, the three
    cleaning counts, ``tab_count``, ``tab_issue`` (NULL / EXCESS_TABS /
    INSUFFICIENT_TABS), ``tab_severity``, ``tab_fixed`` and ``fixed_line``
    (the line handed on to transforms and loading).

    Each stage is its own projection: Catalyst keeps a stage separate when
    its (non-cheap) result is used several times, so generated code stays
    linear in the number of stages instead of inlining the chain repeatedly.
    """
    v = F.coalesce(F.col("rule_found") & F.col("validation_enabled"), F.lit(False))
    df = lines_with_rules.withColumn("validated", v)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) & F.col("validated")
    active = F.col("line").isNotNull() & (F.length("line") > 0)
    df = df.withColumn("_ctl", flag("replace_control_chars") & active) \
        .withColumn("_nl", flag("replace_non_latin_chars") & active) \
        .withColumn("_col", flag("collapse_consecutive_replaced") & active)
    # counts first; a replacement runs only on lines that have something to replace
    df = df.withColumn("n_control", F.when(F.col("_ctl"), tx.count_control_chars("line")).otherwise(F.lit(0)))
    df = df.withColumn("_s1", F.when(F.col("n_control") > 0, tx.replace_control_chars("line"))
                       .otherwise(F.col("line")))
    df = df.withColumn("n_non_latin", F.when(F.col("_nl"), tx.count_non_latin("_s1")).otherwise(F.lit(0)))
    df = df.withColumn("_s2", F.when(F.col("n_non_latin") > 0, tx.replace_non_latin("_s1"))
                       .otherwise(F.col("_s1")))
    do_collapse = F.col("_col") & (F.instr("_s2", "**") > 0)
    df = df.withColumn("cleaned", F.when(do_collapse, tx.collapse_replaced("_s2")).otherwise(F.col("_s2")))
    # only asterisks are removed by the collapse, so the length drop is the count
    df = df.withColumn("n_collapsed", (F.length("_s2") - F.length("cleaned")).cast("int")) \
        .drop("_ctl", "_nl", "_col", "_s1", "_s2")
    tabs = F.col("tab_count")
    exp = F.col("expected_tab_count")
    df = df.withColumn("tab_count", F.when(F.col("validated"), tx.count_tabs("cleaned")))
    issue = F.when(F.col("validated") & (tabs != exp),
                   F.when(tabs > exp, F.lit("EXCESS_TABS")).otherwise(F.lit("INSUFFICIENT_TABS")))
    df = df.withColumn("tab_issue", issue) \
        .withColumn("tab_fixed", F.coalesce(F.col("validated") & (tabs > exp) & F.col("auto_fix_enabled"),
                                            F.lit(False)))
    sev = F.when(F.col("tab_issue").isNull(), F.lit(None).cast("string")) \
        .when(F.col("tab_fixed"), F.lit("WARNING")) \
        .when(F.col("reject_on_violation"), F.lit("CRITICAL")).otherwise(F.lit("ERROR"))
    df = df.withColumn("tab_severity", sev)
    return df.withColumn("fixed_line", F.when(F.col("tab_fixed"), tx.fix_excess_tabs("cleaned", exp))
                         .otherwise(F.col("cleaned")))


def _clean_issue(kind: str, count: str, label: str) -> Column:
    n = F.col(count)
    return F.when(n > 0, F.struct(
        F.lit({"CONTROL_CHARACTERS": 0, "NON_LATIN_CHARACTERS": 1,
               "CONSECUTIVE_REPLACED_CHARS": 2}[kind]).alias("issue_seq"),
        F.lit(kind).alias("issue_type"),
        F.lit("WARNING").alias("severity"),
        F.lit(None).cast("string").alias("expected_value"),
        F.lit(None).cast("string").alias("actual_value"),
        F.format_string("Line %d: Found %d %s, replaced with asterisk",
                        F.col("line_number"), n, F.lit(label)).alias("description"),
        F.lit(True).alias("auto_fixed"),
        F.format_string("Replaced %d %s with asterisk (*)", n, F.lit(label)).alias("fix_description"),
        tx.issue_text(F.col("line")).alias("original_line"),
        tx.issue_text(F.col("cleaned")).alias("corrected_line"),
    ))


# Wording of the three cleaning issues.
CLEAN_LABELS = (
    ("CONTROL_CHARACTERS", "n_control", "control character(s)"),
    ("NON_LATIN_CHARACTERS", "n_non_latin", "non-BASIC_LATIN character(s)"),
    ("CONSECUTIVE_REPLACED_CHARS", "n_collapsed", "consecutive replaced character(s) collapsed"),
)


def _tab_issue() -> Column:
    exp, tabs = F.col("expected_tab_count"), F.col("tab_count")
    return F.when(F.col("tab_issue").isNotNull(), F.struct(
        F.lit(3).alias("issue_seq"),
        F.col("tab_issue").alias("issue_type"),
        F.col("tab_severity").alias("severity"),
        F.concat(exp.cast("string"), F.lit(" tabs")).alias("expected_value"),
        F.concat(tabs.cast("string"), F.lit(" tabs")).alias("actual_value"),
        F.format_string("Line %d: Expected %d tabs but found %d tabs",
                        F.col("line_number"), exp, tabs).alias("description"),
        F.col("tab_fixed").alias("auto_fixed"),
        F.when(F.col("tab_fixed"), F.format_string("Converted %d excess tabs to spaces", tabs - exp))
        .alias("fix_description"),
        tx.issue_text(F.col("cleaned")).alias("original_line"),
        F.when(F.col("tab_fixed"), F.col("fixed_line")).alias("corrected_line"),
    ))


def has_issue() -> Column:
    return (F.col("n_control") > 0) | (F.col("n_non_latin") > 0) | (F.col("n_collapsed") > 0) \
        | F.col("tab_issue").isNotNull()


def clean_issues(validated: DataFrame) -> DataFrame:
    """Up to three cleaning issues per line (control, non-latin, collapse)."""
    return _issues(validated, [_clean_issue(*x) for x in CLEAN_LABELS],
                   (F.col("n_control") > 0) | (F.col("n_non_latin") > 0) | (F.col("n_collapsed") > 0))


def tab_issues(validated: DataFrame) -> DataFrame:
    return _issues(validated, [_tab_issue()], F.col("tab_issue").isNotNull())


def validation_issues(validated: DataFrame) -> DataFrame:
    """All validation issues: cleaning issues then the tab issue, per line."""
    return _issues(validated, [_clean_issue(*x) for x in CLEAN_LABELS] + [_tab_issue()], has_issue())


def _issues(validated: DataFrame, parts: list[Column], pre: Column) -> DataFrame:
    """Explode the per-line issue structs.

    No ``where`` before the explode on purpose: Catalyst would push such a
    filter below the cleaning projections and evaluate the regex chain twice.
    A line without issues yields an empty array, and so no rows.
    """
    arr = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return validated.select(
        "batch_id", "file_name", "line_number", F.explode(arr).alias("i")
    ).select("batch_id", "file_name", "line_number", "i.*").select(*schemas.ISSUE_COLUMNS)


def line_metrics(validated: DataFrame) -> DataFrame:
    """Per-line issue counters used for the batch metrics (no explode)."""
    ci = lambda c: (F.col(c) > 0).cast("int")
    n_clean = ci("n_control") + ci("n_non_latin") + ci("n_collapsed")
    tab = F.col("tab_issue").isNotNull()
    return validated.select(
        "batch_id",
        (n_clean + F.col("tab_fixed").cast("int")).alias("_fixed"),
        (n_clean + F.col("tab_fixed").cast("int")).alias("_warn"),
        (tab & ~F.col("tab_fixed")).cast("int").alias("_err"),
        (F.col("tab_severity") == "CRITICAL").cast("int").alias("_crit"),
    )


def batch_quality(validated: DataFrame) -> DataFrame:
    """Per batch: corrected / warning / error / critical counts (partial aggregation)."""
    m = line_metrics(validated)
    return m.groupBy("batch_id").agg(
        F.sum("_fixed").cast("long").alias("corrected_records"),
        F.sum("_warn").cast("int").alias("warning_count"),
        F.sum("_err").cast("int").alias("error_count"),
        (F.sum(F.coalesce(F.col("_crit"), F.lit(0))) > 0).alias("rejected"),
    )


def quality_metrics(issues: DataFrame) -> DataFrame:
    """Per batch from an issue table: corrected, warnings, errors (ERROR or CRITICAL)."""
    return issues.groupBy("batch_id").agg(
        F.count_if(F.col("auto_fixed")).cast("long").alias("corrected_records"),
        F.count_if(F.col("severity") == "WARNING").cast("int").alias("warning_count"),
        F.count_if(F.col("severity").isin("ERROR", "CRITICAL")).cast("int").alias("error_count"),
    )


def quality_status(corrected, warnings, errors, failed=None, current=None) -> Column:
    """Data-quality label in the fixed order; errors only leave the current label."""
    c = F.col(corrected) if isinstance(corrected, str) else corrected
    w = F.col(warnings) if isinstance(warnings, str) else warnings
    e = F.col(errors) if isinstance(errors, str) else errors
    cur = F.lit("CLEAN") if current is None else (F.col(current) if isinstance(current, str) else current)
    status = F.when((c == 0) & (w == 0) & (e == 0), F.lit("CLEAN")) \
        .when((c > 0) & (e == 0), F.lit("CORRECTED")) \
        .when((e > 0) & (w > 0), F.lit("WITH_ERRORS")) \
        .when(w > 0, F.lit("WITH_WARNINGS")).otherwise(cur)
    if failed is not None:
        f = F.col(failed) if isinstance(failed, str) else failed
        status = F.when(f, F.lit("REJECTED")).otherwise(status)
    return status


def reject_gate(issues: DataFrame) -> DataFrame:
    """Batches with at least one CRITICAL issue."""
    return issues.groupBy("batch_id").agg(
        F.max((F.col("severity") == "CRITICAL").cast("int")).cast("boolean").alias("rejected"),
        F.count_if(F.col("severity") == "CRITICAL").cast("long").alias("critical_issues"),
    )
