"""Validation-rule table maintenance: upsert, enable/disable, delete, get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast

KEY = "file_pattern"
TIMES = ("created_at", "updated_at")


def _now(at: Column | None) -> Column:
    return F.current_timestamp().cast("timestamp_ntz") if at is None else at


def rule_upsert(existing: DataFrame, updates: DataFrame, at: Column | None = None) -> DataFrame:
    """Insert new patterns; for a known pattern replace every field given in ``updates``.

    ``created_at`` and ``updated_at``, where the table has them, are set to
    ``at`` (now): both for a new row, ``updated_at`` for an updated one.

    A full outer join on the pattern with per-column preference for the new
    value; ``action`` tells inserted / updated / unchanged.  New rows get ids
    after the current maximum, by pattern.  (The table has one row per file
    pattern, so the numbering window is small.)
    """
    cols = [c for c in existing.columns if c not in (KEY, "id", *TIMES)]
    u = updates.select(KEY, *[F.col(c).alias(f"_n_{c}") for c in cols if c in updates.columns],
                       F.lit(True).alias("_upd"))
    j = existing.withColumn("_old", F.lit(True)).join(u, KEY, "full_outer")
    pick = [(F.when(F.col("_upd"), F.col(f"_n_{c}")).otherwise(F.col(c)) if c in updates.columns
             else F.col(c)).alias(c) for c in cols]
    new, hit = F.col("_old").isNull(), F.col("_upd").isNotNull()
    times = {"created_at": F.when(new, _now(at)), "updated_at": F.when(new | hit, _now(at))}
    pick += [F.coalesce(times[c], F.col(c)).alias(c) for c in TIMES if c in existing.columns]
    action = F.when(F.col("_old").isNull(), F.lit("inserted")) \
        .when(F.col("_upd").isNotNull(), F.lit("updated")).otherwise(F.lit("unchanged"))
    last = existing.agg(F.max("id")).first()[0] or 0
    after = F.sum(new.cast("int")).over(Window.partitionBy(new).orderBy(KEY).rowsBetween(Window.unboundedPreceding, 0))
    number = F.when(new, F.lit(last) + after).otherwise(F.col("id")).cast(existing.schema["id"].dataType)
    return j.select(number.alias("id"), KEY, *pick, action.alias("action"))


def rule_toggle(rules: DataFrame, patterns: DataFrame, enabled: bool, at: Column | None = None) -> DataFrame:
    """Set ``validation_enabled`` for the listed patterns, and their ``updated_at``."""
    p = patterns.select(KEY).distinct().withColumn("_hit", F.lit(True))
    j = rules.join(bounded_broadcast(p), KEY, "left")
    out = j.withColumn("validation_enabled", F.when(F.col("_hit"), F.lit(enabled)).otherwise(F.col("validation_enabled")))
    if "updated_at" in rules.columns:
        out = out.withColumn("updated_at", F.when(F.col("_hit"), _now(at)).otherwise(F.col("updated_at")))
    return out.drop("_hit").select(rules.columns)


def rule_delete(rules: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """Remove rules whose ``by`` value appears in ``keys``."""
    return rules.join(keys.select(by).distinct(), by, "left_anti")


def rule_get(rules: DataFrame, pattern: str) -> DataFrame:
    return rules.where(F.col(KEY) == pattern)
