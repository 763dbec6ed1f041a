"""Per-file-type line transforms chosen by rule, and their audit issues.

A transform is ``(line: Column, line_number: Column) -> Column``; returning
NULL drops the line.  Built-ins are Column expressions; users may register a
``pandas_udf`` as a slow path.  Dispatch is one CASE over the rule's
transformer name, so only the matching branch is evaluated per row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

Transform = Callable[[Column, Column], Column]

_REGISTRY: dict[str, Transform] = {}
# transforms known never to return NULL for a non-NULL line (no drop filter needed)
_KEEPS_LINES: set[str] = set()


def register_transform(name: str, fn: Transform, keeps_lines: bool = False) -> None:
    """Add (or replace) a named line transform.

    ``keeps_lines=True`` promises the transform never returns NULL for a
    non-NULL line, which lets :func:`apply_transform` skip the drop filter.
    """
    key = normalize_name(name)
    _REGISTRY[key] = fn
    if keeps_lines:
        _KEEPS_LINES.add(key)
    else:
        _KEEPS_LINES.discard(key)


def registered() -> dict[str, Transform]:
    return dict(_REGISTRY)


def normalize_name(name: str) -> str:
    """``pkg.PM1Transformer`` / ``PM1Transformer`` / ``pm1`` -> ``pm1``."""
    n = (name or "").strip().rsplit(".", 1)[-1].lower()
    return n[: -len("transformer")] if n.endswith("transformer") and n != "transformer" else n


def normalized_name_col(col) -> Column:
    c = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    c = F.regexp_extract(c, "([^.]*)$", 1)
    return F.when(c.endswith("transformer") & (c != "transformer"),
                  c.substr(F.lit(1), F.length(c) - 11)).otherwise(c)


# Built-ins: control-char pin fix (PM1, PM3), non-digit pin fix (PM2, PM5, PM6),
# IM2 field trim + zero date, identity.
register_transform("pm1", lambda line, n: tx.pin_fix_control(line, 7), keeps_lines=True)
register_transform("pm3", lambda line, n: tx.pin_fix_control(line, 7), keeps_lines=True)
register_transform("pm2", lambda line, n: tx.pin_fix_nondigit(line, 6), keeps_lines=True)
register_transform("pm5", lambda line, n: tx.pin_fix_nondigit(line, 6), keeps_lines=True)
register_transform("pm6", lambda line, n: tx.pin_fix_nondigit(line, 6), keeps_lines=True)
register_transform("im2", lambda line, n: tx.im2_transform(line), keeps_lines=True)
register_transform("noop", lambda line, n: line, keeps_lines=True)


def python_transform(fn: Callable[[str, int], str | None]) -> Transform:
    """A per-line Python function as a transform: Arrow batches, and a line on which it raises is kept as it is."""
    @F.pandas_udf("string")
    def run(lines: pd.Series, numbers: pd.Series) -> pd.Series:
        def one(line, number):
            try:
                return None if line is None else fn(line, number)
            except Exception:  # noqa: BLE001 -- the contract: a failing transform leaves its line unchanged
                return line
        return pd.Series([one(x, n) for x, n in zip(lines, numbers)], dtype=object)

    return run


def transform_name(enabled_col: str = "enable_data_transformation",
                   name_col: str = "transformer_class_name",
                   registry: dict[str, Transform] | None = None) -> Column:
    """The registry key to apply: NULL when disabled, blank or not in ``registry`` (noop)."""
    key = normalized_name_col(name_col)
    known = key.isin(*[k for k in (_REGISTRY if registry is None else registry) if k != "noop"])
    return F.when(F.coalesce(F.col(enabled_col), F.lit(False)) & known, key)


def apply_transform(df: DataFrame, line_col: str = "fixed_line", out_col: str = "out_line",
                    registry: dict[str, Transform] | None = None) -> DataFrame:
    """Apply the rule-selected transform to ``line_col`` as ``out_col``.

    Expects the rule columns of :func:`validate.rule_join`.  ``registry``
    replaces the global one; a rule whose transform it lacks leaves its lines
    unchanged.  Lines whose transform yields NULL are dropped; noop rules add
    no work.
    """
    reg = _REGISTRY if registry is None else {normalize_name(k): fn for k, fn in registry.items()}
    key = transform_name(registry=reg)
    line, num = F.col(line_col), F.col("line_number")
    expr = None
    for name, fn in reg.items():
        if name == "noop":
            continue
        expr = (F.when(key == name, fn(line, num)) if expr is None
                else expr.when(key == name, fn(line, num)))
    out = line if expr is None else F.when(key.isNull(), line).otherwise(expr)
    res = df.withColumn("transform_key", key).withColumn(out_col, out)
    if all(name in _KEEPS_LINES and fn is _REGISTRY.get(name) for name, fn in reg.items()):
        return res
    # Drop lines whose transform returned NULL.  An explode of a zero-or-one
    # element array instead of a filter: Catalyst pushes filters below the
    # projections and would inline (and so repeat) the whole cleaning chain.
    keep = F.col(out_col).isNotNull() | F.col(line_col).isNull()
    cols = [c for c in res.columns if c != out_col]
    return res.select(*cols, F.explode(F.when(keep, F.array(F.col(out_col)))).alias(out_col))


# Wording of the transformation audit issue.
AUDIT_FIX = "Applied data transformation (empty PIN fix)"
AUDIT_DESCRIPTION = "Empty PIN value '0000' inserted"


def transform_audit(transformed: DataFrame, before: str = "fixed_line", after: str = "out_line") -> DataFrame:
    """One DATA_TRANSFORMATION issue per changed line (file_name = pattern, untruncated).

    Built with an explode of a zero-or-one element array rather than a
    filter, so the transform is not pushed into a filter and computed twice.
    """
    changed = ~F.col(before).eqNullSafe(F.col(after))
    rec = F.when(changed, F.struct(
        F.col("file_pattern").alias("file_name"),
        F.lit(4).alias("issue_seq"),
        F.lit("DATA_TRANSFORMATION").alias("issue_type"),
        F.lit("WARNING").alias("severity"),
        F.lit(None).cast("string").alias("expected_value"),
        F.lit(None).cast("string").alias("actual_value"),
        F.lit(AUDIT_DESCRIPTION).alias("description"),
        F.lit(True).alias("auto_fixed"),
        F.lit(AUDIT_FIX).alias("fix_description"),
        F.col(before).alias("original_line"),
        F.col(after).alias("corrected_line"),
    ))
    arr = F.filter(F.array(rec), lambda x: x.isNotNull())
    return transformed.select("batch_id", "line_number", F.explode(arr).alias("i")).select(
        "batch_id", "i.file_name", "line_number", "i.issue_seq", "i.issue_type", "i.severity",
        "i.expected_value", "i.actual_value", "i.description", "i.auto_fixed", "i.fix_description",
        "i.original_line", "i.corrected_line")
