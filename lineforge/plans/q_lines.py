"""Queries for line cleaning, tab checks, transforms and issue tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import report as RP
from ..operators import transform as TR
from ..operators import validate as V
from . import derived as D
from . import oracle as O
from .registry import register, validated

LINES = f"WITH lines AS ({O.DOC_LINES})"
PLAIN = f"WITH lines AS ({O.DOC_PLAIN_LINES})"
BASE = f"WITH {O.base_ctes()}"


@register("replace_control_chars", f"""{LINES}
SELECT batch_id, line_number, regexp_replace(line, '{O.CTRL}', '*', 'g') AS cleaned,
       CAST({O.count_re('line', O.CTRL)} AS INTEGER) AS n_control FROM lines""")
def q_replace_control(spark, sf):
    d = D.doc_lines(spark, sf)
    return d.select("batch_id", "line_number", tx.replace_control_chars("line").alias("cleaned"),
                    tx.count_control_chars("line").alias("n_control"))


@register("replace_non_latin", f"""{PLAIN}
SELECT batch_id, line_number, regexp_replace(line, '{O.NONLAT}', '*', 'g') AS cleaned,
       CAST({O.count_re('line', O.NONLAT)} + {O.count_re('line', O.SUPP)} AS INTEGER) AS n_non_latin FROM lines""")
def q_replace_non_latin(spark, sf):
    d = D.doc_plain_lines(spark, sf)
    return d.select("batch_id", "line_number", tx.replace_non_latin("line").alias("cleaned"),
                    tx.count_non_latin("line").alias("n_non_latin"))


_NL = f"regexp_replace(line, '{O.NONLAT}', '*', 'g')"
_COLL = f"regexp_replace({_NL}, '\\*{{2,}}', '*', 'g')"


@register("collapse_replaced", f"""{PLAIN}
SELECT batch_id, line_number, {_COLL} AS collapsed,
       CAST(length({_NL}) - length({_COLL}) AS INTEGER) AS n_collapsed FROM lines""")
def q_collapse(spark, sf):
    d = D.doc_plain_lines(spark, sf).withColumn("nl", tx.replace_non_latin("line"))
    c = tx.collapse_replaced("nl")
    return d.select("batch_id", "line_number", c.alias("collapsed"),
                    (F.length("nl") - F.length(c)).alias("n_collapsed"))


def _units(x):
    return f"(length({x}) + {O.count_re(x, O.SUPP)})"


def _stars(x):
    return f"(length({x}) - length(replace({x}, '*', '')))"


@register("count_replacements", f"""{PLAIN}
SELECT batch_id, line_number,
  CAST(CASE WHEN line = {_NL} THEN 0 ELSE {_units('line')} - {_units(_NL)} + {_stars(_NL)} - {_stars('line')} END
       AS INTEGER) AS replacements
FROM lines""")
def q_count_replacements(spark, sf):
    d = D.doc_plain_lines(spark, sf)
    return d.select("batch_id", "line_number",
                    tx.count_replacements(F.col("line"), tx.replace_non_latin("line")).alias("replacements"))


@register("clean_line", f"""{BASE}
SELECT batch_id, line_number, cleaned, CAST(n_control AS INTEGER) AS n_control,
       CAST(n_non_latin AS INTEGER) AS n_non_latin, CAST(n_collapsed AS INTEGER) AS n_collapsed FROM v""")
def q_clean_line(spark, sf):
    v = validated(spark, sf)
    return v.select("batch_id", "line_number", "cleaned", "n_control", "n_non_latin", "n_collapsed")


@register("clean_issues", f"""{BASE}
{O.issues_sql('v', kinds=('clean',))}""")
def q_clean_issues(spark, sf):
    return V.clean_issues(validated(spark, sf))


@register("count_tabs", f"""{LINES}
SELECT batch_id, line_number, CAST(length(line) - length(replace(line, chr(9), '')) AS INTEGER) AS tab_count
FROM lines""")
def q_count_tabs(spark, sf):
    d = D.doc_lines(spark, sf)
    return d.select("batch_id", "line_number", tx.count_tabs("line").alias("tab_count"))


@register("fix_excess_tabs", f"""{LINES}
SELECT batch_id, line_number,
  CASE WHEN length(line) - length(replace(line, chr(9), '')) > 2 THEN {O.fix_tabs('line', '2')} ELSE line END AS fixed
FROM lines""")
def q_fix_excess_tabs(spark, sf):
    d = D.doc_lines(spark, sf)
    return d.select("batch_id", "line_number", tx.fix_excess_tabs("line", 2).alias("fixed"))


@register("tab_check", f"""{BASE}
{O.issues_sql('v', kinds=('tab',))}""")
def q_tab_check(spark, sf):
    return V.tab_issues(validated(spark, sf))


@register("issue_text_guard", f"""{PLAIN}
SELECT batch_id, line_number, {O.issue_text('line')} AS guarded FROM lines""")
def q_issue_text(spark, sf):
    d = D.doc_plain_lines(spark, sf)
    return d.select("batch_id", "line_number", tx.issue_text("line").alias("guarded"))


@register("validate_and_fix", f"""{BASE}
SELECT batch_id, file_name, line_number, validated, fixed_line, tab_issue, tab_severity, tab_fixed FROM v""")
def q_validate_and_fix(spark, sf):
    v = validated(spark, sf)
    return v.select("batch_id", "file_name", "line_number", "validated", "fixed_line", "tab_issue",
                    "tab_severity", "tab_fixed")


@register("issue_union", f"""{BASE}
{O.issues_sql('v')}""")
def q_issue_union(spark, sf):
    return V.validation_issues(validated(spark, sf))


@register("rule_join", f"""{BASE}
SELECT batch_id, line_number, file_pattern, rule_found, expected_tab_count, validation_enabled,
       reject_on_violation, transformer_class_name FROM j""")
def q_rule_join(spark, sf):
    j = V.rule_join(D.doc_lines(spark, sf), D.run_rules(spark))
    return j.select("batch_id", "line_number", "file_pattern", "rule_found", "expected_tab_count",
                    "validation_enabled", "reject_on_violation", "transformer_class_name")


@register("quality_metrics", f"""{BASE}, i AS ({O.issues_sql('v')})
SELECT batch_id, CAST(count_if(auto_fixed) AS BIGINT) AS corrected_records,
       CAST(count_if(severity = 'WARNING') AS INTEGER) AS warning_count,
       CAST(count_if(severity IN ('ERROR', 'CRITICAL')) AS INTEGER) AS error_count
FROM i GROUP BY batch_id""")
def q_quality_metrics(spark, sf):
    return V.quality_metrics(V.validation_issues(validated(spark, sf)))


@register("reject_gate", f"""{BASE}, i AS ({O.issues_sql('v')})
SELECT batch_id, bool_or(severity = 'CRITICAL') AS rejected,
       CAST(count_if(severity = 'CRITICAL') AS BIGINT) AS critical_issues
FROM i GROUP BY batch_id""")
def q_reject_gate(spark, sf):
    return V.reject_gate(V.validation_issues(validated(spark, sf)))


@register("severity_counts", f"""{BASE}, i AS ({O.issues_sql('v')})
SELECT batch_id, severity, count(*) AS issue_count FROM i GROUP BY batch_id, severity""")
def q_severity_counts(spark, sf):
    return RP.severity_counts(V.validation_issues(validated(spark, sf)))


@register("validation_report", f"""{BASE}, i AS ({O.issues_sql('v')})
SELECT batch_id, count(*) AS total_issues, CAST(count_if(auto_fixed) AS BIGINT) AS auto_fixed_count,
       CAST(count_if(severity = 'INFO') AS BIGINT) AS info_issues,
       CAST(count_if(severity = 'WARNING') AS BIGINT) AS warning_issues,
       CAST(count_if(severity = 'ERROR') AS BIGINT) AS error_issues,
       CAST(count_if(severity = 'CRITICAL') AS BIGINT) AS critical_issues,
       min(line_number) AS first_issue_line, max(line_number) AS last_issue_line
FROM i GROUP BY batch_id""")
def q_validation_report(spark, sf):
    from ..operators.report import validation_report
    return validation_report(V.validation_issues(validated(spark, sf)))


# ---------------------------------------------------------------- transforms

PINS = f"WITH lines AS ({O.PIN_LINES})"
IM2 = f"WITH lines AS ({O.IM2_LINES})"


@register("pin_fix_control", f"""{PINS}
SELECT batch_id, line_number, {O.pin_control('line')} AS fixed FROM lines""")
def q_pin_control(spark, sf):
    d = D.pin_lines(spark, sf)
    return d.select("batch_id", "line_number", tx.pin_fix_control("line").alias("fixed"))


@register("pin_fix_nondigit", f"""{PINS}
SELECT batch_id, line_number, {O.pin_nondigit('line')} AS fixed FROM lines""")
def q_pin_nondigit(spark, sf):
    d = D.pin_lines(spark, sf)
    return d.select("batch_id", "line_number", tx.pin_fix_nondigit("line").alias("fixed"))


@register("im2_transform", f"""{IM2}
SELECT batch_id, line_number, {O.im2('line')} AS transformed FROM lines""")
def q_im2(spark, sf):
    d = D.im2_lines(spark, sf)
    return d.select("batch_id", "line_number", tx.im2_transform("line").alias("transformed"))


@register("java_trim", f"""{IM2}
SELECT batch_id, line_number, {O.java_trim("'  ' || chr(9) || line || chr(9) || ' '")} AS trimmed FROM lines""")
def q_java_trim(spark, sf):
    d = D.im2_lines(spark, sf)
    padded = F.concat(F.lit("  \t"), F.col("line"), F.lit("\t "))
    return d.select("batch_id", "line_number", tx.java_trim(padded).alias("trimmed"))


@register("zero_date_to_null", f"""{IM2}
SELECT batch_id, line_number,
  CASE WHEN f = '0000/00/00' OR f = '' THEN NULL ELSE f END AS party_b_day_text,
  CASE WHEN f = '0000/00/00' OR f = '' THEN NULL ELSE try_strptime(f, '%Y/%m/%d') END AS party_b_day
FROM (SELECT batch_id, line_number, {O.java_trim("split_part(line, chr(9), 4)")} AS f FROM lines)""")
def q_zero_date(spark, sf):
    d = D.im2_lines(spark, sf)
    f = tx.java_trim(F.split_part("line", F.lit("\t"), F.lit(4)))
    z = tx.zero_date_to_null(f)
    return d.select("batch_id", "line_number", z.alias("party_b_day_text"),
                    F.try_to_timestamp(z, F.lit("yyyy/MM/dd")).cast("timestamp_ntz").alias("party_b_day"))


def _transformed(spark, sf):
    return TR.apply_transform(validated(spark, sf))


@register("apply_transform", f"""{BASE}
SELECT batch_id, line_number, {O.transform_case('fixed_line')} AS out_line FROM v""")
def q_apply_transform(spark, sf):
    return _transformed(spark, sf).select("batch_id", "line_number", "out_line")


@register("noop_transform", f"""{LINES}
SELECT batch_id, line_number, line AS out_line FROM lines""")
def q_noop(spark, sf):
    from ..operators.validate import rules_df
    j = V.rule_join(D.doc_lines(spark, sf), rules_df(spark))   # seed rules: only IM2 transforms
    j = j.withColumn("enable_data_transformation", F.lit(False))
    return TR.apply_transform(j, line_col="line").select("batch_id", "line_number", "out_line")


@register("transform_audit", f"""{BASE}
SELECT batch_id, file_pattern AS file_name, line_number, 4 AS issue_seq, 'DATA_TRANSFORMATION' AS issue_type,
  'WARNING' AS severity, CAST(NULL AS VARCHAR) AS expected_value, CAST(NULL AS VARCHAR) AS actual_value,
  '{TR.AUDIT_DESCRIPTION.replace("'", "''")}' AS description, TRUE AS auto_fixed, '{TR.AUDIT_FIX}' AS fix_description,
  fixed_line AS original_line, out_line AS corrected_line
FROM (SELECT *, {O.transform_case('fixed_line')} AS out_line FROM v)
WHERE fixed_line IS DISTINCT FROM out_line""")
def q_transform_audit(spark, sf):
    return TR.transform_audit(_transformed(spark, sf))


@register("first_line", f"""{LINES}
SELECT batch_id, file_name, line AS first_line,
       CAST(CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, chr(9), '')) + 1 END AS INTEGER) AS field_count
FROM lines WHERE line_number = 1""")
def q_first_line(spark, sf):
    from ..operators.load import first_line_fields
    lines = D.doc_lines(spark, sf).withColumn("first_line", F.col("line"))
    return first_line_fields(lines, keep=("file_name", "first_line"))


@register("issue_filter", f"""{BASE}, i AS ({O.issues_sql('v')})
SELECT * FROM i WHERE severity = 'CRITICAL' OR (batch_id = '7' AND severity = 'WARNING')""")
def q_issue_filter(spark, sf):
    from ..operators.report import filter_issues
    i = V.validation_issues(validated(spark, sf))
    return filter_issues(i, severity="CRITICAL").unionByName(filter_issues(i, batch_id="7", severity="WARNING"))


_TR_NAMES = ("pm1", "pm2", "pm3", "pm5", "pm6", "im2", "noop", "unknown")


@register("transformer_registry", f"""{PINS}
SELECT batch_id, line_number, name,
  CASE name WHEN 'pm1' THEN {O.pin_control('line')} WHEN 'pm3' THEN {O.pin_control('line')}
            WHEN 'pm2' THEN {O.pin_nondigit('line')} WHEN 'pm5' THEN {O.pin_nondigit('line')}
            WHEN 'pm6' THEN {O.pin_nondigit('line')} WHEN 'im2' THEN {O.im2('line')} ELSE line END AS out_line
FROM (SELECT *, CASE CAST(line_number % {len(_TR_NAMES)} AS INTEGER)
  {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_TR_NAMES))} END AS name FROM lines)""")
def q_transformer_registry(spark, sf):
    d = D.pin_lines(spark, sf)
    k = (F.col("line_number") % len(_TR_NAMES)).cast("int")
    name = F.element_at(F.array(*[F.lit(n) for n in _TR_NAMES]), k + 1)
    d = d.withColumn("name", name).withColumn("enable_data_transformation", F.lit(True)) \
        .withColumn("transformer_class_name", F.col("name"))
    return TR.apply_transform(d, line_col="line").select("batch_id", "line_number", "name", "out_line")
