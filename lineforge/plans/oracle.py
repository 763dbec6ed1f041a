"""The derived relations of :mod:`.derived` restated as DuckDB SQL CTEs.

Used only to build the oracle strings that check the Spark queries; the
library itself never runs SQL outside Spark.
"""

from __future__ import annotations

from .. import schemas
from . import derived

CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
NONLAT = r"[^\x00-\x7F]"
SUPP = r"[\x{10000}-\x{10FFFF}]"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


RULE_COLS = ("id", "file_pattern", "table_name", "expected_tab_count", "validation_enabled",
             "auto_fix_enabled", "reject_on_violation", "replace_control_chars",
             "replace_non_latin_chars", "collapse_consecutive_replaced",
             "enable_data_transformation", "transformer_class_name", "description")


def rules_values(overrides=None, seeds=schemas.RULE_SEEDS) -> str:
    names = RULE_COLS[1:]
    rows = []
    for i, seed in enumerate(seeds, start=1):
        rec = dict(zip(names, seed))
        rec.update((overrides or {}).get(rec["file_pattern"], {}))
        rows.append("(" + ", ".join([f"CAST({i} AS BIGINT)"] + [lit(rec[n]) for n in names]) + ")")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS r(" + ", ".join(RULE_COLS) + ")")


def run_rules_sql() -> str:
    return rules_values(derived.RUN_OVERRIDES)


def _lang_case(col: str) -> str:
    parts = " ".join(f"WHEN {lit(l)} THEN {lit(p)}" for l, p in derived.LANG_PATTERN)
    return f"CASE {col} {parts} ELSE {lit(derived.OTHER_PATTERN)} END"


DOC_LINES = f"""
SELECT CAST(doc_id AS VARCHAR) AS batch_id,
       {_lang_case('lang')} || '{derived.OFFICE}' AS file_name,
       {_lang_case('lang')} AS file_pattern,
       CAST(i AS BIGINT) AS line_number,
       replace(replace(raw, ' ', chr(9)), 'q', chr(1)) AS line
FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw,
             generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM documents)
"""

DOC_PLAIN_LINES = """
SELECT CAST(doc_id AS VARCHAR) AS batch_id, CAST(i AS BIGINT) AS line_number, line
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS i
      FROM documents)
"""


def issue_text(x: str) -> str:
    s = f"replace({x}, chr(0), '*')"
    return f"(CASE WHEN length({s}) > 500 THEN substring({s}, 1, 500) || '...' ELSE {s} END)"


def count_re(x: str, pat: str) -> str:
    return f"(length({x}) - length(regexp_replace({x}, '{pat}', '', 'g')))"


def fix_tabs(x: str, e: str) -> str:
    f = f"string_split({x}, chr(9))"
    return (f"(CASE WHEN {e} <= 0 THEN replace({x}, chr(9), ' ') "
            f"ELSE array_to_string(list_slice({f}, 1, {e}), chr(9)) || chr(9) || "
            f"array_to_string(list_slice({f}, {e} + 1, len({f})), ' ') END)")


def validated_ctes(lines_cte: str = "lines", rules_cte: str = "rules") -> str:
    """CTEs j, c1, c2, c3, v: rule join, cleaning, tab check (mirrors validate_lines)."""
    return f"""
j AS (
  SELECT l.*, r.expected_tab_count, r.validation_enabled, r.auto_fix_enabled, r.reject_on_violation,
         r.replace_control_chars, r.replace_non_latin_chars, r.collapse_consecutive_replaced,
         r.enable_data_transformation, r.transformer_class_name,
         r.file_pattern IS NOT NULL AS rule_found,
         coalesce(r.file_pattern IS NOT NULL AND r.validation_enabled, FALSE) AS validated
  FROM {lines_cte} l LEFT JOIN {rules_cte} r ON l.file_pattern = r.file_pattern),
c1 AS (
  SELECT *,
    coalesce(validated AND (replace_control_chars OR replace_non_latin_chars OR collapse_consecutive_replaced)
             AND length(line) > 0, FALSE) AS active,
    CASE WHEN validated AND replace_control_chars THEN regexp_replace(line, '{CTRL}', '*', 'g') ELSE line END AS s1,
    CASE WHEN validated AND replace_control_chars THEN {count_re('line', CTRL)} ELSE 0 END AS k1
  FROM j),
c2 AS (
  SELECT *,
    CASE WHEN validated AND replace_non_latin_chars THEN regexp_replace(s1, '{NONLAT}', '*', 'g') ELSE s1 END AS s2,
    CASE WHEN validated AND replace_non_latin_chars THEN {count_re('s1', NONLAT)} + {count_re('s1', SUPP)} ELSE 0 END AS k2
  FROM c1),
c3 AS (
  SELECT *,
    CASE WHEN validated AND collapse_consecutive_replaced AND contains(s2, '**')
         THEN regexp_replace(s2, '\\*{{2,}}', '*', 'g') ELSE s2 END AS s3
  FROM c2),
c4 AS (
  SELECT * EXCLUDE (s1, s2, s3, k1, k2),
    CASE WHEN active THEN s3 ELSE line END AS cleaned,
    CASE WHEN active THEN k1 ELSE 0 END AS n_control,
    CASE WHEN active THEN k2 ELSE 0 END AS n_non_latin,
    CASE WHEN active THEN length(s2) - length(s3) ELSE 0 END AS n_collapsed
  FROM c3),
c5 AS (
  SELECT *, CASE WHEN validated THEN length(cleaned) - length(replace(cleaned, chr(9), '')) END AS tab_count
  FROM c4),
c6 AS (
  SELECT *,
    CASE WHEN validated AND tab_count <> expected_tab_count THEN
      CASE WHEN tab_count > expected_tab_count THEN 'EXCESS_TABS' ELSE 'INSUFFICIENT_TABS' END END AS tab_issue,
    coalesce(validated AND tab_count > expected_tab_count AND auto_fix_enabled, FALSE) AS tab_fixed
  FROM c5),
v AS (
  SELECT *,
    CASE WHEN tab_issue IS NULL THEN NULL WHEN tab_fixed THEN 'WARNING'
         WHEN reject_on_violation THEN 'CRITICAL' ELSE 'ERROR' END AS tab_severity,
    CASE WHEN tab_fixed THEN {fix_tabs('cleaned', 'expected_tab_count')} ELSE cleaned END AS fixed_line
  FROM c6)"""


CLEAN_ISSUES = [
    (0, "CONTROL_CHARACTERS", "n_control", "control character(s)"),
    (1, "NON_LATIN_CHARACTERS", "n_non_latin", "non-BASIC_LATIN character(s)"),
    (2, "CONSECUTIVE_REPLACED_CHARS", "n_collapsed", "consecutive replaced character(s) collapsed"),
]


def issues_sql(src: str = "v", kinds=("clean", "tab")) -> str:
    """UNION ALL of issue rows from the validated CTE (ISSUE_COLUMNS order)."""
    parts = []
    if "clean" in kinds:
        for seq, kind, n, label in CLEAN_ISSUES:
            parts.append(f"""
SELECT batch_id, file_name, line_number, {seq} AS issue_seq, '{kind}' AS issue_type, 'WARNING' AS severity,
  CAST(NULL AS VARCHAR) AS expected_value, CAST(NULL AS VARCHAR) AS actual_value,
  printf('Line %d: Found %d %s, replaced with asterisk', line_number, {n}, '{label}') AS description,
  TRUE AS auto_fixed, printf('Replaced %d %s with asterisk (*)', {n}, '{label}') AS fix_description,
  {issue_text('line')} AS original_line, {issue_text('cleaned')} AS corrected_line
FROM {src} WHERE {n} > 0""")
    if "tab" in kinds:
        parts.append(f"""
SELECT batch_id, file_name, line_number, 3 AS issue_seq, tab_issue AS issue_type, tab_severity AS severity,
  CAST(expected_tab_count AS VARCHAR) || ' tabs' AS expected_value, CAST(tab_count AS VARCHAR) || ' tabs' AS actual_value,
  printf('Line %d: Expected %d tabs but found %d tabs', line_number, expected_tab_count, tab_count) AS description,
  tab_fixed AS auto_fixed,
  CASE WHEN tab_fixed THEN printf('Converted %d excess tabs to spaces', tab_count - expected_tab_count) END AS fix_description,
  {issue_text('cleaned')} AS original_line, CASE WHEN tab_fixed THEN fixed_line END AS corrected_line
FROM {src} WHERE tab_issue IS NOT NULL""")
    return "\nUNION ALL\n".join(parts)


def quality_case(c: str, w: str, e: str, failed: str | None = None, current: str = "'CLEAN'") -> str:
    s = (f"CASE WHEN {c} = 0 AND {w} = 0 AND {e} = 0 THEN 'CLEAN' "
         f"WHEN {c} > 0 AND {e} = 0 THEN 'CORRECTED' "
         f"WHEN {e} > 0 AND {w} > 0 THEN 'WITH_ERRORS' "
         f"WHEN {w} > 0 THEN 'WITH_WARNINGS' ELSE {current} END")
    if failed:
        s = f"CASE WHEN {failed} THEN 'REJECTED' ELSE {s} END"
    return s


def base_ctes() -> str:
    """rules + lines + validation CTEs over documents."""
    return f"rules AS ({run_rules_sql()}),\nlines AS ({DOC_LINES}),{validated_ctes()}"


PIN_LINES = """
SELECT CAST(l_orderkey AS VARCHAR) AS batch_id, CAST(l_linenumber AS BIGINT) AS line_number,
  concat_ws(chr(9), lpad(CAST(l_orderkey % 100000 AS VARCHAR), 5, '0'),
    CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN '    '
         ELSE lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') END,
    lpad(CAST(l_suppkey % 100000 AS VARCHAR), 5, '0'), lpad(CAST(l_linenumber AS VARCHAR), 4, '0')) AS line
FROM lineitem
"""

IM2_LINES = """
SELECT CAST(o_custkey AS VARCHAR) AS batch_id, CAST(o_orderkey AS BIGINT) AS line_number,
  concat_ws(chr(9), lpad(CAST(c_nationkey AS VARCHAR), 2, '0'), rpad(CAST(o_orderkey AS VARCHAR), 10, ' '),
    o_orderstatus,
    CASE WHEN o_orderkey % 5 = 0 THEN '0000/00/00' WHEN o_orderkey % 5 = 1 THEN ' '
         ELSE strftime(o_orderdate, '%Y/%m/%d') END,
    rpad(substring(c_mktsegment, 1, 3), 6, ' '), c_name, ' ' || substring(o_orderpriority, 1, 1), ' 1/2 ',
    '  ' || c_name || '  ') AS line
FROM orders JOIN customer ON o_custkey = c_custkey
"""

JTRIM = r"'^[\x00-\x20]+|[\x00-\x20]+$'"


def java_trim(x: str) -> str:
    return f"regexp_replace({x}, {JTRIM}, '', 'g')"


def im2(x: str) -> str:
    body = (f"array_to_string(list_transform(string_split({x}, chr(9)), lambda f, i: "
            f"CASE WHEN i = 4 AND ({java_trim('f')} = '0000/00/00' OR {java_trim('f')} = '') THEN '' "
            f"ELSE {java_trim('f')} END), chr(9))")
    return f"(CASE WHEN {x} IS NULL OR length({x}) = 0 THEN {x} ELSE {body} END)"


def pin_control(x: str, n: int = 7) -> str:
    return (f"(CASE WHEN length({x}) > {n} AND regexp_matches(substring({x}, 7, 1), '[\\x00-\\x1F\\x7F-\\x9F]') "
            f"THEN substring({x}, 1, 6) || '0000' || substring({x}, 7) ELSE {x} END)")


def pin_nondigit(x: str, n: int = 6) -> str:
    return (f"(CASE WHEN length({x}) > {n} AND NOT regexp_matches(substring({x}, 7, 1), '^\\p{{Nd}}$') "
            f"THEN substring({x}, 1, 6) || '0000' || substring({x}, 11) ELSE {x} END)")


def transform_case(x: str) -> str:
    """Rule-selected transform over the v CTE (mirrors apply_transform)."""
    key = "lower(regexp_extract(trim(transformer_class_name), '([^.]*)$', 1))"
    return (f"(CASE WHEN NOT coalesce(enable_data_transformation, FALSE) THEN {x} "
            f"WHEN {key} IN ('pm1', 'pm3') THEN {pin_control(x)} "
            f"WHEN {key} IN ('pm2', 'pm5', 'pm6') THEN {pin_nondigit(x)} "
            f"WHEN {key} = 'im2' THEN {im2(x)} ELSE {x} END)")


FILE_NAMES = """
SELECT p_partkey, p_brand, p_size,
  CASE p_partkey % 10
    WHEN 0 THEN 'PM' || CAST(p_size % 9 + 1 AS VARCHAR) || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')
    WHEN 1 THEN 'IM' || CAST(p_size % 4 AS VARCHAR) || '62.txt'
    WHEN 2 THEN replace(p_name, ' ', '-') || '.csv'
    WHEN 3 THEN p_brand || '.CSV.gz'
    WHEN 4 THEN p_type || '_' || p_name || '.zip'
    WHEN 5 THEN p_name || '.tsv'
    WHEN 6 THEN '.' || p_brand
    WHEN 7 THEN lower('PM' || CAST(p_size % 9 + 1 AS VARCHAR) || '62')
    WHEN 8 THEN p_brand || '.'
    ELSE '__' || upper(p_name) || '__.Csv.ZIP' END AS name
FROM part
"""


def ext(x: str) -> str:
    return f"regexp_extract({x}, '^.+(\\.[^.]*)$', 1)"


def stem(x: str) -> str:
    return f"regexp_replace({x}, '^(.+)\\.[^.]*$', '\\1')"


def sanitize(x: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-zA-Z0-9_]', '_', 'g'), "
            f"'_{{2,}}', '_', 'g'), '^_|_$', '', 'g')")
