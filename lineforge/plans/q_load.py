"""Queries for the load path: TSV scan, binding, typing, gates, load, CSV text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..functions import csvtext as CV
from ..functions import names as N
from ..functions import text as tx
from ..operators import load as L
from ..operators import store
from ..session import scratch_path
from . import derived as D
from .registry import register

MONEY_SQL = ("CAST(CAST(floor(o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || "
             "lpad(CAST(CAST(floor(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')")

ORDERS_TSV = f"""
SELECT fname AS file_name, fname AS batch_id, o_orderkey AS line_number, line FROM (
  SELECT o_orderkey,
    'IM' || CASE WHEN o_custkey % 5 = 0 THEN '3' ELSE '1' END || lpad(CAST(o_custkey % 97 AS VARCHAR), 2, '0') AS fname,
    concat_ws(chr(9), CAST(o_custkey % 100 AS VARCHAR),
      CASE WHEN o_orderkey % 1000 = 7 THEN '' WHEN o_orderkey % 1000 = 3 THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '0')
           ELSE CAST(o_orderkey AS VARCHAR) END,
      strftime(o_orderdate, '%Y/%m/%d'), substring(o_orderpriority, 1, 1), o_orderstatus, '', '', {MONEY_SQL}) AS line
  FROM orders)"""

TSV = f"WITH lines AS ({ORDERS_TSV})"
IM1 = schemas.table_columns("im1")


def _f(i):  # 1-based field i of the tab line
    return f"nullif(string_split(line, chr(9))[{i}], '')"


def typed_sql_cols(cols, bound="bound", fields="row_fields"):
    """SELECT-list items (typed columns + violations) mirroring load.typed_cast."""
    items, checks = [], []
    for i, c in enumerate(cols):
        raw = f"(CASE WHEN {bound} > {i} THEN {c.name} END)"
        if c.kind == "varchar":
            n = c.width
            items.append(f"CASE WHEN length({raw}) <= {n} THEN {raw} WHEN rtrim(substring({raw}, {n + 1})) = '' "
                         f"THEN substring({raw}, 1, {n}) END AS {c.name}")
            checks.append(f"CASE WHEN {raw} IS NOT NULL AND length({raw}) > {n} AND rtrim(substring({raw}, {n + 1})) <> '' "
                          f"THEN '{c.name}:LENGTH_VIOLATION' END")
        elif c.kind == "text":
            items.append(f"{raw} AS {c.name}")
        elif c.kind in ("numeric", "numeric38"):
            t = "DECIMAL(38,10)" if c.kind == "numeric" else "DECIMAL(38,0)"
            items.append(f"TRY_CAST({raw} AS {t}) AS {c.name}")
            checks.append(f"CASE WHEN {raw} IS NOT NULL AND TRY_CAST({raw} AS {t}) IS NULL THEN '{c.name}:DATA_TYPE_MISMATCH' END")
        else:
            t = (f"coalesce(try_strptime({raw}, '%Y/%m/%d'), try_strptime({raw}, '%Y-%m-%d %H:%M:%S'), "
                 f"try_strptime({raw}, '%Y/%m/%d %H:%M:%S'), "
                 f"CASE WHEN regexp_full_match({raw}, '{L.ISO_TIME[1:-1]}') THEN TRY_CAST({raw} AS TIMESTAMP) END)")
            items.append(f"date_trunc('second', {t} + INTERVAL 500 MILLISECOND) AS {c.name}")
            checks.append(f"CASE WHEN {raw} IS NOT NULL AND {t} IS NULL THEN '{c.name}:DATA_TYPE_MISMATCH' END")
        if c.required:
            checks.append(f"CASE WHEN {bound} > {i} AND {raw} IS NULL THEN '{c.name}:EMPTY_REQUIRED_FIELD' END")
    checks.append(f"CASE WHEN {fields} <> {bound} THEN 'row:FIELD_COUNT' END")
    items.append("list_filter([" + ", ".join(checks) + "], lambda x: x IS NOT NULL) AS violations")
    return ",\n  ".join(items)


SCANNED = f"""{TSV},
im1 AS (SELECT * FROM lines),
firsts AS (SELECT batch_id, least({len(IM1)}, arg_min(CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, chr(9), '')) + 1 END,
                                    line_number)) AS bound FROM im1 GROUP BY batch_id),
scanned AS (
  SELECT l.batch_id, l.line_number, f.bound,
    CAST(CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, chr(9), '')) + 1 END AS INTEGER) AS row_fields,
    {", ".join(f"{_f(i + 1)} AS {c.name}" for i, c in enumerate(IM1))}
  FROM im1 l JOIN firsts f USING (batch_id)),
typed AS (SELECT batch_id, line_number, {typed_sql_cols(IM1)} FROM scanned)"""


def _scanned(spark, sf):
    lines = D.orders_tsv(spark, sf)
    # a file wider than the table binds all its columns; its rows then fail on their field count
    first = L.first_line_fields(lines).withColumn("field_count", F.least("field_count", F.lit(len(IM1))))
    s = L.tsv_scan(lines.withColumn("row_fields", tx.count_fields("line")), "im1",
                   keep=("batch_id", "line_number", "row_fields"))
    return s.join(first.withColumnRenamed("field_count", "bound"), "batch_id")


def _typed(spark, sf):
    s = _scanned(spark, sf)
    return L.typed_cast(s, "im1", bound=F.col("bound"))


@register("tsv_scan", f"""{TSV}
SELECT batch_id, line_number, {", ".join(f"{_f(i + 1)} AS {c.name}" for i, c in enumerate(IM1))} FROM lines""")
def q_tsv_scan(spark, sf):
    return L.tsv_scan(D.orders_tsv(spark, sf), "im1")


def _bind_sql():
    widths = " ".join(f"WHEN '{t}' THEN {len(cols)}" for t, cols in schemas.TABLES.items())
    names = " ".join(f"WHEN '{t}' THEN [{', '.join(repr(c.name) for c in cols)}]"
                     for t, cols in schemas.TABLES.items())
    return f"""{TSV},
firsts AS (SELECT batch_id, arg_min(CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, chr(9), '')) + 1 END,
                                    line_number) AS field_count FROM lines GROUP BY batch_id),
routed AS (SELECT *, lower(regexp_extract(batch_id, '{N.ROUTING_REGEX}', 1) || regexp_extract(batch_id, '{N.ROUTING_REGEX}', 2)) AS table_name,
                  CAST(NULL AS INTEGER) AS dummy FROM firsts),
w AS (SELECT *, CASE table_name {widths} END AS table_width, CASE table_name {names} END AS all_cols FROM routed)
SELECT batch_id, table_name, CAST(field_count AS INTEGER) AS field_count, table_width,
  CASE WHEN field_count <= table_width THEN list_slice(all_cols, 1, field_count) END AS bound_columns,
  CASE WHEN field_count > table_width THEN printf('File has %d fields but table %s only has %d data columns',
       field_count, table_name, table_width) END AS bind_error
FROM w"""


@register("bind_columns", _bind_sql())
def q_bind(spark, sf):
    lines = D.orders_tsv(spark, sf)
    first = L.first_line_fields(lines).withColumn("table_name", N.route_table("batch_id"))
    return L.bind_columns(first)


@register("typed_cast", f"""{SCANNED}
SELECT * FROM typed""")
def q_typed(spark, sf):
    return _typed(spark, sf)


@register("load_gate", f"""{SCANNED}
SELECT batch_id, count(*) AS row_count, CAST(count_if(len(violations) > 0) AS BIGINT) AS bad_rows,
       bool_or(len(violations) > 0) AS failed FROM typed GROUP BY batch_id""")
def q_load_gate(spark, sf):
    return L.load_gate(_typed(spark, sf))


DATA_COLS = ", ".join(c.name for c in IM1)


@register("batch_load", f"""{SCANNED},
bad AS (SELECT batch_id FROM typed GROUP BY batch_id HAVING bool_or(len(violations) > 0))
SELECT batch_id, {DATA_COLS} FROM typed WHERE batch_id NOT IN (SELECT batch_id FROM bad)""")
def q_batch_load(spark, sf):
    loaded = L.batch_load(_typed(spark, sf), "im1")
    return loaded.select("batch_id", *[c.name for c in IM1])


@register("ensure_tracking_columns", f"""{SCANNED}
SELECT line_number, {DATA_COLS}, batch_id, CAST(NULL AS BIGINT) AS row_number, CAST(NULL AS TIMESTAMP) AS loaded_at
FROM typed""")
def q_ensure_tracking(spark, sf):
    t = _typed(spark, sf).drop("violations")
    return L.ensure_tracking_columns(t)


@register("drop_tracking_columns", f"""{SCANNED}
SELECT line_number, {DATA_COLS} FROM typed""")
def q_drop_tracking(spark, sf):
    t = L.ensure_tracking_columns(_typed(spark, sf).drop("violations"))
    return L.drop_tracking_columns(t)


@register("tag_untagged_rows", f"""{TSV}
SELECT coalesce(CASE WHEN line_number % 3 = 0 THEN NULL ELSE batch_id END, 'untagged-run') AS batch_id, line_number
FROM lines""")
def q_tag(spark, sf):
    d = D.orders_tsv(spark, sf).select(
        F.when(F.col("line_number") % 3 == 0, F.lit(None)).otherwise(F.col("batch_id")).alias("batch_id"),
        "line_number")
    return L.tag_untagged_rows(d, "untagged-run")


@register("row_number_assign", f"""{TSV},
runs AS (SELECT CASE WHEN line_number % 2 = 0 THEN 'even' ELSE 'odd' END AS run, count(*) AS n FROM lines GROUP BY 1)
SELECT run AS load_run, n AS row_count, n AS distinct_ids, CASE run WHEN 'even' THEN 1 ELSE 1 + (SELECT n FROM runs WHERE run = 'even') END AS first_id,
  CASE run WHEN 'even' THEN n ELSE (SELECT CAST(sum(n) AS BIGINT) FROM runs) END AS last_id FROM runs""")
def q_row_number(spark, sf):
    """Two runs into one table: ids go from 1 to the number of rows, the second run's after the first's."""
    path = scratch_path(spark, f"row_numbers/{uuid.uuid4().hex}")
    lines = D.orders_tsv(spark, sf).select(F.concat("batch_id", F.lit("-"), (F.col("line_number") % 2).cast("string")).alias("batch_id"), "line_number")
    for seen, run in enumerate(("even", "odd")):
        store.load_tables({"orders": lines.where(F.col("line_number") % 2 == seen)}, path, run, seen)
    return store.read_table(spark, path, "orders").groupBy("load_run").agg(
        F.count("*").alias("row_count"), F.count_distinct("row_number").alias("distinct_ids"),
        F.min("row_number").alias("first_id"), F.max("row_number").alias("last_id"))


# ------------------------------------------------------------------ CSV text

CSV_LINES = '''
SELECT p_partkey, p_name, p_brand, p_type, p_size,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS VARCHAR) || ',' || p_type
       ELSE CAST(p_partkey AS VARCHAR) || ',"' || replace(p_name, ' ', ', ') || ' ""' || p_brand || '""",  ' || p_type
            || '  ,' || CAST(p_size AS VARCHAR) || ',' END AS line,
  '"' || p_name || '",' || p_brand || ',' || CAST(p_size AS VARCHAR) || ' Units,,__' || p_type || '__' AS header
FROM part'''
CSV = f"WITH c AS ({CSV_LINES})"
_EXPECT = ("CASE WHEN p_partkey % 3 = 0 THEN [CAST(p_partkey AS VARCHAR), p_type] "
           "ELSE [CAST(p_partkey AS VARCHAR), replace(p_name, ' ', ', ') || ' \"' || p_brand || '\"', p_type, "
           "CAST(p_size AS VARCHAR), ''] END")


@register("csv_row_parse", f"""{CSV}
SELECT p_partkey, {_EXPECT} AS fields FROM c""")
def q_csv_parse(spark, sf):
    c = D.csv_lines(spark, sf)
    return c.select("p_partkey", CV.csv_row_parse("line").alias("fields"))


@register("csv_to_tsv_normalise", f"""{CSV}
SELECT p_partkey, array_to_string(list_transform([0, 1, 2, 3], lambda i: coalesce(({_EXPECT})[i + 1], '')), chr(9)) AS tsv_line
FROM c""")
def q_csv_to_tsv(spark, sf):
    c = D.csv_lines(spark, sf)
    return c.select("p_partkey", CV.csv_to_tsv("line", 4).alias("tsv_line"))


def _san(x):
    s = (f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-zA-Z0-9_]', '_', 'g'), "
         f"'_{{2,}}', '_', 'g'), '^_|_$', '', 'g')")
    return f"(CASE WHEN regexp_matches({s}, '^\\d') THEN 'col_' || {s} ELSE {s} END)"


@register("header_columns", f"""{CSV}
SELECT p_partkey,
  list_filter(list_transform([p_name, p_brand, CAST(p_size AS VARCHAR) || ' Units', '', '__' || p_type || '__'],
                             lambda f: {_san('f')}), lambda n: n <> '') AS columns_csv,
  list_transform(string_split(header, ','), lambda f: lower(trim(f))) AS columns_naive
FROM c""")
def q_header_columns(spark, sf):
    c = D.csv_lines(spark, sf)
    return c.select("p_partkey", CV.header_columns("header", "csv").alias("columns_csv"),
                    CV.header_columns("header", "naive").alias("columns_naive"))
