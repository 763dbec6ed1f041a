"""Queries for file-name functions: extensions, routing, naming, formats, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as tx
from ..operators import admission as A
from . import derived as D
from . import oracle as O
from .registry import register

NAMES = f"WITH names AS ({O.FILE_NAMES})"
ROUTE_RE = N.ROUTING_REGEX


@register("file_extension", f"""{NAMES}
SELECT p_partkey, name, {O.ext('name')} AS extension FROM names""")
def q_file_extension(spark, sf):
    n = D.file_names(spark, sf)
    return n.select("p_partkey", "name", N.file_extension("name").alias("extension"))


@register("strip_extension", f"""{NAMES}
SELECT p_partkey, name, {O.stem('name')} AS stem FROM names""")
def q_strip_extension(spark, sf):
    n = D.file_names(spark, sf)
    return n.select("p_partkey", "name", N.strip_extension("name").alias("stem"))


@register("route_by_filename", f"""{NAMES}
SELECT p_partkey, name,
  CASE WHEN regexp_full_match({O.stem('name')}, '{ROUTE_RE}')
       THEN lower(regexp_extract({O.stem('name')}, '{ROUTE_RE}', 1) || regexp_extract({O.stem('name')}, '{ROUTE_RE}', 2)) END AS table_name,
  coalesce(regexp_full_match({O.stem('name')}, '{ROUTE_RE}'), FALSE) AS can_route,
  CASE WHEN NOT coalesce(regexp_full_match({O.stem('name')}, '{ROUTE_RE}'), FALSE)
       THEN printf('Filename ''%s'' does not match routing pattern. Expected pattern: %s', name, '{ROUTE_RE}') END AS routing_error
FROM names""")
def q_route(spark, sf):
    n = D.file_names(spark, sf)
    return n.select("p_partkey", "name", N.route_table("name").alias("table_name"),
                    N.can_route("name").alias("can_route"), N.routing_error("name").alias("routing_error"))


@register("file_pattern", f"""{NAMES}
SELECT p_partkey, name,
  CASE WHEN regexp_matches({O.stem('name')}, '^(IM|PM)\\d+') THEN substring({O.stem('name')}, 1, 3)
       ELSE {O.stem('name')} END AS file_pattern
FROM names""")
def q_file_pattern(spark, sf):
    n = D.file_names(spark, sf)
    return n.select("p_partkey", "name", N.file_pattern("name").alias("file_pattern"))


@register("sanitize_table_name", f"""{NAMES}
SELECT p_partkey, name, {O.sanitize('name')} AS sanitized FROM names""")
def q_sanitize_table(spark, sf):
    n = D.file_names(spark, sf)
    return n.select("p_partkey", "name", N.sanitize_table_name("name").alias("sanitized"))


_BASE = "regexp_replace(name, '(?i)(\\.(csv|gz|zip))+$', '')"


@register("table_name_from_file", f"""{NAMES}
SELECT p_partkey, name,
  substring(CASE WHEN {O.sanitize(_BASE)} = '' THEN 'csv_data' ELSE {O.sanitize(_BASE)} END, 1, 63) AS table_name
FROM names""")
def q_table_from_file(spark, sf):
    n = D.file_names(spark, sf)
    return n.select("p_partkey", "name", N.table_name_from_file("name").alias("table_name"))


@register("default_table_name", f"""{NAMES}
SELECT p_partkey, name, lower(regexp_replace({O.stem('name')}, '[^a-zA-Z0-9_]', '_', 'g')) AS table_name FROM names""")
def q_default_table(spark, sf):
    n = D.file_names(spark, sf)
    return n.select("p_partkey", "name", N.default_table_name("name").alias("table_name"))


_COLIN = "CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) || ' ' || name ELSE name END"


@register("sanitize_column_name", f"""{NAMES}
SELECT p_partkey, raw,
  CASE WHEN regexp_matches({O.sanitize('raw')}, '^\\d') THEN 'col_' || {O.sanitize('raw')} ELSE {O.sanitize('raw')} END AS column_name
FROM (SELECT p_partkey, {_COLIN} AS raw FROM names)""")
def q_sanitize_column(spark, sf):
    n = D.file_names(spark, sf)
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" "), "name")) \
        .otherwise(F.col("name"))
    return n.select("p_partkey", raw.alias("raw")).select(
        "p_partkey", "raw", N.sanitize_column_name("raw").alias("column_name"))


_REQ = "CASE p_partkey % 5 WHEN 0 THEN 'CSV' WHEN 1 THEN ' tsv ' WHEN 2 THEN 'json' WHEN 3 THEN '' ELSE NULL END"


def _req_col():
    k = F.col("p_partkey") % 5
    return F.when(k == 0, F.lit("CSV")).when(k == 1, F.lit(" tsv ")).when(k == 2, F.lit("json")) \
        .when(k == 3, F.lit("")).otherwise(F.lit(None).cast("string"))


@register("detect_format", f"""{NAMES}
SELECT p_partkey, name, requested,
  CASE WHEN requested IS NULL OR trim(requested) = '' THEN
         CASE WHEN ends_with(lower(name), '.tsv') THEN 'tsv' WHEN ends_with(lower(name), '.csv') THEN 'csv' ELSE 'tsv' END
       WHEN lower(trim(requested)) IN ('csv', 'tsv') THEN lower(trim(requested)) ELSE 'invalid' END AS format
FROM (SELECT p_partkey, name, {_REQ} AS requested FROM names)""")
def q_detect_format(spark, sf):
    n = D.file_names(spark, sf).select("p_partkey", "name", _req_col().alias("requested"))
    return n.select("p_partkey", "name", "requested", N.detect_format("name", "requested").alias("format"))


_FMT = "CASE p_partkey % 4 WHEN 0 THEN 'tsv' WHEN 1 THEN 'CSV' WHEN 2 THEN 'pipe' ELSE 'json' END"


@register("format_options", f"""{NAMES}
SELECT p_partkey, fmt,
  CASE WHEN lower(fmt) = 'tsv' THEN chr(9) WHEN lower(fmt) = 'pipe' THEN '|' ELSE ',' END AS delimiter,
  lower(fmt) <> 'tsv' AS has_header
FROM (SELECT p_partkey, {_FMT} AS fmt FROM names)""")
def q_format_options(spark, sf):
    k = F.col("p_partkey") % 4
    fmt = F.when(k == 0, F.lit("tsv")).when(k == 1, F.lit("CSV")).when(k == 2, F.lit("pipe")).otherwise(F.lit("json"))
    n = D.file_names(spark, sf).select("p_partkey", fmt.alias("fmt"))
    return n.select("p_partkey", "fmt", N.format_delimiter("fmt").alias("delimiter"),
                    N.format_has_header("fmt").alias("has_header"))


ALLOWED = ("csv", "tsv", "")
_SIZE = "CAST((p_size - 1) * 100 AS BIGINT)"
_NOEXT = "(strpos(name, '.') = 0 OR ends_with(name, '.'))"
_OK = f"({_NOEXT} OR ends_with(lower(name), '.csv') OR ends_with(lower(name), '.tsv'))"
_REASON = (f"CASE WHEN size IS NULL OR size <= 0 THEN 'File is empty or not provided' "
           f"WHEN name IS NULL OR trim(name) = '' THEN 'Invalid filename' "
           f"WHEN NOT {_OK} THEN printf('Invalid file type. Expected %s file but received ''%s''. Please upload a valid file.', "
           f"'CSV, TSV, (no extension)', name) END")


@register("admit_file", f"""{NAMES}
SELECT p_partkey, name, size, {_REASON} AS reason, ({_REASON}) IS NULL AS admitted
FROM (SELECT p_partkey, name, {_SIZE} AS size FROM names)""")
def q_admit_file(spark, sf):
    n = D.file_names(spark, sf).select(
        "p_partkey", "name", ((F.col("p_size") - 1) * 100).cast("long").alias("size"))
    return A.admit(n, allowed=ALLOWED).select("p_partkey", "name", "size", "reason", "admitted")


@register("admit_files", f"""{NAMES}, f AS (
  SELECT p_brand AS request_id, p_partkey AS position_key, name, {_SIZE} AS size FROM names),
r AS (SELECT *, {_REASON} AS reason FROM f),
firstbad AS (SELECT request_id, min(position_key) FILTER (WHERE reason IS NOT NULL) AS bad_key,
                    count(*) AS file_count FROM r GROUP BY request_id)
SELECT fb.request_id, fb.file_count, fb.bad_key IS NULL AS admitted,
  CASE WHEN fb.bad_key IS NOT NULL THEN printf('File #%d validation failed: %s',
       (SELECT count(*) FROM r r2 WHERE r2.request_id = fb.request_id AND r2.position_key <= fb.bad_key),
       (SELECT r3.reason FROM r r3 WHERE r3.request_id = fb.request_id AND r3.position_key = fb.bad_key)) END AS message
FROM firstbad fb""")
def q_admit_files(spark, sf):
    n = D.file_names(spark, sf).select(
        F.col("p_brand").alias("request_id"), F.col("p_partkey").alias("position_key"), "name",
        ((F.col("p_size") - 1) * 100).cast("long").alias("size"))
    return A.admit_all(n, allowed=ALLOWED)


@register("marker_names", f"""{NAMES}
SELECT p_partkey, name, name || '.done' AS marker,
  CASE WHEN ends_with(name, '.done') THEN substring(name, 1, length(name) - 5) ELSE name END AS data_name
FROM names""")
def q_marker_names(spark, sf):
    n = D.file_names(spark, sf)
    return n.select("p_partkey", "name", N.marker_name("name").alias("marker"),
                    N.data_name_of_marker("name").alias("data_name"))


@register("supported_extension", f"""{NAMES}
SELECT p_partkey, name, lower({O.ext('name')}) IN ('.csv', '.zip', '') AS supported FROM names""")
def q_supported_ext(spark, sf):
    n = D.file_names(spark, sf)
    return n.select("p_partkey", "name", N.supported_extension("name").alias("supported"))


@register("archive_entry_filter", f"""{NAMES}
SELECT p_partkey, name,
  ends_with(lower(name), '.csv') OR ends_with(lower(name), '.tsv') OR regexp_full_match(name, '{N.ARCHIVE_ENTRY_NAME}') AS load_mode,
  ends_with(lower(name), '.csv') OR ends_with(lower(name), '.tsv') OR regexp_full_match({O.stem('name')}, '{N.ARCHIVE_ENTRY_NAME}') AS analysis_mode
FROM names""")
def q_entry_filter(spark, sf):
    n = D.file_names(spark, sf)
    return n.select("p_partkey", "name", N.is_data_entry("name", "load").alias("load_mode"),
                    N.is_data_entry("name", "analysis").alias("analysis_mode"))


_TSNAME = "event_type || CASE event_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '' ELSE '.tar.gz' END"


@register("timestamped_name", f"""
SELECT event_id, {_TSNAME} AS name,
  {O.stem(_TSNAME)} || '_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || {O.ext(_TSNAME)} AS archived_name
FROM events""")
def q_timestamped(spark, sf):
    e = D.table(spark, sf, "events")
    k = F.col("event_id") % 3
    name = F.concat("event_type", F.when(k == 0, F.lit(".csv")).when(k == 1, F.lit("")).otherwise(F.lit(".tar.gz")))
    return e.select("event_id", name.alias("name"), "ts").select(
        "event_id", "name", N.timestamped_name("name", "ts").alias("archived_name"))


@register("count_fields", f"""
WITH t AS (SELECT o_orderkey, concat_ws(chr(9), o_orderstatus, o_orderpriority, o_clerk_free) AS line FROM
  (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS o_clerk_free FROM orders))
SELECT o_orderkey, fmt,
  CAST(CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, d, '')) + 1 END AS INTEGER) AS field_count
FROM (SELECT o_orderkey, line, fmt, CASE fmt WHEN 'tsv' THEN chr(9) WHEN 'pipe' THEN '|' ELSE ',' END AS d
      FROM t, (VALUES ('tsv'), ('csv'), ('pipe')) AS f(fmt))""")
def q_count_fields(spark, sf):
    o = D.table(spark, sf, "orders")
    free = F.when(F.col("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.col("o_custkey").cast("string"))
    t = o.select("o_orderkey", F.concat_ws("\t", "o_orderstatus", "o_orderpriority", free).alias("line"))
    out = None
    for fmt, d in (("tsv", "\t"), ("csv", ","), ("pipe", "|")):
        part = t.select("o_orderkey", F.lit(fmt).alias("fmt"), tx.count_fields("line", d).alias("field_count"))
        out = part if out is None else out.unionByName(part)
    return out


def _registry_values():
    from .. import schemas
    rows = []
    for t, cols in schemas.TABLES.items():
        for i, c in enumerate(cols, start=1):
            rows.append(f"('{t}', {i}, '{c.name}', '{c.kind}', {c.width if c.width else 'NULL'}, "
                        f"{'TRUE' if c.required else 'FALSE'})")
    return "(VALUES " + ", ".join(rows) + ") AS reg(table_name, position, column_name, kind, width, required)"


@register("schema_registry", f"""{NAMES}, routed AS (
  SELECT DISTINCT CASE WHEN regexp_full_match({O.stem('name')}, '{ROUTE_RE}')
    THEN lower(regexp_extract({O.stem('name')}, '{ROUTE_RE}', 1) || regexp_extract({O.stem('name')}, '{ROUTE_RE}', 2)) END AS table_name
  FROM names)
SELECT reg.table_name, CAST(reg.position AS INTEGER) AS position, reg.column_name, reg.kind,
       CAST(reg.width AS INTEGER) AS width, reg.required
FROM routed JOIN {_registry_values()} ON routed.table_name = reg.table_name""")
def q_schema_registry(spark, sf):
    from ..operators.tables import registry_columns
    routed = D.file_names(spark, sf).select(N.route_table("name").alias("table_name")).distinct()
    return routed.join(registry_columns(spark), "table_name")
