"""Queries over manifests, archive results, dedupe, roll-ups and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..functions import names as N
from ..operators import manifest as M
from ..operators import store
from ..operators import validate as V
from ..session import scratch_path
from . import derived as D
from . import oracle as O
from .registry import register, validated

ROUTE = N.ROUTING_REGEX


def _route_sql(x):
    return (f"CASE WHEN regexp_full_match({O.stem(x)}, '{ROUTE}') THEN lower(regexp_extract({O.stem(x)}, '{ROUTE}', 1) "
            f"|| regexp_extract({O.stem(x)}, '{ROUTE}', 2)) END")


_FN = "'PM' || CAST(event_id % 7 + 1 AS VARCHAR) || '62'"
_DONE = "CASE WHEN event_type IN ('purchase', 'error') THEN ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) END"
MANIFEST = f"""
SELECT CAST(event_id AS VARCHAR) AS batch_id, CAST(user_id AS VARCHAR) AS parent_batch_id,
  {_FN} AS file_name, 'upload://' || {_FN} AS file_path, CAST(length(props) AS BIGINT) AS file_size_bytes,
  sha256(props) AS file_checksum, {_route_sql(_FN)} AS table_name,
  CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PROCESSING'
       WHEN 'click' THEN 'PENDING' ELSE 'DUPLICATE' END AS status,
  CAST(floor(value) AS BIGINT) AS total_records,
  CAST(CASE WHEN event_type = 'purchase' THEN floor(value) WHEN event_type = 'view' THEN floor(value * 1.5) ELSE 0 END AS BIGINT)
    AS processed_records,
  CAST(0 AS BIGINT) AS failed_records,
  CASE WHEN event_type = 'error' THEN 'REJECTED' ELSE 'CLEAN' END AS data_quality_status,
  ts AS created_at, ts AS started_at, {_DONE} AS completed_at,
  CASE WHEN event_type = 'error' THEN 'Load failed for event ' || CAST(event_id AS VARCHAR) END AS error_message,
  CASE WHEN event_type = 'error' THEN props END AS error_details,
  'system' AS created_by,
  epoch_ms({_DONE}) - epoch_ms(ts) AS processing_duration_ms
FROM events"""

ENTRIES = """
SELECT CAST(o_custkey AS VARCHAR) AS parent_batch_id, CAST(o_orderkey AS VARCHAR) AS batch_id,
  'PM' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || '62' AS filename,
  CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'P' THEN 'DUPLICATE' ELSE 'SUCCESS' END AS status,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS rows, o_orderdate AS created_at,
  CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS duplicate_of,
  o_orderdate AS original_completed_at,
  CASE WHEN o_orderstatus = 'F' THEN 'Load failed for order ' || CAST(o_orderkey AS VARCHAR) END AS error_message
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) li
  ON o_orderkey = li.l_orderkey"""

_DFN = f"CASE lang {' '.join(f'WHEN {O.lit(l)} THEN {O.lit(p)}' for l, p in D.LANG_PATTERN)} ELSE '{D.OTHER_PATTERN}' END || '{D.OFFICE}'"
DOC_MANIFEST = f"""
SELECT CAST(doc_id AS VARCHAR) AS batch_id, CAST(NULL AS VARCHAR) AS parent_batch_id, {_DFN} AS file_name,
  CAST(octet_length(encode(text)) AS BIGINT) AS file_size_bytes, sha256(text) AS file_checksum,
  {_route_sql(_DFN)} AS table_name, doc_id AS arrival, 'docs/' || CAST(doc_id AS VARCHAR) AS path
FROM documents"""

WM = f"WITH m AS ({MANIFEST})"
WE = f"WITH e AS ({ENTRIES})"


def _m(spark, sf):
    return D.manifest_from_events(spark, sf)


# ------------------------------------------------------------------ lookups

@register("manifest_lookup", f"""{WM}
SELECT 'status_in' AS lookup, batch_id, status, created_at FROM m WHERE status IN ('COMPLETED', 'FAILED')
UNION ALL SELECT 'top_level', batch_id, status, created_at FROM m WHERE parent_batch_id IS NULL
UNION ALL SELECT 'by_batch', batch_id, status, created_at FROM m WHERE batch_id = '42'
UNION ALL SELECT 'children', batch_id, status, created_at FROM m WHERE parent_batch_id = '7'""")
def q_manifest_lookup(spark, sf):
    m = _m(spark, sf)
    pick = lambda df, tag: df.select(F.lit(tag).alias("lookup"), "batch_id", "status", "created_at")
    return pick(M.find_by_status(m, "COMPLETED", "FAILED"), "status_in") \
        .unionByName(pick(M.top_level(m), "top_level")) \
        .unionByName(pick(M.find_by_batch(m, "42"), "by_batch")) \
        .unionByName(pick(M.children(m, "7"), "children"))


@register("manifest_orderings", f"""{WM}
SELECT parent_batch_id, batch_id, created_at FROM m WHERE parent_batch_id IS NOT NULL""")
def q_manifest_orderings(spark, sf):
    return M.children(_m(spark, sf)).select("parent_batch_id", "batch_id", "created_at")


@register("status_view", f"""{WM}
SELECT batch_id, file_name, table_name, status, total_records, processed_records, failed_records,
  CASE WHEN total_records IS NULL OR total_records = 0 THEN 0.0
       ELSE CAST(processed_records AS DOUBLE) / CAST(total_records AS DOUBLE) * 100.0 END AS completion_percentage,
  started_at, completed_at, processing_duration_ms, error_message
FROM m""")
def q_status_view(spark, sf):
    return M.status_view(_m(spark, sf))


@register("completion_pct", f"""{WM}
SELECT batch_id, CASE WHEN total_records IS NULL OR total_records = 0 THEN 0.0
       ELSE CAST(processed_records AS DOUBLE) / CAST(total_records AS DOUBLE) * 100.0 END AS completion_percentage FROM m""")
def q_completion_pct(spark, sf):
    return _m(spark, sf).select("batch_id", M.completion_pct().alias("completion_percentage"))


@register("duration_ms", f"""{WM}
SELECT batch_id, processing_duration_ms FROM m""")
def q_duration_ms(spark, sf):
    return _m(spark, sf).select("batch_id", "processing_duration_ms")


_CHECKS = [
    ("file_size_non_negative", "file_size_bytes >= 0"),
    ("total_records_non_negative", "total_records >= 0"),
    ("processed_records_non_negative", "processed_records >= 0"),
    ("failed_records_non_negative", "failed_records >= 0"),
    ("processed_plus_failed_le_total", "processed_records + failed_records <= total_records"),
]
_BROKEN = "list_filter([" + ", ".join(f"CASE WHEN NOT coalesce({c}, TRUE) THEN '{n}' END" for n, c in _CHECKS) \
    + "], lambda x: x IS NOT NULL)"


@register("manifest_constraints", f"""{WM}
SELECT batch_id, status, broken_checks FROM (SELECT *, {_BROKEN} AS broken_checks FROM m) WHERE len(broken_checks) > 0""")
def q_constraints(spark, sf):
    return M.manifest_constraints(_m(spark, sf)).select("batch_id", "status", "broken_checks")


@register("latest_per_checksum", f"""{WM},
a AS (SELECT file_checksum, batch_id, created_at, status,
        row_number() OVER (PARTITION BY file_checksum ORDER BY created_at DESC, batch_id DESC, status DESC) AS rn FROM m),
d AS (SELECT file_checksum, batch_id,
        row_number() OVER (PARTITION BY file_checksum ORDER BY created_at DESC, batch_id DESC) AS rn
      FROM m WHERE status = 'COMPLETED')
SELECT a.file_checksum, a.batch_id AS latest_batch_id, a.created_at AS latest_created_at, a.status AS latest_status,
       d.batch_id AS latest_completed_batch_id
FROM a LEFT JOIN d ON a.file_checksum = d.file_checksum AND d.rn = 1 WHERE a.rn = 1""")
def q_latest(spark, sf):
    return M.latest_per_checksum(_m(spark, sf))


@register("processing_stats", f"""{WM}
SELECT count(*) AS total_batches, CAST(count_if(status = 'COMPLETED') AS BIGINT) AS completed_batches,
  CAST(count_if(status = 'FAILED') AS BIGINT) AS failed_batches,
  CAST(count_if(status = 'PROCESSING') AS BIGINT) AS processing_batches,
  CAST(coalesce(sum(total_records), 0) AS BIGINT) AS total_records_processed
FROM m WHERE status IN ('COMPLETED', 'FAILED', 'PROCESSING')""")
def q_stats(spark, sf):
    return M.processing_stats(_m(spark, sf))


@register("count_by_status", f"""{WM}
SELECT status, count(*) AS batch_count FROM m GROUP BY status""")
def q_count_status(spark, sf):
    return M.count_by_status(_m(spark, sf))


@register("exists_by_checksum", f"""WITH dm AS ({DOC_MANIFEST}),
known AS (SELECT DISTINCT file_checksum FROM dm WHERE arrival % 2 = 0)
SELECT batch_id, file_checksum, file_checksum IN (SELECT file_checksum FROM known) AS exists FROM dm""")
def q_exists(spark, sf):
    dm = D.doc_manifest(spark, sf)
    return M.exists_by_checksum(dm.select("batch_id", "file_checksum"), dm.where(F.col("arrival") % 2 == 0))


_ORIG = """orig AS (SELECT file_checksum, batch_id AS original_batch_id, total_records AS original_total_records,
          completed_at AS original_completed_at, table_name AS original_table_name FROM (
   SELECT *, row_number() OVER (PARTITION BY file_checksum ORDER BY created_at DESC, batch_id DESC) AS rn
   FROM m WHERE status = 'COMPLETED') WHERE rn = 1)"""


@register("dedupe_against_manifest", f"""{WM}, {_ORIG}
SELECT i.batch_id, i.file_checksum, o.original_batch_id, o.original_batch_id IS NOT NULL AS already_processed
FROM m i LEFT JOIN orig o USING (file_checksum) WHERE i.status = 'PENDING'""")
def q_dedupe_manifest(spark, sf):
    m = _m(spark, sf)
    incoming = m.where(F.col("status") == "PENDING").select("batch_id", "file_checksum")
    return M.dedupe_against_manifest(incoming, m).select(
        "batch_id", "file_checksum", "original_batch_id", "already_processed")


@register("dedupe_within_run", f"""WITH dm AS ({DOC_MANIFEST}),
f AS (SELECT file_checksum, arg_min(arrival, (arrival, path)) AS first_arrival, arg_min(path, (arrival, path)) AS first_path
      FROM dm GROUP BY file_checksum)
SELECT batch_id, dm.file_checksum, first_arrival, first_path,
       NOT (arrival = first_arrival AND path = first_path) AS is_duplicate
FROM dm JOIN f USING (file_checksum)""")
def q_dedupe_run(spark, sf):
    dm = D.doc_manifest(spark, sf)
    return M.dedupe_within_run(dm).select("batch_id", "file_checksum", "first_arrival", "first_path",
                                          "is_duplicate")


@register("parent_child_join", f"""{WM}
SELECT c.parent_batch_id, c.batch_id AS child_batch_id, c.status AS child_status, c.file_name AS child_file_name,
       p.status AS parent_status, p.file_name AS parent_file_name
FROM m c JOIN m p ON c.parent_batch_id = p.batch_id""")
def q_parent_child(spark, sf):
    return M.parent_child(_m(spark, sf))


@register("issues_by_batch_join", f"""WITH dm AS ({DOC_MANIFEST}), {O.base_ctes()}, i AS ({O.issues_sql('v')})
SELECT dm.batch_id, dm.file_checksum, i.line_number, i.issue_seq, i.issue_type, i.severity
FROM dm JOIN i ON dm.batch_id = i.batch_id""")
def q_issues_by_batch(spark, sf):
    from ..operators.report import issues_by_batch
    dm = D.doc_manifest(spark, sf).select("batch_id", "file_checksum")
    i = V.validation_issues(validated(spark, sf)).select("batch_id", "line_number", "issue_seq", "issue_type",
                                                        "severity")
    return issues_by_batch(dm, i)


@register("file_checksum", """
SELECT source, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS file_checksum,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS file_size_bytes FROM documents GROUP BY source""")
def q_checksum(spark, sf):
    """The documents as one file per source, hashed as files."""
    from ..sources import files as FS
    from .q_sources import SOURCE, write_doc_files
    found = FS.file_checksums(FS.binary_files(spark, write_doc_files(spark, sf)))
    return found.select(F.regexp_extract("path", SOURCE, 1).alias("source"), "file_checksum", F.col("length").alias("file_size_bytes"))


# ------------------------------------------------------------------ lifecycle

@register("manifest_open", f"""WITH dm AS ({DOC_MANIFEST})
SELECT batch_id, parent_batch_id, file_name, 'upload://' || file_name AS file_path, CAST(NULL AS VARCHAR) AS content_type,
  file_size_bytes, file_checksum, table_name, 'PROCESSING' AS status,
  CAST(0 AS BIGINT) AS total_records, CAST(0 AS BIGINT) AS processed_records, CAST(0 AS BIGINT) AS failed_records,
  CAST(0 AS BIGINT) AS corrected_records, 0 AS warning_count, 0 AS error_count, 'CLEAN' AS data_quality_status,
  'system' AS created_by
FROM dm""")
def q_open(spark, sf):
    return M.open_manifest(D.doc_manifest(spark, sf)).drop("created_at", "started_at")


def _outcome(spark, sf):
    v = validated(spark, sf)
    ci = lambda c: (F.col(c) > 0).cast("int")
    n_clean = ci("n_control") + ci("n_non_latin") + ci("n_collapsed")
    fixed = n_clean + F.col("tab_fixed").cast("int")
    return v.groupBy("batch_id").agg(
        F.count("*").cast("long").alias("loaded_rows"),
        F.sum(fixed).cast("long").alias("corrected_records"),
        F.sum(fixed).cast("int").alias("warning_count"),
        F.sum((F.col("tab_issue").isNotNull() & ~F.col("tab_fixed")).cast("int")).cast("int").alias("error_count"),
        F.sum(n_clean + F.col("tab_issue").isNotNull().cast("int")).cast("long").alias("issue_count"),
        F.max(F.coalesce(F.col("tab_severity") == "CRITICAL", F.lit(False))).alias("rejected"),
        F.lit(False).alias("load_failed"),
        F.lit(None).cast("string").alias("error_message"),
    )


_OUTCOME_SQL = f"""{O.base_ctes()},
oc AS (SELECT batch_id, count(*) AS loaded_rows,
  sum((n_control > 0)::INT + (n_non_latin > 0)::INT + (n_collapsed > 0)::INT + tab_fixed::INT) AS fx,
  sum((tab_issue IS NOT NULL AND NOT tab_fixed)::INT) AS er,
  sum((n_control > 0)::INT + (n_non_latin > 0)::INT + (n_collapsed > 0)::INT + (tab_issue IS NOT NULL)::INT) AS issue_count,
  bool_or(coalesce(tab_severity = 'CRITICAL', FALSE)) AS rejected FROM v GROUP BY batch_id)"""


@register("manifest_close", f"""WITH dm AS ({DOC_MANIFEST}), {_OUTCOME_SQL}
SELECT dm.batch_id, parent_batch_id, file_name, 'upload://' || file_name AS file_path, CAST(NULL AS VARCHAR) AS content_type,
  file_size_bytes, file_checksum, table_name,
  CASE WHEN rejected THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CAST(CASE WHEN rejected THEN 0 ELSE loaded_rows END AS BIGINT) AS total_records,
  CAST(CASE WHEN rejected THEN 0 ELSE loaded_rows END AS BIGINT) AS processed_records,
  CAST(0 AS BIGINT) AS failed_records, CAST(fx AS BIGINT) AS corrected_records, CAST(fx AS INTEGER) AS warning_count,
  CAST(er AS INTEGER) AS error_count,
  CASE WHEN rejected THEN 'REJECTED' ELSE {O.quality_case('fx', 'fx', 'er')} END AS data_quality_status,
  CASE WHEN rejected THEN printf('{M.REJECT_MESSAGE}', issue_count) END AS error_message,
  CASE WHEN rejected THEN printf('{M.REJECT_DETAILS}', dm.batch_id) END AS error_details,
  'system' AS created_by
FROM dm LEFT JOIN oc USING (batch_id)""")
def q_close(spark, sf):
    opened = M.open_manifest(D.doc_manifest(spark, sf))
    return M.close_manifest(opened, _outcome(spark, sf)).drop(
        "created_at", "started_at", "completed_at", "processing_duration_ms", "updated_at")


@register("manifest_upsert", f"""{WM}
SELECT batch_id, CASE WHEN status = 'PROCESSING' THEN 'COMPLETED' ELSE status END AS status,
  CASE WHEN status = 'PROCESSING' THEN total_records ELSE processed_records END AS processed_records,
  CASE WHEN status = 'PROCESSING' THEN 'updated' ELSE 'unchanged' END AS change
FROM m WHERE NOT (status = 'PENDING' AND CAST(batch_id AS BIGINT) % 10 = 0)""")
def q_manifest_upsert(spark, sf):
    """The stored manifest after its first write and an upsert that closes the PROCESSING rows; deletions and changes are read from it."""
    m = _m(spark, sf)
    rows = m.select("batch_id", "file_checksum", "status", "processed_records", "total_records")
    folder = scratch_path(spark, f"manifest/{uuid.uuid4().hex}")
    store.upsert_stored(folder, rows)
    store.upsert_stored(folder, rows.where(F.col("status") == "PROCESSING").select(
        "batch_id", "file_checksum", F.lit("COMPLETED").alias("status"), F.col("total_records").alias("processed_records"), "total_records"))
    now = store.read_stored(spark, folder).select("batch_id", "status", "processed_records", "total_records")
    dele = m.where((F.col("status") == "PENDING") & (F.col("batch_id").cast("long") % 10 == 0)).select("batch_id")
    before = rows.select("batch_id", "status", "processed_records", "total_records")
    upd = now.join(before.select("batch_id", F.col("status").alias("was")), "batch_id").where("was <> status").select("batch_id", "status", "processed_records")
    return M.manifest_upsert(before, upd, delete_keys=dele).select("batch_id", "status", "processed_records", "change")


# ------------------------------------------------------------------ archive results

def _results(spark, sf):
    return M.file_results(D.archive_entries(spark, sf))


_RESULTS = f"""{WE}, r AS (
SELECT parent_batch_id, filename,
  {_route_sql('filename')} AS table_name, status,
  CAST(CASE WHEN status = 'FAILED' THEN 0 ELSE rows END AS BIGINT) AS rows_loaded, 0 AS columns_created,
  CASE WHEN status = 'DUPLICATE' THEN printf('File already processed in batch %s. Original upload completed on %s.',
         duplicate_of, coalesce(strftime(original_completed_at, '%Y-%m-%d %H:%M:%S'), 'unknown'))
       WHEN status = 'FAILED' THEN error_message END AS error_message
FROM e)"""


@register("file_result", f"""{_RESULTS}
SELECT * FROM r""")
def q_file_result(spark, sf):
    return _results(spark, sf)


_STATUS = ("CASE WHEN f = 0 AND d = 0 THEN 'SUCCESS' WHEN f = 0 AND d > 0 AND s > 0 THEN 'PARTIAL_SUCCESS' "
           "WHEN f = 0 AND d > 0 AND s = 0 THEN 'ALL_DUPLICATES' WHEN f > 0 AND s > 0 THEN 'PARTIAL_SUCCESS' "
           "ELSE 'FAILED' END")


@register("batch_rollup", f"""{_RESULTS}
SELECT parent_batch_id, total_files, s AS successful_files, f AS failed_files, d AS duplicate_files,
  total_rows_loaded, parent_total_records, {_STATUS} AS processing_status FROM (
SELECT parent_batch_id, count(*) AS total_files, CAST(count_if(status = 'SUCCESS') AS BIGINT) AS s,
  CAST(count_if(status = 'FAILED') AS BIGINT) AS f, CAST(count_if(status = 'DUPLICATE') AS BIGINT) AS d,
  CAST(coalesce(sum(CASE WHEN status = 'SUCCESS' THEN rows_loaded END), 0) AS BIGINT) AS total_rows_loaded,
  CAST(coalesce(sum(rows_loaded), 0) AS BIGINT) AS parent_total_records
FROM r GROUP BY parent_batch_id)""")
def q_rollup(spark, sf):
    return M.batch_rollup(_results(spark, sf))


@register("batch_status", f"""{_RESULTS}
SELECT parent_batch_id, {_STATUS} AS processing_status FROM (
SELECT parent_batch_id, count_if(status = 'SUCCESS') AS s, count_if(status = 'FAILED') AS f,
  count_if(status = 'DUPLICATE') AS d FROM r GROUP BY parent_batch_id)""")
def q_batch_status(spark, sf):
    return M.batch_rollup(_results(spark, sf)).select("parent_batch_id", "processing_status")


@register("validation_summary", f"""{_RESULTS}
SELECT parent_batch_id,
  CAST(count_if(status = 'SUCCESS' AND rows_loaded > 0) AS BIGINT) AS tables_ready_for_production,
  CAST(count_if((status = 'SUCCESS' AND rows_loaded <= 0) OR (status <> 'SUCCESS' AND status <> 'DUPLICATE')) AS BIGINT)
    AS tables_requiring_review,
  CAST(count_if((status = 'SUCCESS' AND rows_loaded <= 0) OR status = 'FAILED') AS BIGINT) AS data_quality_issue_count
FROM r GROUP BY parent_batch_id""")
def q_validation_summary(spark, sf):
    return M.validation_summary(_results(spark, sf)).select(
        "parent_batch_id", "tables_ready_for_production", "tables_requiring_review", "data_quality_issue_count")


@register("validation_summary_issues", f"""{_RESULTS}
SELECT parent_batch_id, filename, CASE WHEN status = 'SUCCESS' THEN printf('File %s contains no data rows', filename)
  ELSE printf('Failed to process: %s - %s', filename, coalesce(error_message, 'null')) END AS issue
FROM r WHERE (status = 'SUCCESS' AND rows_loaded <= 0) OR status = 'FAILED'""")
def q_validation_summary_issues(spark, sf):
    return M.validation_summary_issues(_results(spark, sf))


@register("duplicate_result", f"""{WM}, {_ORIG}
SELECT i.batch_id, i.file_name, i.file_checksum, i.file_size_bytes, 'ALREADY_PROCESSED' AS processing_status,
  'DUPLICATE' AS manifest_status, o.original_batch_id, o.original_total_records AS total_records,
  o.original_table_name AS table_name,
  printf('Duplicate of batch %s (processed on %s)', o.original_batch_id,
         strftime(o.original_completed_at, '%Y-%m-%d %H:%M:%S.%f')) AS error_message
FROM m i JOIN orig o USING (file_checksum) WHERE i.status = 'PENDING'""")
def q_duplicate_result(spark, sf):
    m = _m(spark, sf)
    return M.duplicate_result(m.where(F.col("status") == "PENDING"), m)


@register("entry_presence_join", f"""{WE}
SELECT e.parent_batch_id || '/' || e.batch_id || '/' || e.filename AS relative_path,
  x.batch_id IS NOT NULL AS found,
  CASE WHEN x.batch_id IS NULL THEN 'FAILED' ELSE e.status END AS status,
  CASE WHEN x.batch_id IS NULL THEN 'File not found in extracted directory' END AS error_message
FROM e LEFT JOIN (SELECT batch_id FROM e WHERE CAST(batch_id AS BIGINT) % 11 <> 0) x ON e.batch_id = x.batch_id""")
def q_entry_presence(spark, sf):
    e = D.archive_entries(spark, sf)
    analysed = e.select(F.concat_ws("/", "parent_batch_id", "batch_id", "filename").alias("relative_path"),
                        "batch_id", "status")
    extracted = e.where(F.col("batch_id").cast("long") % 11 != 0) \
        .select(F.concat_ws("/", "parent_batch_id", "batch_id", "filename").alias("relative_path"))
    return M.entry_presence(analysed, extracted)


# ------------------------------------------------------------------ tables

_KNOWN = "(" + ", ".join(f"'{t}'" for t in schemas.KNOWN_TABLES) + ")"


@register("table_exists_flag", f"""{WE}
SELECT batch_id, {_route_sql('filename')} AS table_name, coalesce({_route_sql('filename')} IN {_KNOWN}, FALSE) AS table_exists
FROM e""")
def q_table_exists(spark, sf):
    from ..operators.tables import with_table_exists
    e = D.archive_entries(spark, sf).select("batch_id", N.route_table("filename").alias("table_name"))
    return with_table_exists(e, spark)


@register("recommendations", f"""{WE}, x AS (
SELECT parent_batch_id, count(*) AS files,
  CAST(count_if(NOT coalesce({_route_sql('filename')} IN {_KNOWN}, FALSE)) AS BIGINT) AS new_tables,
  CAST(sum(rows) AS BIGINT) AS total_estimated_rows FROM e GROUP BY parent_batch_id)
SELECT parent_batch_id, new_tables, files - new_tables AS existing_tables, total_estimated_rows,
  list_filter([
    CASE WHEN new_tables > 0 THEN printf('%d new tables will be created', new_tables) END,
    CASE WHEN files - new_tables > 0 THEN printf('%d existing tables will be updated', files - new_tables) END,
    'Estimated total rows to process: ' || format('{{:,}}', total_estimated_rows),
    CASE WHEN total_estimated_rows > 1000000 THEN 'Large dataset detected - consider processing in batches for optimal performance' END,
    'Review table structures before proceeding to production migration'], lambda s: s IS NOT NULL) AS recommendations
FROM x""")
def q_recommendations(spark, sf):
    from ..operators.tables import recommendations, with_table_exists
    e = D.archive_entries(spark, sf).select("parent_batch_id", N.route_table("filename").alias("table_name"),
                                            F.col("rows").alias("estimated_rows"))
    return recommendations(with_table_exists(e, spark))


@register("required_tables_check", f"""{WM}, present AS (SELECT DISTINCT table_name FROM m WHERE table_name IS NOT NULL)
SELECT t AS table_name, t IN (SELECT table_name FROM present) AS table_exists,
  CASE WHEN t IN (SELECT table_name FROM present) THEN 'ok' ELSE 'missing' END AS action
FROM (SELECT unnest([{", ".join(repr(t) for t in schemas.KNOWN_TABLES)}]) AS t)""")
def q_required_tables(spark, sf):
    from ..operators.tables import required_tables_check
    present = _m(spark, sf).where(F.col("table_name").isNotNull()).select("table_name").distinct()
    return required_tables_check(spark, present).select("table_name", "table_exists", "action")


# ------------------------------------------------------------------ folder lifecycle / reports

_LC = f"""{WM}, lc AS (
SELECT batch_id, file_name,
  CASE WHEN {O.ext('file_name')} = '' THEN 'delimited' WHEN lower({O.ext('file_name')}) = '.zip' THEN 'archive'
       ELSE 'unsupported' END AS dispatch,
  CASE WHEN {O.ext('file_name')} <> '' AND lower({O.ext('file_name')}) <> '.zip' THEN 'error'
       WHEN status IN ('COMPLETED', 'DUPLICATE') THEN 'archive' WHEN status = 'PROCESSING' THEN 'wip'
       WHEN status = 'PENDING' THEN 'upload' ELSE 'error' END AS state,
  CASE WHEN {O.ext('file_name')} <> '' AND lower({O.ext('file_name')}) <> '.zip' THEN 'Unsupported file type: ' || {O.ext('file_name')}
       WHEN status NOT IN ('COMPLETED', 'DUPLICATE', 'PROCESSING', 'PENDING') THEN coalesce(error_message, 'Unknown error') END AS error_message,
  created_at
FROM m)"""


@register("lifecycle_state", f"""{_LC}
SELECT * FROM lc""")
def q_lifecycle(spark, sf):
    return M.lifecycle_state(_m(spark, sf))


@register("folder_counts", f"""{_LC}
SELECT state, count(*) AS file_count FROM lc GROUP BY state""")
def q_folder_counts(spark, sf):
    return M.folder_counts(M.lifecycle_state(_m(spark, sf)))


@register("error_report_sink", f"""{WM}
SELECT batch_id, file_name || '.error.json' AS report_name, file_name AS file, file_name AS original_filename,
  'PROCESSING_ERROR' AS error_type, error_message, error_details, file_size_bytes,
  strftime(completed_at, '%Y-%m-%d %H:%M:%S.%f') AS failed_at, TRUE AS retry_recommended,
  'Fix the issue and re-upload with .done marker' AS retry_instructions
FROM m WHERE status = 'FAILED'""")
def q_error_reports(spark, sf):
    m, out = _m(spark, sf), scratch_path(spark, f"reports/{uuid.uuid4().hex}")
    M.write_error_reports(m, out)
    return spark.read.schema(M.error_reports(m).select("batch_id", "report_name", "report.*").schema).json(out)


@register("error_report_list", f"""{WM}
SELECT file_name || '.error.json' AS report_name, file_size_bytes, completed_at AS created FROM m WHERE status = 'FAILED'""")
def q_error_report_list(spark, sf):
    return M.error_report_list(_m(spark, sf))


@register("retry_failed", f"""{_LC}
SELECT batch_id, CASE WHEN state = 'error' AND CAST(batch_id AS BIGINT) % 2 = 0 THEN 'upload' ELSE state END AS state,
  state = 'error' AND CAST(batch_id AS BIGINT) % 2 = 0 AS retried,
  state = 'error' AND CAST(batch_id AS BIGINT) % 2 = 1 AS has_error_report
FROM lc""")
def q_retry(spark, sf):
    lc = M.lifecycle_state(_m(spark, sf))
    retry = lc.where((F.col("state") == "error") & (F.col("batch_id").cast("long") % 2 == 0)).select("batch_id")
    return M.retry_failed(lc, retry).select("batch_id", "state", "retried", "has_error_report")


def _ts_sql(c):
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f')"


_SUMMARY = (
    "'" + M.RULE + "' || chr(10) || 'FILE PROCESING SUMMARY' || chr(10) || '" + M.RULE + "' || chr(10)"
    " || 'File Name: ' || file_name || chr(10) || 'Batch ID: ' || batch_id || chr(10) || 'Status: ' || status || chr(10)"
    " || 'Processing Time (ms): ' || CAST(coalesce(processing_duration_ms, 0) AS VARCHAR) || chr(10)"
    " || 'Success: ' || CASE WHEN status = 'COMPLETED' THEN 'Success' ELSE 'Failure' END || chr(10)"
    " || '" + M.THIN + "' || chr(10) || 'Processing Details:' || chr(10) || '" + M.THIN + "' || chr(10)"
    " || 'Total Records: ' || CAST(coalesce(total_records, 0) AS VARCHAR) || chr(10)"
    " || 'File Size (bytes): ' || CAST(file_size_bytes AS VARCHAR) || chr(10) || '" + M.THIN + "' || chr(10)"
    " || CASE WHEN started_at IS NOT NULL THEN 'Started At: ' || " + _ts_sql("started_at") + " || chr(10) ELSE '' END"
    " || CASE WHEN completed_at IS NOT NULL THEN 'Completed At: ' || " + _ts_sql("completed_at") + " || chr(10) ELSE '' END"
    " || CASE WHEN processing_duration_ms IS NOT NULL THEN 'Processing Processing Duration (ms): ' || "
    "CAST(processing_duration_ms AS VARCHAR) || ' ms (' || printf('%.2f', processing_duration_ms / 1000.0) || ' seconds)' || chr(10) ELSE '' END"
    " || CASE WHEN table_name IS NOT NULL THEN 'Staging Table: ' || table_name || chr(10) ELSE '' END"
    " || chr(10) || '" + M.THIN + "' || chr(10)"
    " || CASE WHEN status <> 'COMPLETED' THEN 'ERROR INFORMATION:' || chr(10) || '" + M.THIN + "' || chr(10)"
    " || CASE WHEN error_message IS NOT NULL THEN 'Error Message: ' || error_message || chr(10) ELSE '' END"
    " || CASE WHEN error_details IS NOT NULL AND error_details <> '' THEN 'Error Details: ' || error_details || chr(10) ELSE '' END"
    " || chr(10) || '" + M.THIN + "' || chr(10) ELSE '' END"
    " || '" + M.RULE + "' || chr(10)")


@register("done_summary_sink", f"""{WM}
SELECT batch_id, file_name || '.done' AS summary_name, {_SUMMARY} AS summary FROM m""")
def q_done_summaries(spark, sf):
    out = scratch_path(spark, f"summaries/{uuid.uuid4().hex}")
    M.write_done_summaries(_m(spark, sf), out)
    return spark.read.parquet(out)
