"""Manifest table operators: lookups, lifecycle transitions, dedupe, roll-ups,
reports and maintenance.

The manifest holds one row per ingestion attempt.  "Latest per key" and
"first per key" are written as ``max``/``min`` over a struct inside one
``groupBy`` -- partial aggregation keeps a checksum shared by a third of all
rows from landing in one task, which a ``row_number`` window would do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

COMPLETED, FAILED, PROCESSING, PENDING, DUPLICATE = "COMPLETED", "FAILED", "PROCESSING", "PENDING", "DUPLICATE"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- scalars

def completion_pct(processed="processed_records", total="total_records") -> Column:
    """processed / total * 100; 0.0 when total is NULL or 0."""
    p, t = _c(processed), _c(total)
    return F.when(t.isNull() | (t == 0), F.lit(0.0)).otherwise(p.cast("double") / t.cast("double") * 100.0)


def duration_ms(started="started_at", completed="completed_at") -> Column:
    """completed - started in whole milliseconds (NULL when either is missing)."""
    return F.unix_millis(_c(completed).cast("timestamp")) - F.unix_millis(_c(started).cast("timestamp"))


# ---------------------------------------------------------------- lookups

def find_by_batch(m: DataFrame, batch_id: str) -> DataFrame:
    return m.where(F.col("batch_id") == batch_id)


def find_by_status(m: DataFrame, *statuses: str) -> DataFrame:
    """Rows in any of ``statuses``, newest first."""
    return m.where(F.col("status").isin(*statuses)).orderBy(F.desc("created_at"))


def top_level(m: DataFrame) -> DataFrame:
    """Manifests without a parent (archives and single files), newest first."""
    return m.where(F.col("parent_batch_id").isNull()).orderBy(F.desc("created_at"))


def children(m: DataFrame, parent_id: str | None = None) -> DataFrame:
    """Children of one parent (or of all parents), oldest first."""
    c = m.where(F.col("parent_batch_id").isNotNull())
    if parent_id is not None:
        c = c.where(F.col("parent_batch_id") == parent_id)
    return c.orderBy("parent_batch_id", "created_at")


def status_view(m: DataFrame) -> DataFrame:
    """Public status projection with completion percentage."""
    return m.select("batch_id", "file_name", "table_name", "status", "total_records", "processed_records",
                    "failed_records", completion_pct().alias("completion_percentage"), "started_at",
                    "completed_at", "processing_duration_ms", "error_message")


def manifest_constraints(m: DataFrame) -> DataFrame:
    """Rows breaking a table check, with the broken rule names."""
    checks = [
        ("file_size_non_negative", F.col("file_size_bytes") >= 0),
        ("total_records_non_negative", F.col("total_records") >= 0),
        ("processed_records_non_negative", F.col("processed_records") >= 0),
        ("failed_records_non_negative", F.col("failed_records") >= 0),
        ("processed_plus_failed_le_total",
         F.col("processed_records") + F.col("failed_records") <= F.col("total_records")),
    ]
    broken = F.filter(F.array(*[F.when(~F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in checks]),
                      lambda x: x.isNotNull())
    return m.withColumn("broken_checks", broken).where(F.size("broken_checks") > 0)


# ---------------------------------------------------------------- latest / dedupe

def latest_per_checksum(m: DataFrame) -> DataFrame:
    """Per checksum: newest manifest (any status) and newest COMPLETED one."""
    key = F.struct("created_at", "batch_id", "status")
    return m.groupBy("file_checksum").agg(
        F.max(key).alias("_any"),
        F.max(F.when(F.col("status") == COMPLETED, F.struct("created_at", "batch_id"))).alias("_done"),
    ).select(
        "file_checksum",
        F.col("_any.batch_id").alias("latest_batch_id"),
        F.col("_any.created_at").alias("latest_created_at"),
        F.col("_any.status").alias("latest_status"),
        F.col("_done.batch_id").alias("latest_completed_batch_id"),
    )


def completed_by_checksum(m: DataFrame) -> DataFrame:
    """One row per checksum that has a COMPLETED manifest: the newest such row."""
    done = m.where(F.col("status") == COMPLETED)
    return done.groupBy("file_checksum").agg(
        F.max(F.struct("created_at", "batch_id", "total_records", "completed_at", "table_name")).alias("_o")
    ).select("file_checksum", F.col("_o.batch_id").alias("original_batch_id"),
             F.col("_o.total_records").alias("original_total_records"),
             F.col("_o.completed_at").alias("original_completed_at"),
             F.col("_o.table_name").alias("original_table_name"))


def dedupe_against_manifest(files: DataFrame, m: DataFrame) -> DataFrame:
    """Mark incoming files ALREADY_PROCESSED when a COMPLETED manifest has their checksum.

    FAILED or other attempts never block a file.  The manifest side is one
    row per checksum, so the join cannot multiply rows.
    """
    orig = completed_by_checksum(m)
    j = files.join(orig, "file_checksum", "left")
    return j.withColumn("already_processed", F.col("original_batch_id").isNotNull())


def dedupe_within_run(files: DataFrame, key: str = "file_checksum", order=("arrival", "path"),
                      eligible: Column | None = None) -> DataFrame:
    """Within one run the first file per checksum (by ``order``) is the original,
    later identical files are duplicates of it.  ``eligible`` limits which
    files may act as originals (e.g. those that passed the gates)."""
    cand = files if eligible is None else files.where(eligible)
    first = cand.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    first = first.select(key, *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order])
    j = files.join(first, key, "left")
    same = None
    for c in order:
        eq = F.col(c).eqNullSafe(F.col(f"first_{c}"))
        same = eq if same is None else same & eq
    return j.withColumn("is_duplicate", F.col(f"first_{order[0]}").isNotNull() & ~same)


def exists_by_checksum(checksums: DataFrame, m: DataFrame) -> DataFrame:
    """Flag each checksum present in the manifest (any status)."""
    known = m.select("file_checksum").distinct().withColumn("exists", F.lit(True))
    return checksums.join(known, "file_checksum", "left") \
        .withColumn("exists", F.coalesce(F.col("exists"), F.lit(False)))


def parent_child(m: DataFrame) -> DataFrame:
    """Each child manifest with its parent row."""
    p = m.select(F.col("batch_id").alias("parent_batch_id"), F.col("status").alias("parent_status"),
                 F.col("file_name").alias("parent_file_name"))
    c = m.where(F.col("parent_batch_id").isNotNull()).select(
        "parent_batch_id", F.col("batch_id").alias("child_batch_id"), F.col("status").alias("child_status"),
        F.col("file_name").alias("child_file_name"))
    return c.join(p, "parent_batch_id")


# ---------------------------------------------------------------- statistics

def processing_stats(m: DataFrame) -> DataFrame:
    """Totals over COMPLETED / FAILED / PROCESSING manifests (one row)."""
    s = F.col("status")
    sel = m.where(s.isin(COMPLETED, FAILED, PROCESSING))
    return sel.agg(
        F.count("*").alias("total_batches"),
        F.count_if(s == COMPLETED).alias("completed_batches"),
        F.count_if(s == FAILED).alias("failed_batches"),
        F.count_if(s == PROCESSING).alias("processing_batches"),
        F.coalesce(F.sum("total_records"), F.lit(0)).cast("long").alias("total_records_processed"),
    )


def count_by_status(m: DataFrame) -> DataFrame:
    return m.groupBy("status").agg(F.count("*").alias("batch_count"))


# ---------------------------------------------------------------- lifecycle

def _now() -> Column:
    return F.current_timestamp().cast("timestamp_ntz")


# Fixed value: where an upload lies.
UPLOAD = "upload://"


def open_manifest(files: DataFrame, created_by: str = "system", started_at: Column | None = None) -> DataFrame:
    """New PROCESSING rows for admitted files (counters 0, quality CLEAN).

    ``file_path`` and ``content_type`` are taken from ``files`` where it has
    them; the path of an upload without one is its name.
    """
    zero = F.lit(0).cast("long")
    given = lambda c: F.col(c) if c in files.columns else F.lit(None).cast("string")
    path = F.coalesce(given("file_path"), F.concat(F.lit(UPLOAD), "file_name")).alias("file_path")
    started = _now() if started_at is None else started_at
    return files.select(
        "batch_id", "parent_batch_id", "file_name", path, given("content_type").alias("content_type"), "file_size_bytes", "file_checksum", "table_name",
        F.lit(PROCESSING).alias("status"), zero.alias("total_records"), zero.alias("processed_records"),
        zero.alias("failed_records"), zero.alias("corrected_records"), F.lit(0).alias("warning_count"),
        F.lit(0).alias("error_count"), F.lit("CLEAN").alias("data_quality_status"),
        F.lit(created_by).alias("created_by"), started.alias("created_at"), started.alias("started_at"))


# Manifest failure wording.
REJECT_MESSAGE = "File rejected: %d critical validation issues found"
REJECT_DETAILS = "See file_validation_issues table for details (batch_id: %s)"


def close_manifest(opened: DataFrame, outcome: DataFrame, completed_at: Column | None = None) -> DataFrame:
    """Apply per-batch outcomes: COMPLETED (total = processed = loaded rows) or FAILED/REJECTED.

    ``outcome``: batch_id, loaded_rows, corrected_records, warning_count,
    error_count, issue_count, rejected (bool), load_failed (bool), error_message.
    """
    from .validate import quality_status
    j = opened.drop("corrected_records", "warning_count", "error_count", "data_quality_status") \
        .join(outcome, "batch_id", "left")
    rejected = F.coalesce(F.col("rejected"), F.lit(False))
    failed = rejected | F.coalesce(F.col("load_failed"), F.lit(False))
    msg = F.when(rejected, F.format_string(REJECT_MESSAGE, F.col("issue_count"))) \
        .otherwise(F.col("error_message"))
    details = F.when(rejected, F.format_string(REJECT_DETAILS, F.col("batch_id")))
    rows = F.when(failed, F.col("total_records")).otherwise(F.coalesce(F.col("loaded_rows"), F.lit(0)).cast("long"))
    return j.select(
        "batch_id", "parent_batch_id", "file_name", *[c for c in ("file_path", "content_type") if c in opened.columns],
        "file_size_bytes", "file_checksum", "table_name",
        F.when(failed, F.lit(FAILED)).otherwise(F.lit(COMPLETED)).alias("status"),
        rows.alias("total_records"),
        F.when(failed, F.col("processed_records")).otherwise(rows).alias("processed_records"),
        "failed_records",
        F.coalesce(F.col("corrected_records"), F.lit(0)).cast("long").alias("corrected_records"),
        F.coalesce(F.col("warning_count"), F.lit(0)).cast("int").alias("warning_count"),
        F.coalesce(F.col("error_count"), F.lit(0)).cast("int").alias("error_count"),
        F.when(failed, F.lit("REJECTED")).otherwise(quality_status(
            F.coalesce(F.col("corrected_records"), F.lit(0)), F.coalesce(F.col("warning_count"), F.lit(0)),
            F.coalesce(F.col("error_count"), F.lit(0)))).alias("data_quality_status"),
        F.when(failed, msg).alias("error_message"),
        F.when(failed, details).alias("error_details"),
        "created_by", "created_at", "started_at",
        (_now() if completed_at is None else completed_at).alias("completed_at"),
    ).withColumn("processing_duration_ms", duration_ms()).withColumn("updated_at", F.col("completed_at"))


def manifest_upsert(current: DataFrame, updates: DataFrame, key: str = "batch_id",
                    delete_keys: DataFrame | None = None) -> DataFrame:
    """Write-back of transitions: update rows matched on ``key``, insert new ones,
    drop ``delete_keys``.  A full outer join with per-column ``coalesce``."""
    cols = [c for c in current.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols if c in updates.columns],
                       F.lit(True).alias("_upd"))
    j = current.withColumn("_old", F.lit(True)).join(u, key, "full_outer")
    out = j.select(key, *[
        (F.when(F.col("_upd"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in updates.columns else F.col(c)).alias(c)
        for c in cols
    ], F.when(F.col("_old").isNull(), F.lit("inserted"))
        .when(F.col("_upd").isNotNull(), F.lit("updated")).otherwise(F.lit("unchanged")).alias("change"))
    if delete_keys is not None:
        out = out.join(delete_keys.select(key), key, "left_anti")
    return out


# ---------------------------------------------------------------- archive results

def file_results(children_df: DataFrame) -> DataFrame:
    """One result row per child: SUCCESS / DUPLICATE / FAILED with rows and message.

    ``children_df``: parent_batch_id, filename, status, rows, duplicate_of,
    original_completed_at, error_message.
    """
    st = F.col("status")
    table = N.route_table("filename")
    msg = F.when(st == "DUPLICATE", F.format_string(
        "File already processed in batch %s. Original upload completed on %s.",
        F.col("duplicate_of"), F.coalesce(F.date_format("original_completed_at", "yyyy-MM-dd HH:mm:ss"),
                                          F.lit("unknown")))) \
        .when(st == "FAILED", F.col("error_message"))
    return children_df.select(
        "parent_batch_id", "filename", table.alias("table_name"), "status",
        F.when(st == "FAILED", F.lit(0)).otherwise(F.col("rows")).cast("long").alias("rows_loaded"),
        F.lit(0).alias("columns_created"), msg.alias("error_message"))


def batch_status(successful, failed, duplicates) -> Column:
    s, f, d = _c(successful), _c(failed), _c(duplicates)
    return F.when((f == 0) & (d == 0), F.lit("SUCCESS")) \
        .when((f == 0) & (d > 0) & (s > 0), F.lit("PARTIAL_SUCCESS")) \
        .when((f == 0) & (d > 0) & (s == 0), F.lit("ALL_DUPLICATES")) \
        .when((f > 0) & (s > 0), F.lit("PARTIAL_SUCCESS")).otherwise(F.lit("FAILED"))


def batch_rollup(results: DataFrame) -> DataFrame:
    """Per archive: file counts by outcome, rows of new files, parent totals (duplicates included)."""
    st = F.col("status")
    agg = results.groupBy("parent_batch_id").agg(
        F.count("*").alias("total_files"),
        F.count_if(st == "SUCCESS").alias("successful_files"),
        F.count_if(st == "FAILED").alias("failed_files"),
        F.count_if(st == "DUPLICATE").alias("duplicate_files"),
        F.coalesce(F.sum(F.when(st == "SUCCESS", F.col("rows_loaded"))), F.lit(0)).cast("long")
        .alias("total_rows_loaded"),
        F.coalesce(F.sum("rows_loaded"), F.lit(0)).cast("long").alias("parent_total_records"),
    )
    return agg.withColumn("processing_status",
                          batch_status("successful_files", "failed_files", "duplicate_files"))


def _summary_text() -> Column:
    st, rows = F.col("status"), F.col("rows_loaded")
    return F.when((st == "SUCCESS") & (rows <= 0), F.format_string("File %s contains no data rows", F.col("filename"))) \
        .when(st == "FAILED", F.format_string("Failed to process: %s - %s", F.col("filename"),
                                              F.coalesce(F.col("error_message"), F.lit("null"))))


def validation_summary(results: DataFrame) -> DataFrame:
    """Per archive: files ready for production, files needing review, issue count.

    The issue texts themselves come from :func:`validation_summary_issues` as
    rows -- an archive's list is never gathered into one value.
    """
    st, rows = F.col("status"), F.col("rows_loaded")
    return results.groupBy("parent_batch_id").agg(
        F.count_if((st == "SUCCESS") & (rows > 0)).alias("tables_ready_for_production"),
        F.count_if(((st == "SUCCESS") & (rows <= 0)) | ((st != "SUCCESS") & (st != "DUPLICATE")))
        .alias("tables_requiring_review"),
        F.count_if(_summary_text().isNotNull()).alias("data_quality_issue_count"),
    )


def validation_summary_issues(results: DataFrame) -> DataFrame:
    """One row per data-quality issue text (empty new files, failed files)."""
    return results.select("parent_batch_id", "filename", _summary_text().alias("issue")) \
        .where(F.col("issue").isNotNull())


def entry_presence(analysed: DataFrame, extracted: DataFrame, key: str = "relative_path") -> DataFrame:
    """Analysed entries without an extracted file become FAILED results."""
    x = extracted.select(key).distinct().withColumn("_found", F.lit(True))
    j = analysed.join(x, key, "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return j.select(key, found.alias("found"),
                    F.when(found, F.col("status")).otherwise(F.lit(FAILED)).alias("status"),
                    F.when(~found, F.lit("File not found in extracted directory")).alias("error_message"))


def duplicate_result(incoming: DataFrame, m: DataFrame) -> DataFrame:
    """ALREADY_PROCESSED results and DUPLICATE manifest rows for incoming archives
    whose checksum has a COMPLETED manifest."""
    orig = completed_by_checksum(m)
    d = incoming.join(orig, "file_checksum", "left_semi").join(orig, "file_checksum")
    return d.select(
        "batch_id", "file_name", "file_checksum", "file_size_bytes",
        F.lit("ALREADY_PROCESSED").alias("processing_status"),
        F.lit(DUPLICATE).alias("manifest_status"),
        F.col("original_batch_id"),
        F.col("original_total_records").alias("total_records"),
        F.col("original_table_name").alias("table_name"),
        F.format_string("Duplicate of batch %s (processed on %s)", F.col("original_batch_id"),
                        F.date_format("original_completed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("error_message"),
    )


# ---------------------------------------------------------------- folder lifecycle

def lifecycle_state(m: DataFrame) -> DataFrame:
    """Where a watched delivery ends up: extension dispatch, then status -> folder.

    No extension -> single-file load; ``.zip`` -> archive load; anything else
    fails as unsupported.  COMPLETED -> archive, in flight -> wip, waiting ->
    upload, everything else -> error.
    """
    ext = N.file_extension("file_name")
    unsupported = (ext != "") & (F.lower(ext) != ".zip")
    st = F.col("status")
    state = F.when(unsupported, F.lit("error")) \
        .when(st.isin(COMPLETED, DUPLICATE), F.lit("archive")) \
        .when(st == PROCESSING, F.lit("wip")).when(st == PENDING, F.lit("upload")).otherwise(F.lit("error"))
    msg = F.when(unsupported, F.concat(F.lit("Unsupported file type: "), ext)) \
        .when(state == "error", F.coalesce(F.col("error_message"), F.lit("Unknown error")))
    return m.select("batch_id", "file_name",
                    F.when(ext == "", F.lit("delimited")).when(F.lower(ext) == ".zip", F.lit("archive"))
                    .otherwise(F.lit("unsupported")).alias("dispatch"),
                    state.alias("state"), msg.alias("error_message"), "created_at")


def folder_counts(lifecycle: DataFrame) -> DataFrame:
    """Deliveries per state (upload / wip / error / archive)."""
    return lifecycle.groupBy("state").agg(F.count("*").alias("file_count"))


def folder_files(lifecycle: DataFrame, state: str) -> DataFrame:
    """Files of one state, sorted by name (a distributed sort, not a collected list)."""
    return lifecycle.where(F.col("state") == state).select("file_name", "batch_id").orderBy("file_name", "batch_id")


def retry_failed(lifecycle: DataFrame, retry: DataFrame, key: str = "batch_id") -> DataFrame:
    """Move the chosen errored deliveries back to upload and drop their error reports."""
    r = retry.select(key).distinct().withColumn("_retry", F.lit(True))
    j = lifecycle.join(r, key, "left")
    retried = F.coalesce(F.col("_retry"), F.lit(False)) & (F.col("state") == "error")
    return j.select(key, "file_name",
                    F.when(retried, F.lit("upload")).otherwise(F.col("state")).alias("state"),
                    retried.alias("retried"),
                    ((F.col("state") == "error") & ~retried).alias("has_error_report"))


def error_reports(m: DataFrame) -> DataFrame:
    """One report record per failed delivery (JSON text plus its fields)."""
    failed = m.where(F.col("status") == FAILED)
    rec = F.struct(
        F.col("file_name").alias("file"), F.col("file_name").alias("original_filename"),
        F.lit("PROCESSING_ERROR").alias("error_type"), F.col("error_message").alias("error_message"),
        F.col("error_details").alias("error_details"), F.col("file_size_bytes").alias("file_size_bytes"),
        F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("failed_at"), F.lit(True).alias("retry_recommended"),
        F.lit("Fix the issue and re-upload with .done marker").alias("retry_instructions"))
    return failed.select("batch_id", F.concat(F.col("file_name"), F.lit(".error.json")).alias("report_name"),
                         rec.alias("report"))


def error_report_list(m: DataFrame) -> DataFrame:
    """Listing of error reports (name, size, time); its row count is the report count."""
    return m.where(F.col("status") == FAILED).select(
        F.concat(F.col("file_name"), F.lit(".error.json")).alias("report_name"), "file_size_bytes",
        F.col("completed_at").alias("created"))


def write_error_reports(m: DataFrame, path: str) -> None:
    """Add error reports as JSON lines (one object per failed delivery, with its batch and report name)."""
    error_reports(m).select("batch_id", "report_name", "report.*").write.mode("append").json(path)


def write_done_summaries(m: DataFrame, path: str) -> None:
    """Add the summary texts of finished deliveries."""
    done_summaries(m).write.mode("append").parquet(path)


# Layout of the per-delivery summary text.
RULE = "=" * 48
THIN = "-" * 48


def done_summaries(m: DataFrame) -> DataFrame:
    """Per-delivery processing summary text (the ``.done`` file body, minus the generation time)."""
    ok = F.col("status") == COMPLETED
    dur = F.col("processing_duration_ms")
    opt = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(label), c.cast("string"), F.lit("\n"))) \
        .otherwise(F.lit(""))
    err = F.when(~ok, F.concat(
        F.lit("ERROR INFORMATION:\n" + THIN + "\n"),
        opt("Error Message: ", F.col("error_message")),
        F.when(F.col("error_details").isNotNull() & (F.col("error_details") != ""),
               F.concat(F.lit("Error Details: "), F.col("error_details"), F.lit("\n"))).otherwise(F.lit("")),
        F.lit("\n" + THIN + "\n"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit(RULE + "\nFILE PROCESING SUMMARY\n" + RULE + "\n"),
        F.lit("File Name: "), F.col("file_name"), F.lit("\n"),
        F.lit("Batch ID: "), F.col("batch_id"), F.lit("\n"),
        F.lit("Status: "), F.col("status"), F.lit("\n"),
        F.lit("Processing Time (ms): "), F.coalesce(dur, F.lit(0)).cast("string"), F.lit("\n"),
        F.lit("Success: "), F.when(ok, F.lit("Success")).otherwise(F.lit("Failure")), F.lit("\n"),
        F.lit(THIN + "\nProcessing Details:\n" + THIN + "\n"),
        F.lit("Total Records: "), F.coalesce(F.col("total_records"), F.lit(0)).cast("string"), F.lit("\n"),
        F.lit("File Size (bytes): "), F.col("file_size_bytes").cast("string"), F.lit("\n"),
        F.lit(THIN + "\n"),
        opt("Started At: ", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        opt("Completed At: ", F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        F.when(dur.isNotNull(), F.concat(F.lit("Processing Processing Duration (ms): "), dur.cast("string"),
                                         F.lit(" ms ("), F.format_string("%.2f", dur / 1000.0),
                                         F.lit(" seconds)\n"))).otherwise(F.lit("")),
        opt("Staging Table: ", F.col("table_name")),
        F.lit("\n" + THIN + "\n"), err, F.lit(RULE + "\n"))
    return m.select("batch_id", F.concat(F.col("file_name"), F.lit(".done")).alias("summary_name"),
                    text.alias("summary"))
