"""The whole delivery load as one Spark plan per run.

    files ──admit──route──dedupe(manifest)──┐
    lines ──rule join──clean──tab check──transform──bind/typed cast──┤
                                   issues ─┘        gates (per batch) ┘
                                                     └─ within-run dedupe ─ load ─ manifest

All files of a run are one DataFrame keyed by ``batch_id``; every per-file
step is a projection, a partial aggregation per batch, or a join against a
per-batch table (one row per file).  The typed line frame is persisted once
because the gates, the load and the issue table all read it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import names as N
from ..functions import text as tx
from ..operators import load as L
from ..operators import manifest as M
from ..operators import store
from ..operators import transform as TR
from ..operators import validate as V
from ..operators.admission import admit
from ..operators.common import bounded_broadcast, cut_lineage, spread
from ..session import scratch_path


@dataclass
class IngestResult:
    manifest: DataFrame      # one row per file that reached manifest creation
    results: DataFrame       # one row per input file: outcome and message
    issues: DataFrame        # validation + transformation issues
    loaded_path: str | None  # where accepted rows were appended (per table folder)
    cached: tuple = ()       # frames persisted for the run; see release()

    def release(self) -> None:
        """Drop the persisted line frame once the outputs have been written."""
        for df in self.cached:
            df.unpersist()


def _first_violation_agg():
    return F.min(F.struct("line_number", F.array_join("violations", ", ").alias("v"))).alias("_first")


def _quality_aggs() -> list:
    """Per batch: corrected, warning, error and issue counts, and whether a critical issue rejects it."""
    ci = lambda c: (F.col(c) > 0).cast("int")
    n_clean = ci("n_control") + ci("n_non_latin") + ci("n_collapsed")
    return [
        F.sum(n_clean + F.col("tab_fixed").cast("int")).cast("long").alias("corrected_records"),
        F.sum(n_clean + F.col("tab_fixed").cast("int")).cast("int").alias("warning_count"),
        F.sum((F.col("tab_issue").isNotNull() & ~F.col("tab_fixed")).cast("int")).cast("int").alias("error_count"),
        F.sum(n_clean + F.col("tab_issue").isNotNull().cast("int")).cast("long").alias("issue_count"),
        F.max(F.coalesce(F.col("tab_severity") == "CRITICAL", F.lit(False))).alias("rejected"),
    ]


def _typed_by_table(t: DataFrame, tables) -> dict[str, DataFrame]:
    """Typed rows per target table (each batch targets exactly one table)."""
    out = {}
    for name in tables:
        part = t.where(F.col("table_name") == name)
        s = L.tsv_scan(part, name, line_col="out_line", keep=("batch_id", "line_number", "row_fields", "bound"))
        out[name] = L.typed_cast(s, name, bound=F.col("bound"), keep=("batch_id", "line_number"))
    return out


def ingest_files(files: DataFrame, lines: DataFrame, rules: DataFrame,
                 manifest: DataFrame | None = None, tables_path: str | None = None,
                 write: bool = True, allowed=("tsv", ""), run_id: str | None = None,
                 keep: Callable[[DataFrame, str], DataFrame] | None = None) -> IngestResult:
    """Run the single-file flow over every file of a run.

    ``files``: batch_id, file_name, file_size_bytes, file_checksum, arrival
    (and optionally parent_batch_id).  ``lines``: batch_id, line_number, line
    (raw text, header-less tab lines).  ``manifest``: earlier manifests for
    the duplicate check.  When ``write`` is set the accepted rows of all
    tables become visible under ``tables_path`` by one commit record
    (``operators.store.read_table`` reads them).  ``keep`` says how typed
    lines and rows per file are kept for the later steps: by default lines are
    persisted and rows checkpointed, as is best for few files.
    """
    spark = files.sparkSession
    run_id = run_id or uuid.uuid4().hex
    cut = keep or cut_lineage
    if "parent_batch_id" not in files.columns:
        files = files.withColumn("parent_batch_id", F.lit(None).cast("string"))

    # ---- per-file checks before any manifest row exists
    f = admit(files, name="file_name", size="file_size_bytes", allowed=allowed)
    f = f.withColumn("table_name", N.route_table("file_name")) \
        .withColumn("file_pattern", N.file_pattern("file_name"))
    f = f.withColumn("reason", F.coalesce(F.col("reason"), N.routing_error("file_name")))
    first = L.first_line_fields(lines)
    bound = L.bind_columns(first.join(f.select("batch_id", "table_name"), "batch_id"))
    f = f.join(bound.select("batch_id", "field_count", "bind_error"), "batch_id", "left") \
        .withColumn("reason", F.coalesce(F.col("reason"), F.col("bind_error")))
    if manifest is not None:
        f = M.dedupe_against_manifest(f, manifest)
    else:
        f = f.withColumn("already_processed", F.lit(False)).withColumn("original_batch_id", F.lit(None).cast("string"))
    # one row per file: materialise it so later plans start from a short lineage
    f = cut(f, "ingest_files")
    active = f.where(F.col("reason").isNull() & ~F.col("already_processed")) \
        .select("batch_id", "file_name", "file_pattern", "table_name", F.col("field_count").alias("bound"))

    # ---- line pipeline: validate -> transform -> typed
    # one row per file: broadcast (size-checked) so the lines are not shuffled;
    # a shuffle would let AQE pack a small run's lines into a single task
    ln = spread(lines.drop("file_name", "file_pattern")).join(bounded_broadcast(active), "batch_id")
    v = V.validate_lines(V.rule_join(ln, rules))
    t = TR.apply_transform(v).withColumn("row_fields", tx.count_fields("out_line"))
    # keep only what the issue table, the metrics and the typed load read
    t = t.select("batch_id", "file_name", "file_pattern", "table_name", "bound", "line_number", "line", "cleaned",
                 "n_control", "n_non_latin", "n_collapsed", "expected_tab_count", "tab_count", "tab_issue",
                 "tab_severity", "tab_fixed", "fixed_line", "out_line", "row_fields")
    t = keep(t, "ingest_lines") if keep else t.persist(StorageLevel.MEMORY_AND_DISK)

    vissues = V.validation_issues(t)
    issues = vissues.unionByName(TR.transform_audit(t))
    quality = t.groupBy("batch_id").agg(F.count("*").alias("_lines"), *_quality_aggs())

    # the routed tables of this run: at most the registered ten names
    tables = [r[0] for r in active.select("table_name").distinct().collect() if r[0] in schemas.TABLES]
    typed = _typed_by_table(t, tables)
    viol = L.line_violations(t, tables)
    # one row per batch: the pass over all lines ends here, and a bad batch's first bad line alone is looked at again
    checked = cut(quality.join(L.load_gate(viol, line="line_number"), "batch_id", "left"), "ingest_checked")
    outcome = checked.join(L.first_violations(t, tables, checked), "batch_id", "left")
    load_failed = F.coalesce(F.col("failed"), F.lit(False)) & ~F.col("rejected")
    outcome = outcome.select(
        "batch_id", "corrected_records", "warning_count", "error_count", "issue_count", "rejected",
        load_failed.alias("load_failed"),
        F.coalesce("row_count", F.col("_lines")).cast("long").alias("loaded_rows"),
        F.when(load_failed, F.format_string("Load failed: %d of %d rows violate the table schema",
                                            F.col("bad_rows"), F.col("row_count"))).alias("error_message"),
        F.when(load_failed, F.format_string("first violation at line %d: %s", F.col("_first.line_number"),
                                            F.col("_first.v"))).alias("load_details"),
    )

    outcome = cut(outcome, "ingest_outcome")  # one row per batch

    def rows(accepted: DataFrame) -> dict[str, DataFrame]:
        return {name: df.join(accepted, "batch_id", "left_semi").drop("violations", "line_number") for name, df in typed.items()}

    return _finish(f, outcome, rows, issues, tables_path if write else None, write, run_id, () if keep else (t,), cut)


def _finish(f: DataFrame, outcome: DataFrame, rows: Callable[[DataFrame], dict[str, DataFrame]], issues: DataFrame,
            tables_path: str | None, write: bool, run_id: str, cached: tuple,
            cut: Callable[[DataFrame, str], DataFrame] = cut_lineage) -> IngestResult:
    """The end of every run: duplicates within it, the load as one commit, manifest rows and results per file.

    ``f``: one row per file with ``reason`` and ``already_processed``;
    ``outcome``: one row per batch; ``rows(accepted)``: each table's rows of
    the accepted batches.
    """
    spark = f.sparkSession
    # ---- within-run duplicates: the first passing copy per checksum wins
    cand = f.join(outcome.select("batch_id", "rejected", "load_failed"), "batch_id", "left")
    passed = F.col("reason").isNull() & ~F.col("already_processed") & \
        ~F.coalesce(F.col("rejected"), F.lit(True)) & ~F.coalesce(F.col("load_failed"), F.lit(True))
    cand = M.dedupe_within_run(cand.withColumn("_passed", passed), order=("arrival", "batch_id"),
                               eligible=F.col("_passed"))
    fate = cut(cand.select("batch_id", "_passed", "is_duplicate"), "ingest_dupes")

    # ---- load accepted batches: staged per table, visible by one commit record
    accepted = fate.where(F.col("_passed") & ~F.col("is_duplicate")).select("batch_id")
    loaded_path = None
    if write:
        loaded_path = tables_path or scratch_path(spark, f"tables/{run_id}")
        seen = store.last_record(spark, loaded_path)
        done = store.committed_batches(spark, loaded_path)
        if done is not None:  # a run that was repeated after its commit loads nothing twice
            accepted = accepted.join(done, "batch_id", "left_anti")
        routed = F.col("routed") if "routed" in f.columns else F.lit(True)
        target = F.when(routed, F.col("table_name")).otherwise(F.lit(LOOSE)).alias("target")
        accepted = cut(f.select("batch_id", target).join(accepted, "batch_id", "left_semi"), "ingest_accepted")
        found = {r[0] for r in accepted.select("target").distinct().collect()}  # the registered names and one more
        staged = rows(bounded_broadcast(accepted.select("batch_id")))
        store.load_tables({name: L.with_load_time(df) for name, df in staged.items() if name in found}, loaded_path, run_id, seen, known=True)

    # ---- manifest rows for files that reached manifest creation (not duplicates)
    opened = M.open_manifest(f.where(F.col("reason").isNull() & ~F.col("already_processed"))
                             .join(fate.where(~F.col("is_duplicate")), "batch_id", "left_semi"))
    closed = M.close_manifest(opened, outcome.drop("load_details")).join(
        outcome.select("batch_id", "load_details"), "batch_id", "left")
    closed = closed.withColumn("error_details", F.coalesce("error_details", "load_details")).drop("load_details")

    # ---- per-file results
    res = f.join(fate, "batch_id", "left").join(
        closed.select("batch_id", F.col("status").alias("_mstatus"), F.col("total_records").alias("_rows"),
                      F.col("error_message").alias("_merr")), "batch_id", "left")
    status = F.when(F.col("reason").isNotNull(), F.lit("FAILED")) \
        .when(F.col("already_processed") | F.coalesce(F.col("is_duplicate"), F.lit(False)), F.lit("DUPLICATE")) \
        .when(F.col("_mstatus") == "COMPLETED", F.lit("SUCCESS")).otherwise(F.lit("FAILED"))
    results = res.select(
        "batch_id", "parent_batch_id", F.col("file_name").alias("filename"), "table_name", status.alias("status"),
        F.when(status == "SUCCESS", F.col("_rows")).otherwise(F.lit(0)).cast("long").alias("rows_loaded"),
        F.coalesce(F.col("reason"), F.col("_merr")).alias("error_message"),
        F.col("original_batch_id"),
    )
    return IngestResult(manifest=closed, results=results, issues=issues, loaded_path=loaded_path, cached=cached)


#: The table of header CSV rows whose file routes to no registered table.
LOOSE = "_csv"
# Wording of header failures.
NO_HEADER = "File is empty or has no header"
REPEATED = "Repeated column in header: "
UNKNOWN = "Columns not in table "


def _header_fault() -> F.Column:
    """Why a file's header cannot be loaded, or NULL: routed files need columns of their table, each once."""
    known = F.create_map(*[x for t in schemas.TABLES for x in (F.lit(t), F.array(*[F.lit(c.name) for c in schemas.table_columns(t)]))])
    cols = F.col("columns")
    extra = F.array_except(cols, F.element_at(known, F.col("table_name")))
    twice = F.filter(F.array_distinct(cols), lambda c: F.size(F.filter(cols, lambda x: x == c)) > 1)
    return (F.when(cols.isNull() | (F.size(cols) == 0), F.lit(NO_HEADER))
            .when(F.size(twice) > 0, F.concat(F.lit(REPEATED), F.array_join(twice, ", ")))
            .when(F.col("routed") & (F.size(extra) > 0), F.concat(F.lit(UNKNOWN), F.col("table_name"), F.lit(": "), F.array_join(extra, ", "))))


def ingest_csv(files: DataFrame, lines: DataFrame, rules: DataFrame, manifest: DataFrame | None = None,
               tables_path: str | None = None, write: bool = True, route: bool = True) -> IngestResult:
    """Header-CSV flow: columns from the header line, table routed by name or named from the file.

    A file whose name routes (``PM162.csv`` to pm1; off with ``route=False``)
    loads its header's columns into that table, typed, all rows or none.  Any
    other file's table is named from the file, and each row is stored as a
    ``map<column, value>`` (empty -> NULL), so files with different headers
    share one layout.  Column names are the header's pieces (split on commas,
    trimmed, lower-cased); data lines are parsed quote-aware.  Lines are
    validated and transformed by the rule of their file pattern exactly as
    TSV files are, and copies of a file load once.  A repeated or unknown
    column, or a value of the wrong type, fails its own file only.
    """
    from ..functions import csvtext as CV

    spark = files.sparkSession
    run_id = uuid.uuid4().hex
    if "parent_batch_id" not in files.columns:
        files = files.withColumn("parent_batch_id", F.lit(None).cast("string"))
    f = admit(files, name="file_name", size="file_size_bytes", allowed=("csv", ""))
    target = N.route_table("file_name") if route else F.lit(None).cast("string")
    f = f.withColumn("routed", target.isNotNull() & target.isin(*schemas.TABLES)) \
        .withColumn("table_name", F.when(F.col("routed"), target).otherwise(N.table_name_from_file("file_name"))) \
        .withColumn("file_pattern", N.file_pattern("file_name"))
    header = lines.groupBy("batch_id").agg(F.min_by("line", "line_number").alias("_header"),
                                           F.min("line_number").alias("_first"))
    header = header.withColumn("columns", CV.header_columns("_header", "naive"))
    f = f.join(header.select("batch_id", "columns", "_first"), "batch_id", "left") \
        .withColumn("reason", F.coalesce(F.col("reason"), _header_fault()))
    if manifest is not None:
        f = M.dedupe_against_manifest(f, manifest)
    else:
        f = f.withColumn("already_processed", F.lit(False)).withColumn("original_batch_id", F.lit(None).cast("string"))
    f = cut_lineage(f, "ingest_csv_files")
    active = f.where(F.col("reason").isNull() & ~F.col("already_processed")) \
        .select("batch_id", "file_name", "file_pattern", "table_name", "columns", "_first", "routed")
    ln = spread(lines.drop("file_name", "file_pattern")).join(bounded_broadcast(active), "batch_id")
    v = TR.apply_transform(V.validate_lines(V.rule_join(ln, rules)))
    issues = V.validation_issues(v).unionByName(TR.transform_audit(v))
    values = F.transform(F.split(CV.csv_to_tsv("out_line", F.size("columns")), "\t", -1), lambda x: F.nullif(x, F.lit("")))
    v = v.withColumn("values", values).persist(StorageLevel.MEMORY_AND_DISK)
    data = v.where(F.col("line_number") > F.col("_first"))

    # typed rows of routed files: at most the registered ten tables
    tables = sorted(r[0] for r in active.where("routed").select("table_name").distinct().collect())
    typed = {t: L.typed_by_name(data.where(F.col("routed") & (F.col("table_name") == t)), t) for t in tables}
    outcome = v.groupBy("batch_id").agg(
        F.count_if(F.col("line_number") > F.col("_first")).cast("long").alias("_lines"), *_quality_aggs())
    faults = [t.where(F.size("violations") > 0).select("batch_id", "line_number", "violations") for t in typed.values()]
    bad = reduce(DataFrame.unionByName, faults) if faults else \
        spark.createDataFrame([], "batch_id string, line_number bigint, violations array<string>")
    outcome = outcome.join(bad.groupBy("batch_id").agg(F.count("*").alias("bad_rows"), _first_violation_agg()), "batch_id", "left")
    failed = F.col("bad_rows").isNotNull() & ~F.col("rejected")
    outcome = outcome.select(
        "batch_id", "corrected_records", "warning_count", "error_count", "issue_count", "rejected", failed.alias("load_failed"),
        F.col("_lines").alias("loaded_rows"),
        F.when(failed, F.format_string("Load failed: %d of %d rows violate the table schema", F.col("bad_rows"), F.col("_lines")))
        .alias("error_message"),
        F.when(failed, F.format_string("first violation at line %d: %s", F.col("_first.line_number"), F.col("_first.v"))).alias("load_details"))
    outcome = cut_lineage(outcome, "ingest_csv_outcome")

    def rows(accepted: DataFrame) -> dict[str, DataFrame]:
        out = {name: df.join(accepted, "batch_id", "left_semi").drop("violations", "line_number") for name, df in typed.items()}
        loose = data.where(~F.col("routed")).join(accepted, "batch_id", "left_semi").select(
            "batch_id", "table_name", "line_number", F.map_from_arrays("columns", "values").alias("row"))
        return out | {LOOSE: loose}

    return _finish(f, outcome, rows, issues, tables_path if write else None, write, run_id, (v,))
