"""The run-level ingest over small delivery files and archives."""

import os
import zipfile

from pyspark.sql import functions as F

from lineforge.operators.validate import rules_df
from lineforge.plans.archives import archive_analysis, ingest_archives
from lineforge.plans.ingest import ingest_files
from lineforge.sources import files as FS

PM4_OK = "16901\t0319\t16901\t0315\n16901\t0320\t16901\t0315\n"
PM4_BAD = "169011\t0319\t16901\t0315\n"          # block_num too long -> load gate fails
IM3_OK = "62\t431984    \tLT403859\n62\t431985\tcomment é\n"


def _files_and_lines(spark, folder):
    files = FS.file_checksums(FS.binary_files(spark, folder)).select(
        F.col("path").alias("batch_id"), "file_name", F.col("length").alias("file_size_bytes"), "file_checksum",
        F.col("modification_time").cast("long").alias("arrival"))
    lines = FS.line_scan(spark, folder).select(F.col("file_path").alias("batch_id"), "line_number", "line")
    return files, lines


def test_ingest_files_end_to_end(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    for name, body in [("PM462", PM4_OK), ("PM463", PM4_BAD), ("IM362", IM3_OK), ("orders.csv", "a,b\n"),
                       ("PM464", PM4_OK)]:  # PM464 is a byte-identical copy of PM462
        with open(os.path.join(src, name), "w") as fh:
            fh.write(body)
    os.utime(os.path.join(src, "PM464"), (2_000_000_000, 2_000_000_000))  # arrives last
    files, lines = _files_and_lines(spark, src)
    out = os.path.join(tmpdir_path, "tables")
    res = ingest_files(files, lines, rules_df(spark), tables_path=out)
    results = {r.filename: r for r in res.results.collect()}
    assert results["PM462"].status == "SUCCESS" and results["PM462"].rows_loaded == 2
    assert results["PM463"].status == "FAILED"
    assert results["IM362"].status == "SUCCESS"
    assert results["orders.csv"].status == "FAILED"      # .csv not admitted for a tsv load
    assert results["PM464"].status == "DUPLICATE"
    man = {r.file_name: r for r in res.manifest.collect()}
    assert set(man) == {"PM462", "PM463", "IM362"}
    assert man["PM462"].status == "COMPLETED" and man["PM462"].data_quality_status == "CLEAN"
    assert man["PM463"].status == "FAILED" and man["PM463"].data_quality_status == "REJECTED"
    assert man["PM463"].error_message == "Load failed: 1 of 1 rows violate the table schema"
    assert man["IM362"].data_quality_status == "CORRECTED"   # the non-latin character was replaced
    loaded = spark.read.parquet(os.path.join(out, "pm4"))
    assert loaded.count() == 2
    im3 = spark.read.parquet(os.path.join(out, "im3")).orderBy("instrument_num").collect()
    assert im3[1].comment_desc == "comment *"
    issues = res.issues.where(F.col("issue_type") == "NON_LATIN_CHARACTERS").collect()
    assert len(issues) == 1 and issues[0].line_number == 2


def test_ingest_dedupes_against_completed_manifest(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "PM462"), "w") as fh:
        fh.write(PM4_OK)
    files, lines = _files_and_lines(spark, src)
    first = ingest_files(files, lines, rules_df(spark), write=False)
    again = ingest_files(files, lines, rules_df(spark), manifest=first.manifest.withColumn(
        "created_at", F.current_timestamp()).withColumn("completed_at", F.current_timestamp()), write=False)
    r = again.results.collect()[0]
    assert r.status == "DUPLICATE" and r.original_batch_id is not None
    assert again.manifest.count() == 0


def test_archives(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "zips")
    os.makedirs(src)
    with zipfile.ZipFile(os.path.join(src, "good.zip"), "w") as z:
        z.writestr("62.2023_05_24/PM462", PM4_OK)
        z.writestr("62.2023_05_24/IM362", IM3_OK)
        z.writestr("PM162.txt", "x")          # analysed (stem routes) but never extracted
        z.writestr("readme.md", "ignored")
    with zipfile.ZipFile(os.path.join(src, "empty.zip"), "w") as z:
        z.writestr("notes.txt", "nothing")
    with open(os.path.join(src, "broken.zip"), "wb") as fh:
        fh.write(b"PK\x03\x04 not an archive")
    archives = FS.binary_files(spark, src, glob="*.zip")
    per_entry, summary = archive_analysis(archives)
    s = {os.path.basename(r.archive): r for r in summary.collect()}
    assert s["good.zip"].extraction_status == "SUCCESS" and s["good.zip"].total_files_extracted == 4
    assert s["empty.zip"].extraction_status == "NO_CSV_FILES_FOUND"
    assert s["broken.zip"].extraction_status == "EXTRACTION_FAILED"
    assert s["empty.zip"].processing_recommendations == [
        "No CSV files found in ZIP. Please ensure ZIP contains CSV files."]
    entries = {r.file_name: r for r in per_entry.collect()}
    assert entries["PM462"].estimated_rows == 1 and entries["PM462"].suggested_table_name == "pm4"
    res = ingest_archives(archives, rules_df(spark), tables_path=os.path.join(tmpdir_path, "t"))
    results = {r.filename: r for r in res.results.collect()}
    assert results["PM462"].status == "SUCCESS" and results["IM362"].status == "SUCCESS"
    assert results["PM162.txt"].status == "FAILED"
    assert results["PM162.txt"].error_message == "File not found in extracted directory"
    roll = sorted(res.rollup.collect(), key=lambda r: -r.total_files)
    assert len(roll) == 3
    assert roll[0].processing_status == "PARTIAL_SUCCESS" and roll[0].total_rows_loaded == 4
    # an archive without a routed entry, or one that cannot be read, is one failed file
    assert all(r.total_files == 0 and r.failed_files == 1 and r.processing_status == "FAILED" for r in roll[1:])
    parents = {r.file_name: r for r in res.parents.collect()}
    assert parents["good.zip"].status == "COMPLETED" and parents["good.zip"].total_records == 4
    assert parents["empty.zip"].status == parents["broken.zip"].status == "FAILED"
    assert "BadZipFile" in parents["broken.zip"].error_message


def test_archive_already_processed(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "zips")
    os.makedirs(src)
    with zipfile.ZipFile(os.path.join(src, "a.zip"), "w") as z:
        z.writestr("PM462", PM4_OK)
    archives = FS.binary_files(spark, src, glob="*.zip")
    first = ingest_archives(archives, rules_df(spark), write=False)
    parents = first.parents.withColumn("created_at", F.current_timestamp()) \
        .withColumn("completed_at", F.current_timestamp()).withColumn("table_name", F.lit(None).cast("string"))
    again = ingest_archives(archives, rules_df(spark), manifest=parents, write=False)
    d = again.duplicates.collect()
    assert len(d) == 1 and d[0].processing_status == "ALREADY_PROCESSED" and d[0].manifest_status == "DUPLICATE"
    assert d[0].total_records == 2
    assert again.results.count() == 0


def test_ingest_csv_with_header(spark, tmpdir_path):
    from lineforge.plans.ingest import ingest_csv
    src = os.path.join(tmpdir_path, "csv")
    os.makedirs(src)
    with open(os.path.join(src, "customer-data@2024.csv"), "w") as fh:
        fh.write('Order ID, Customer Name ,Price\n1001,"Doe, John",1200.00\n1002,Ann\n')
    with open(os.path.join(src, "PM162.csv"), "w") as fh:
        fh.write("block_num,property_id_num,registration_system_code\n12345,6789,A\n54321,9876,B")
    for name, body in [("PM163.csv", "block_num,nothing\n1,2\n"), ("PM164.csv", "block_num,block_num\n1,2\n"),
                       ("PM165.csv", "block_num,property_id_num\n123456,1\n1,2\n"), ("twice.csv", "a,a\n1,2\n"),
                       ("copy.csv", 'Order ID, Customer Name ,Price\n1001,"Doe, John",1200.00\n1002,Ann\n')]:
        with open(os.path.join(src, name), "w") as fh:
            fh.write(body)
    files, lines = _files_and_lines(spark, src)
    out = os.path.join(tmpdir_path, "t")
    res = ingest_csv(files, lines, rules_df(spark), tables_path=out)
    r = {x.filename: x for x in res.results.collect()}
    copies = {"customer-data@2024.csv", "copy.csv"}   # equal bytes: one of them loads
    assert {r[c].status for c in copies} == {"SUCCESS", "DUPLICATE"}
    first = next(c for c in copies if r[c].status == "SUCCESS")
    assert r[first].rows_loaded == 2 and r["customer-data@2024.csv"].table_name == "customer_data_2024"
    # PM162.csv is routed and typed; it is validated by tabs (every line lacks 16 tabs) yet loads
    assert r["PM162.csv"].status == "SUCCESS" and r["PM162.csv"].table_name == "pm1" and r["PM162.csv"].rows_loaded == 2
    man = {m.file_name: m for m in res.manifest.collect()}
    assert man["PM162.csv"].error_count == 3 and man["PM162.csv"].data_quality_status == "CLEAN"
    pm1 = spark.read.parquet(os.path.join(out, "pm1")).orderBy("block_num").collect()
    assert [(x.block_num, x.property_id_num, x.registration_system_code, x.interest_code) for x in pm1] == [
        ("12345", "6789", "A", None), ("54321", "9876", "B", None)]
    # faults stay with their files
    assert r["PM163.csv"].error_message == "Columns not in table pm1: nothing"
    assert r["PM164.csv"].error_message == "Repeated column in header: block_num" and r["twice.csv"].status == "FAILED"
    assert r["PM165.csv"].status == "FAILED" and man["PM165.csv"].error_details == "first violation at line 2: block_num:LENGTH_VIOLATION"
    rows = spark.read.parquet(os.path.join(out, "_csv")).orderBy("line_number").collect()
    assert len(rows) == 2
    assert rows[0].row == {"order id": "1001", "customer name": "Doe, John", "price": "1200.00"}
    assert rows[1].row == {"order id": "1002", "customer name": "Ann", "price": None}


def test_archives_keep_children_and_lines_in_files(spark, tmpdir_path):
    """The children are found once, lines are not held by executors, and the outcome is that of persisted lines."""
    from lineforge.operators.common import kept
    src = os.path.join(tmpdir_path, "zips")
    os.makedirs(src)
    with zipfile.ZipFile(os.path.join(src, "a.zip"), "w") as z:
        for name, body in [("1/PM462", PM4_OK), ("2/PM462", PM4_BAD), ("IM362", IM3_OK), ("3/PM462", PM4_OK), ("PM9.csv", "a,b\n"), ("PM962.x", "x\n")]:
            z.writestr(name, body)
    res = ingest_archives(FS.binary_files(spark, src, glob="*.zip"), rules_df(spark), write=False)
    assert res.children.cached == ()
    assert "archive_children" in str(res.results.inputFiles()) and "archive_entries" not in str(res.results.inputFiles())
    got = sorted((r.filename, r.status, r.rows_loaded) for r in res.results.collect())
    assert got == [("IM362", "SUCCESS", 2), ("PM462", "DUPLICATE", 0), ("PM462", "FAILED", 0), ("PM462", "SUCCESS", 2), ("PM962.x", "FAILED", 0)]
    plain = os.path.join(tmpdir_path, "plain")
    for name, body in [("1/PM462", PM4_OK), ("2/PM462", PM4_BAD), ("IM362", IM3_OK), ("orders.csv", "a,b\n")]:
        os.makedirs(os.path.dirname(os.path.join(plain, name)), exist_ok=True)
        with open(os.path.join(plain, name), "w") as fh:
            fh.write(body)
    files, lines = _files_and_lines(spark, plain)
    runs = [ingest_files(files, lines, rules_df(spark), write=False, keep=keep) for keep in (None, kept)]
    rows = lambda df: sorted(map(str, df.drop("created_at", "updated_at", "started_at", "completed_at", "processing_duration_ms").collect()))
    for of in ("manifest", "results", "issues"):
        assert rows(getattr(runs[0], of)) == rows(getattr(runs[1], of)) != []
