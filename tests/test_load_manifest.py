"""Binding, typed cast, gates, batch load; manifest statistics and roll-ups."""

import datetime as dt

from pyspark.sql import functions as F

from lineforge.functions import text as tx
from lineforge.operators import load as L
from lineforge.operators import manifest as M


def _lines(spark, rows):
    return spark.createDataFrame(rows, "batch_id string, line_number long, line string")


def test_first_n_binding(spark):
    lines = _lines(spark, [("b1", 1, "62\t0000123456\t2020/01/15\tTR\tQ"), ("b1", 2, "62\t7\t\t\t"),
                           ("b2", 1, "a\tb\tc\td"), ("b2", 2, "x")])
    first = L.first_line_fields(lines).withColumn("table_name", F.when(F.col("batch_id") == "b1", "im1")
                                                  .otherwise("im3"))
    b = {r.batch_id: r for r in L.bind_columns(first).collect()}
    assert b["b1"].bound_columns == ["lro_num", "instrument_num", "registration_date", "interest_code",
                                     "qualifier_code"] and b["b1"].bind_error is None
    assert b["b2"].bind_error == "File has 4 fields but table im3 only has 3 data columns"


def test_typed_cast_and_gate(spark):
    lines = _lines(spark, [
        ("ok", 1, "62\t0000123456\t2020/01/15\tTR\tQ"),
        ("ok", 2, "62\t0000123457\t2020-01-15 10:11:12\tTR  \tQ"),   # trailing spaces beyond width are dropped
        ("bad", 1, "62\t\t2020/01/15\tTR\tQ"),                        # NOT NULL
        ("bad", 2, "62\t1\t2020/02/30\tTOOLONGCODE\tQ"),              # bad date, over-long code
        ("bad", 3, "62\t1\t2020/01/01\tTR"),                          # field count
    ])
    s = L.tsv_scan(lines.withColumn("row_fields", tx.count_fields("line")), "im1",
                   keep=("batch_id", "line_number", "row_fields"))
    typed = L.typed_cast(s, "im1", bound=5)
    rows = {(r.batch_id, r.line_number): r for r in typed.collect()}
    assert rows[("ok", 1)].registration_date == dt.datetime(2020, 1, 15)
    assert rows[("ok", 2)].registration_date == dt.datetime(2020, 1, 15, 10, 11, 12)
    assert rows[("ok", 2)].interest_code == "TR  "
    assert rows[("ok", 1)].violations == []
    assert rows[("bad", 1)].violations == ["instrument_num:EMPTY_REQUIRED_FIELD"]
    assert rows[("bad", 2)].violations == ["registration_date:DATA_TYPE_MISMATCH", "interest_code:LENGTH_VIOLATION"]
    assert rows[("bad", 3)].violations == ["row:FIELD_COUNT"]
    gate = {r.batch_id: r for r in L.load_gate(typed).collect()}
    assert not gate["ok"].failed and gate["bad"].failed and gate["bad"].bad_rows == 3


def test_first_violation_is_found_without_a_sort_of_the_lines(spark):
    """F8: all lines are checked once, by a hash aggregate; only the first bad lines are checked again for their text."""
    rows = [("ok", 1, "62\t0000123456\t2020/01/15", "im1"), ("ok", 2, "62\t1\t2020/01/16", "im1"),
            ("bad", 5, "62\t\t2020/01/15", "im1"), ("bad", 3, "62\t1\t2020/02/30", "im1"), ("bad", 3, "\t1\t2020/02/30", "im1"),
            ("bad", 2, "62\t1\t2020/01/01", "im1"), ("other", 7, "62\t1\tx\ty", "im3"), ("other", 9, "62\t\tx", "im3"),
            ("unnumbered", 1, "62\t1", "im1"), ("unnumbered", None, "622\t1\t2020/01/01", "im1"),
            ("unnumbered", None, "62\t1\t2020/01/01", "im1")]
    lines = spark.createDataFrame(rows, "batch_id string, line_number bigint, out_line string, table_name string").withColumn("bound", F.lit(3))
    viol = L.line_violations(lines, ["im1", "im3"])
    gate = L.load_gate(viol, line="line_number")
    found = {r.batch_id: (r.row_count, r.bad_rows, r.failed, r.first_bad) for r in gate.collect()}
    assert found == {"ok": (2, 0, False, None), "bad": (4, 3, True, 3), "other": (2, 2, True, 7), "unnumbered": (3, 2, True, None)}
    first = L.first_violations(lines, ["im1", "im3"], spark.createDataFrame(gate.collect(), gate.schema))
    got = {r.batch_id: r._first for r in first.collect()}
    whole = viol.where(F.size("violations") > 0).groupBy("batch_id").agg(
        F.min(F.struct("line_number", F.array_join("violations", ", ").alias("v"))).alias("_first"))
    assert got == {r.batch_id: r._first for r in whole.collect()}
    assert got["bad"].v == "lro_num:EMPTY_REQUIRED_FIELD, registration_date:DATA_TYPE_MISMATCH"
    assert "SortAggregate" not in gate._jdf.queryExecution().toString()
    # the checks stay above the join with the first bad lines
    optimized = first._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.index("EMPTY_REQUIRED_FIELD") < optimized.index("Join Inner") and "EMPTY_REQUIRED_FIELD" not in optimized[optimized.index("Join Inner"):]


def test_batch_load_all_or_nothing(spark, tmpdir_path):
    lines = _lines(spark, [("ok", 1, "62\t1\tc"), ("ok", 2, "62\t2\td"), ("bad", 1, "62\t\tc"), ("bad", 2, "62\t3\te")])
    s = L.tsv_scan(lines.withColumn("row_fields", tx.count_fields("line")), "im3",
                   keep=("batch_id", "line_number", "row_fields"))
    loaded = L.batch_load(L.typed_cast(s, "im3"), "im3", path=tmpdir_path + "/im3")
    got = loaded.select("batch_id", "instrument_num", "row_number", "loaded_at").collect()
    assert sorted(r.instrument_num for r in got) == ["1", "2"]
    assert {r.batch_id for r in got} == {"ok"}
    assert len({r.row_number for r in got}) == 2 and all(r.loaded_at is not None for r in got)


def test_tracking_columns(spark):
    df = spark.createDataFrame([("x",)], "a string")
    e = L.ensure_tracking_columns(df)
    assert e.columns == ["a", "batch_id", "row_number", "loaded_at"]
    assert L.drop_tracking_columns(e).columns == ["a"]
    t = L.tag_untagged_rows(e, "new")
    assert t.collect()[0].batch_id == "new"


def _manifest(spark, statuses_totals):
    rows = [(str(i), None, "f", 10, "c%d" % (i % 3), s, t, t if s == "COMPLETED" else 0, 0,
             dt.datetime(2024, 1, 1, 0, 0, i), dt.datetime(2024, 1, 1, 0, 1, i), "pm1")
            for i, (s, t) in enumerate(statuses_totals)]
    return spark.createDataFrame(rows, "batch_id string, parent_batch_id string, file_name string, "
                                       "file_size_bytes long, file_checksum string, status string, total_records long, "
                                       "processed_records long, failed_records long, created_at timestamp_ntz, "
                                       "completed_at timestamp_ntz, table_name string")


def test_processing_stats(spark):
    m = _manifest(spark, [("COMPLETED", 100)] * 7 + [("FAILED", 100)] * 2 + [("PROCESSING", 300), ("PENDING", 5)])
    r = M.processing_stats(m).collect()[0]
    assert (r.total_batches, r.completed_batches, r.failed_batches, r.processing_batches) == (10, 7, 2, 1)
    assert r.total_records_processed == 7 * 100 + 200 + 300


def test_completion_pct(spark):
    df = spark.createDataFrame([(50, 200), (0, 0), (1, None)], "p long, t long")
    assert [r.c for r in df.select(M.completion_pct("p", "t").alias("c")).collect()] == [25.0, 0.0, 0.0]


def test_dedupe_semantics(spark):
    m = _manifest(spark, [("COMPLETED", 1), ("FAILED", 1), ("COMPLETED", 2), ("FAILED", 1)])
    incoming = spark.createDataFrame([("n1", "c0"), ("n2", "c1"), ("n3", "zz")], "batch_id string, file_checksum string")
    got = {r.batch_id: r for r in M.dedupe_against_manifest(incoming, m).collect()}
    assert got["n1"].already_processed and got["n1"].original_batch_id == "0"
    assert not got["n2"].already_processed           # only a FAILED attempt had c1
    assert not got["n3"].already_processed
    run = spark.createDataFrame([("a", "k", 2, "p2"), ("b", "k", 1, "p1"), ("c", "k", 1, "p0"), ("d", "u", 5, "p")],
                                "batch_id string, file_checksum string, arrival int, path string")
    d = {r.batch_id: r.is_duplicate for r in M.dedupe_within_run(run).collect()}
    assert d == {"a": True, "b": True, "c": False, "d": False}


def test_latest_per_checksum(spark):
    m = _manifest(spark, [("COMPLETED", 1), ("FAILED", 1), ("PENDING", 1), ("FAILED", 1)])
    got = {r.file_checksum: r for r in M.latest_per_checksum(m).collect()}
    assert got["c0"].latest_batch_id == "3" and got["c0"].latest_completed_batch_id == "0"
    assert got["c1"].latest_completed_batch_id is None


def test_archive_rollup_goldens(spark):
    res = spark.createDataFrame([
        ("p1", "a", "SUCCESS", 10, None), ("p1", "b", "SUCCESS", 20, None),
        ("p2", "a", "SUCCESS", 5, None), ("p2", "b", "FAILED", 0, "boom"),
        ("p3", "a", "SUCCESS", 0, None),
        ("p4", "a", "DUPLICATE", 7, None), ("p5", "a", "DUPLICATE", 7, None), ("p5", "b", "SUCCESS", 1, None),
        ("p6", "a", "FAILED", 0, "x")],
        "parent_batch_id string, filename string, status string, rows_loaded long, error_message string")
    r = {x.parent_batch_id: x for x in M.batch_rollup(res).collect()}
    assert (r["p1"].processing_status, r["p1"].total_files, r["p1"].total_rows_loaded) == ("SUCCESS", 2, 30)
    assert (r["p2"].processing_status, r["p2"].successful_files, r["p2"].failed_files) == ("PARTIAL_SUCCESS", 1, 1)
    assert r["p4"].processing_status == "ALL_DUPLICATES" and r["p5"].processing_status == "PARTIAL_SUCCESS"
    assert r["p5"].total_rows_loaded == 1 and r["p5"].parent_total_records == 8
    assert r["p6"].processing_status == "FAILED"
    s = {x.parent_batch_id: x for x in M.validation_summary(res).collect()}
    assert s["p3"].tables_ready_for_production == 0 and s["p3"].tables_requiring_review == 1
    texts = {x.issue for x in M.validation_summary_issues(res).collect()}
    assert "File a contains no data rows" in texts and "Failed to process: b - boom" in texts


def test_iso_timestamps_round_half_up(spark):
    from lineforge.operators import load as LD
    cases = {"2024-01-15": "2024-01-15 00:00:00", "2024-01-15 10:00:00.6": "2024-01-15 10:00:01",
             "2024-01-15T10:00:00": "2024-01-15 10:00:00", "2024/01/15": "2024-01-15 00:00:00", "2024": None, "soon": None,
             "2024-13-01": None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.t for r in df.select("v", LD._timestamp0(F.col("v")).cast("string").alias("t")).collect()}
    assert got == cases
