"""Marker gate, stability check, rule maintenance and timestamp typing details."""

import datetime as dt

from pyspark.sql import functions as F

from lineforge.operators import load as L
from lineforge.operators import rules as R
from lineforge.operators.validate import rules_df
from lineforge.streaming.folders import marker_gate, stability_check


def test_marker_gate_actions(spark):
    data = spark.createDataFrame([("PM162",), ("orders.csv",), ("notes.txt",), ("a.zip",)], "name string")
    markers = spark.createDataFrame([("PM162.done",), ("orders.csv.done",), ("notes.txt.done",), ("ghost.done",),
                                     ("PM162",), (".done",), ("a.zip.done",)], "marker string")
    got = {r.marker: r.action for r in marker_gate(data, markers).collect()}
    assert got == {"PM162.done": "process", "orders.csv.done": "process", "notes.txt.done": "unsupported",
                   "ghost.done": "missing_data", "PM162": "invalid_marker", ".done": "invalid_marker",
                   "a.zip.done": "process"}


def test_stability(spark):
    a = spark.createDataFrame([("p1", 10, 1), ("p2", 10, 1), ("p3", 10, 1)], "path string, length long, modification_time long")
    b = spark.createDataFrame([("p1", 10, 1), ("p2", 11, 1), ("p3", 10, 2)], "path string, length long, modification_time long")
    got = {r.path: r.stable for r in stability_check(a, b).collect()}
    assert got == {"p1": True, "p2": False, "p3": False}


def test_rule_upsert_toggle_delete(spark):
    rules = rules_df(spark)
    upd = spark.createDataFrame([("PM1", 3, False), ("XX9", 1, True)],
                                "file_pattern string, expected_tab_count int, auto_fix_enabled boolean")
    out = {r.file_pattern: r for r in R.rule_upsert(rules, upd).collect()}
    assert out["PM1"].expected_tab_count == 3 and out["PM1"].action == "updated"
    assert out["XX9"].action == "inserted" and out["PM2"].action == "unchanged"
    assert out["PM1"].table_name == "pm1"   # fields not given keep their value
    off = R.rule_toggle(rules, spark.createDataFrame([("PM2",)], "file_pattern string"), enabled=False)
    flags = {r.file_pattern: r.validation_enabled for r in off.collect()}
    assert flags["PM2"] is False and flags["PM1"] is True
    left = R.rule_delete(rules, spark.createDataFrame([(1,), (2,)], "id long"))
    assert left.count() == 8


def test_timestamp_rounds_half_up(spark):
    df = spark.createDataFrame([("2020-01-01 10:00:00",), ("2020/02/30",), ("0000/00/00",)], "x string")
    got = [r.t for r in df.select(L._timestamp0(F.col("x")).alias("t")).collect()]
    assert got[0] == dt.datetime(2020, 1, 1, 10, 0, 0)
    assert got[1] is None and got[2] is None


def test_varchar_trailing_space_rule(spark):
    df = spark.createDataFrame([("ab   ",), ("abcd",), ("ab",)], "x string")
    rows = df.select(*[c.alias(n) for c, n in zip(L._varchar(F.col("x"), 3), ("v", "bad"))]).collect()
    assert [(r.v, r.bad) for r in rows] == [("ab ", False), (None, True), ("ab", False)]


def test_tracking_columns_of_present_tables(spark):
    from lineforge import schemas
    from lineforge.operators import tables as TB
    have = [("pm1", c) for c in schemas.TRACKING_COLUMNS] + [("pm2", "batch_id"), ("pm2", "x")]
    present = spark.createDataFrame([("pm1",), ("pm2",), ("pm3",)], "table_name string")
    out = {r.table_name: r for r in TB.required_tables_check(
        spark, present, ("pm1", "pm2", "pm3", "pm4"), spark.createDataFrame(have, "table_name string, column_name string")).collect()}
    assert [out[t].action for t in ("pm1", "pm2", "pm3", "pm4")] == ["ok", "add columns", "add columns", "missing"]
    assert set(out["pm2"].missing_columns) == set(schemas.TRACKING_COLUMNS) - {"batch_id"}


def test_reports_and_summaries_add_up(spark, tmpdir_path):
    import os

    from lineforge.operators import manifest as M
    m = spark.createDataFrame(
        [("b1", "PM462", "FAILED", "bad", "d", 10, 5, 7, "pm4"), ("b2", "PM463", "COMPLETED", None, None, 10, 5, 7, "pm4")],
        "batch_id string, file_name string, status string, error_message string, error_details string, file_size_bytes long, "
        "total_records long, processing_duration_ms long, table_name string").selectExpr(
        "*", "timestamp'2024-01-01 00:00:00' AS started_at", "timestamp'2024-01-01 00:00:01' AS completed_at")
    reports, sums = (os.path.join(tmpdir_path, x) for x in ("reports", "sums"))
    for _ in range(2):
        M.write_error_reports(m, reports)
        M.write_done_summaries(m, sums)
    assert spark.read.json(reports).count() == 2
    assert spark.read.parquet(sums).count() == 4
