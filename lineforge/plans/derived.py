"""Delivery-shaped relations derived from the driver tables.

The engine works on delivery lines, tab rows, manifests and file names; the
test tables are TPC-H-like.  These functions turn the given tables into those
shapes with plain DataFrame expressions (and :mod:`.oracle` states the same
derivations in SQL), so every query's work grows with the tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import drop_shuffles, spread
from ..operators.validate import rules_df

# How documents map to delivery file types, and the run's rule
# overrides (PM5 rejects violations, PM3/PM5 run their pin fixes).
LANG_PATTERN = (("en", "PM3"), ("fr", "IM2"), ("de", "PM5"))
OTHER_PATTERN = "PM7"
OFFICE = "62"
RUN_OVERRIDES = {
    "PM5": {"reject_on_violation": True, "auto_fix_enabled": False,
            "enable_data_transformation": True, "transformer_class_name": "pm5"},
    "PM3": {"enable_data_transformation": True, "transformer_class_name": "pm3"},
}


# Lines that a task packs into archives.
ROWS_PER_TASK = 300_000

# When the rules of the queries were made.
SEEDED = dt.datetime(2024, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_rules(spark: SparkSession) -> DataFrame:
    return rules_df(spark, overrides=RUN_OVERRIDES, at=SEEDED)


def lang_pattern(lang_col) -> F.Column:
    expr = None
    for lang, pat in LANG_PATTERN:
        expr = (F.when(lang_col == lang, F.lit(pat)) if expr is None
                else expr.when(lang_col == lang, F.lit(pat)))
    return expr.otherwise(F.lit(OTHER_PATTERN))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as delivery lines: one batch per document.

    Text is split on LF (trailing empty line kept), spaces become tabs and
    ``q`` becomes U+0001 so the tab and control-character paths are exercised.
    """
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    pat = lang_pattern(F.col("lang"))
    return d.select(
        F.col("doc_id").cast("string").alias("batch_id"),
        F.concat(pat, F.lit(OFFICE)).alias("file_name"),
        pat.alias("file_pattern"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "raw"),
    ).select(
        "batch_id", "file_name", "file_pattern",
        (F.col("pos") + 1).cast("long").alias("line_number"),
        F.replace(F.replace(F.col("raw"), F.lit(" "), F.lit("\t")), F.lit("q"), F.lit("\u0001")).alias("line"),
    )


def doc_plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` split into numbered lines, text untouched."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        F.col("doc_id").cast("string").alias("batch_id"),
        F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "line"),
    ).select("batch_id", (F.col("pos") + 1).cast("long").alias("line_number"), "line")


def money(c) -> F.Column:
    """Non-negative doubles as 2-decimal text from floor(x * 100): identical in every engine."""
    cents = F.floor(F.col(c) * 100).cast("long")
    return F.concat((F.floor(cents / 100)).cast("long").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def orders_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` serialised as headerless tab rows of an IM1-shaped delivery.

    Fields: lro_num, instrument_num, registration_date (yyyy/MM/dd),
    interest_code (priority), qualifier_code (status), -, -, consideration_amt.
    Keys ending in 007 leave the instrument number empty (NOT NULL
    violation) and keys ending in 003 get a 12-char instrument number (width
    violation), so the load gate has batches to fail.  File names are
    ``IM1nn`` (or ``IM3nn`` for every fifth customer: too many fields).
    """
    o = spread(table(spark, sf_dir, "orders"))
    key = F.col("o_orderkey")
    instr = F.when(key % 1000 == 7, F.lit("")) \
        .when(key % 1000 == 3, F.lpad(key.cast("string"), 12, "0")) \
        .otherwise(key.cast("string"))
    line = F.concat_ws(
        "\t", (F.col("o_custkey") % 100).cast("string"), instr,
        F.date_format("o_orderdate", "yyyy/MM/dd"), F.substring("o_orderpriority", 1, 1),
        F.col("o_orderstatus"), F.lit(""), F.lit(""), money("o_totalprice"))
    fname = F.concat(F.lit("IM"), F.when(F.col("o_custkey") % 5 == 0, F.lit("3")).otherwise(F.lit("1")),
                     F.lpad((F.col("o_custkey") % 97).cast("string"), 2, "0"))
    return o.select(
        fname.alias("file_name"),
        fname.alias("batch_id"),
        key.alias("line_number"),
        line.alias("line"),
    )


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as CSV lines with quoted commas, doubled quotes, padding and short rows."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    s = lambda c: F.col(c).cast("string")
    long = F.concat(s("p_partkey"), F.lit(',"'), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(' ""'),
                    "p_brand", F.lit('""",  '), "p_type", F.lit("  ,"), s("p_size"), F.lit(","))
    short = F.concat(s("p_partkey"), F.lit(","), "p_type")
    line = F.when(F.col("p_partkey") % 3 == 0, short).otherwise(long)
    header = F.concat(F.lit('"'), "p_name", F.lit('",'), "p_brand", F.lit(","), s("p_size"),
                      F.lit(" Units,,__"), "p_type", F.lit("__"))
    return p.select("p_partkey", line.alias("line"), header.alias("header"))


def manifest_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an ingestion manifest: one row per event.

    batch_id = event_id, parent = user_id, created_at = started_at = ts,
    total = floor(value), status by event_type, checksum = sha256(props),
    completed_at = ts + value seconds for finished attempts.  PROCESSING rows
    report 1.5 x total processed so the constraint check has rows to flag.
    """
    from ..functions import names as N
    from ..operators.manifest import duration_ms
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    status = F.when(et == "purchase", F.lit("COMPLETED")).when(et == "error", F.lit("FAILED")) \
        .when(et == "view", F.lit("PROCESSING")).when(et == "click", F.lit("PENDING")) \
        .otherwise(F.lit("DUPLICATE"))
    total = F.floor(F.col("value")).cast("long")
    fname = F.concat(F.lit("PM"), (F.col("event_id") % 7 + 1).cast("string"), F.lit("62"))
    done = F.when(et.isin("purchase", "error"), F.expr(
        "timestampadd(MICROSECOND, CAST(round(value * 1000000) AS BIGINT), ts)"))
    m = e.select(
        F.col("event_id").cast("string").alias("batch_id"),
        F.col("user_id").cast("string").alias("parent_batch_id"),
        fname.alias("file_name"),
        F.concat(F.lit("upload://"), fname).alias("file_path"),
        F.length("props").cast("long").alias("file_size_bytes"),
        F.sha2(F.col("props"), 256).alias("file_checksum"),
        N.route_table(fname).alias("table_name"),
        status.alias("status"),
        total.alias("total_records"),
        F.when(et == "purchase", total).when(et == "view", F.floor(F.col("value") * 1.5).cast("long"))
        .otherwise(F.lit(0).cast("long")).alias("processed_records"),
        F.lit(0).cast("long").alias("failed_records"),
        F.when(et == "error", F.lit("REJECTED")).otherwise(F.lit("CLEAN")).alias("data_quality_status"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("started_at"),
        done.alias("completed_at"),
        F.when(et == "error", F.concat(F.lit("Load failed for event "), F.col("event_id").cast("string")))
        .alias("error_message"),
        F.when(et == "error", F.col("props")).alias("error_details"),
        F.lit("system").alias("created_by"),
    )
    return m.withColumn("processing_duration_ms", duration_ms())


def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as archive children: archive = customer, one entry per order.

    Entry name ``PM<k>62`` with k = key % 9 + 1 (pm8/pm9 are not known tables); status from o_orderstatus
    (F -> FAILED, P -> DUPLICATE, else SUCCESS); rows = lineitems of the order.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left")
    status = F.when(F.col("o_orderstatus") == "F", F.lit("FAILED")) \
        .when(F.col("o_orderstatus") == "P", F.lit("DUPLICATE")).otherwise(F.lit("SUCCESS"))
    return j.select(
        F.col("o_custkey").cast("string").alias("parent_batch_id"),
        F.col("o_orderkey").cast("string").alias("batch_id"),
        F.concat(F.lit("PM"), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("62")).alias("filename"),
        status.alias("status"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("long").alias("rows"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"))
        .alias("duplicate_of"),
        F.col("o_orderdate").alias("original_completed_at"),
        F.when(status == "FAILED", F.concat(F.lit("Load failed for order "), F.col("o_orderkey").cast("string")))
        .alias("error_message"),
    )


def pin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as PM4-shaped pin lines ``block(5) TAB pin(4) TAB block TAB pin``.

    Line 1 of each order has an empty pin, line 2 a blank (4 spaces) pin, so
    both pin fixes have lines to repair.
    """
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    pad = lambda c, n: F.lpad((c).cast("string"), n, "0")
    pin = F.when(F.col("l_linenumber") == 1, F.lit("")) \
        .when(F.col("l_linenumber") == 2, F.lit("    ")) \
        .otherwise(pad(F.col("l_partkey") % 10000, 4))
    line = F.concat_ws("\t", pad(F.col("l_orderkey") % 100000, 5), pin,
                       pad(F.col("l_suppkey") % 100000, 5), pad(F.col("l_linenumber"), 4))
    return li.select(F.col("l_orderkey").cast("string").alias("batch_id"),
                     F.col("l_linenumber").cast("long").alias("line_number"), line.alias("line"))


def im2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer ⋈ orders`` as IM2-shaped lines with padding and zero dates.

    Keys ending in 0 or 5 carry ``0000/00/00``, keys ending in 1 or 6 a
    blank date, the rest ``yyyy/MM/dd``; codes and names carry spaces.
    """
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                              "o_orderpriority")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey") % 5
    day = F.when(k == 0, F.lit("0000/00/00")).when(k == 1, F.lit(" ")) \
        .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    line = F.concat_ws(
        "\t", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
        F.rpad(F.col("o_orderkey").cast("string"), 10, " "), F.col("o_orderstatus"), day,
        F.rpad(F.substring("c_mktsegment", 1, 3), 6, " "), F.col("c_name"),
        F.concat(F.lit(" "), F.substring("o_orderpriority", 1, 1)), F.lit(" 1/2 "),
        F.concat(F.lit("  "), F.col("c_name"), F.lit("  ")))
    return j.select(F.col("o_custkey").cast("string").alias("batch_id"),
                    F.col("o_orderkey").cast("long").alias("line_number"), line.alias("line"))



def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as delivery file names of ten shapes (routable, extensions, hidden, ...)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey") % 10
    s = lambda c: c.cast("string")
    digit = s(F.col("p_size") % 9 + 1)
    name = F.when(k == 0, F.concat(F.lit("PM"), digit, F.lpad(s(F.col("p_partkey") % 100), 2, "0"))) \
        .when(k == 1, F.concat(F.lit("IM"), s(F.col("p_size") % 4), F.lit("62.txt"))) \
        .when(k == 2, F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".csv"))) \
        .when(k == 3, F.concat("p_brand", F.lit(".CSV.gz"))) \
        .when(k == 4, F.concat("p_type", F.lit("_"), "p_name", F.lit(".zip"))) \
        .when(k == 5, F.concat("p_name", F.lit(".tsv"))) \
        .when(k == 6, F.concat(F.lit("."), "p_brand")) \
        .when(k == 7, F.lower(F.concat(F.lit("PM"), digit, F.lit("62")))) \
        .when(k == 8, F.concat("p_brand", F.lit("."))) \
        .otherwise(F.concat(F.lit("__"), F.upper("p_name"), F.lit("__.Csv.ZIP")))
    return p.select("p_partkey", "p_brand", "p_size", name.alias("name"))


def doc_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as delivered files: one file per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    pat = lang_pattern(F.col("lang"))
    fname = F.concat(pat, F.lit(OFFICE))
    from ..functions import names as N
    return d.select(
        F.col("doc_id").cast("string").alias("batch_id"),
        F.lit(None).cast("string").alias("parent_batch_id"),
        fname.alias("file_name"),
        F.octet_length("text").cast("long").alias("file_size_bytes"),
        F.sha2(F.col("text"), 256).alias("file_checksum"),
        N.route_table(fname).alias("table_name"),
        F.col("doc_id").alias("arrival"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"),
    )


def write_deliveries(lines: DataFrame, out_dir: str) -> None:
    """One file per ``file_name`` of ``lines`` (LF-ended, in ``line_number`` order) under ``out_dir``, each followed by its marker.

    A delivery is a bounded group; files go through the Arrow file systems.
    """
    import pandas as pd

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..streaming.arrivals import MARKER, Folder

        folder, name = Folder(out_dir), str(pdf["file_name"].iloc[0])
        folder.write(name, "".join(x + "\n" for x in pdf.sort_values("line_number")["line"]).encode())
        folder.write(f"{name}{MARKER}", b"")
        return pd.DataFrame({"file_name": [name]})

    lines.select("file_name", "line_number", "line").groupBy("file_name").applyInPandas(build, "file_name string") \
        .write.format("noop").mode("overwrite").save()


def write_order_archives(spark: SparkSession, sf_dir: str, out_dir: str, damaged: bool = False) -> str:
    """One ZIP archive per customer under ``out_dir``; one entry per order.

    With ``damaged``, customers whose key leaves 7 of 50 have a byte of their
    first body changed, and those that leave 9 have half an archive.

    Entry ``<orderkey>/PM<k>62`` (k = key % 9 + 1), or ``orders_<orderkey>.csv``
    when the key is a multiple of 4; its lines are the order's pin lines in
    line-number order.  Rows reach a task sorted by customer, so it holds one
    customer's lines, and archives go through the Arrow file systems into a
    folder per task, so ``out_dir`` may be any URI the cluster can reach.
    """
    from pyspark import TaskContext

    from ..streaming.arrivals import Folder

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("batch_id"), F.col("o_custkey").alias("custkey"))
    lines = pin_lines(spark, sf_dir).join(orders, "batch_id").select("custkey", F.col("batch_id").cast("long").alias("k"), "line_number", "line")

    def archive(cust: int, entries: list[tuple[int, list[str]]]) -> bytes:
        import io
        import zipfile

        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for key, found in entries:
                name = f"orders_{key}.csv" if key % 4 == 0 else f"{key}/PM{key % 9 + 1}62"
                z.writestr(name, "".join(ln + "\n" for ln in found))
        data = bytearray(buf.getvalue())
        if damaged and cust % 50 == 7:
            data[30 + int.from_bytes(data[26:28], "little") + int.from_bytes(data[28:30], "little")] ^= 0xFF
        elif damaged and cust % 50 == 9:
            data = data[:len(data) // 2]
        return bytes(data)

    def build(batches):
        import pyarrow as pa

        folder = Folder(f"{out_dir}/{TaskContext.get().partitionId():05d}")  # a folder per task: they are listed in parallel
        written, cust, entries = 0, None, []
        for batch in batches:
            for c, k, line in zip(*(batch.column(n).to_pylist() for n in ("custkey", "k", "line"))):
                if entries and c != cust:
                    folder.put(f"cust_{int(cust)}.zip", archive(int(cust), entries))
                    written, entries = written + 1, []
                if not entries or entries[-1][0] != k:
                    entries.append((k, []))
                cust = c
                entries[-1][1].append(line)
        if entries:
            folder.put(f"cust_{int(cust)}.zip", archive(int(cust), entries))
            written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["archives"])

    # by number: AQE would pack the narrow rows of many archives into a few tasks
    parts = max(4 * spark.sparkContext.defaultParallelism, table(spark, sf_dir, "lineitem").count() // ROWS_PER_TASK)
    lines.repartition(parts, "custkey").sortWithinPartitions("custkey", "k", "line_number") \
        .select("custkey", "k", "line").mapInArrow(build, "archives long").write.format("noop").mode("overwrite").save()
    drop_shuffles(spark)
    return out_dir
