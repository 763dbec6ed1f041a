"""Naming, routing, extension, admission and CSV text goldens."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lineforge.functions import csvtext as CV
from lineforge.functions import names as N
from lineforge.operators.admission import admit, admit_all


def _apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    rows = df.select("i", fn(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_sanitize_column_name(spark):
    cases = {"Customer Name": "customer_name", "Order#": "order", "Price ($)": "price",
             "test___name": "test_name", "__test__": "test", "123abc": "col_123abc",
             "1st Place": "col_1st_place", "FIRST-NAME": "first_name"}
    assert _apply(spark, N.sanitize_column_name, list(cases)) == list(cases.values())


def test_table_name_from_file(spark):
    cases = {"customer-data@2024.csv": "customer_data_2024", "@@@###.csv": "csv_data", "DATA.CSV": "data",
             "test___data___file.csv": "test_data_file", "data.csv.gz": "data", "archive.zip": "archive",
             "a" * 80 + ".csv": "a" * 63}
    assert _apply(spark, N.table_name_from_file, list(cases)) == list(cases.values())


def test_route_and_pattern(spark):
    names = ["PM162", "IM362.txt", "pm162", "PM16", "orders"]
    assert _apply(spark, N.route_table, names) == ["pm1", "im3", None, None, None]
    assert _apply(spark, N.file_pattern, ["IM262", "PM1_data.tsv", "orders.csv"]) == ["IM2", "PM1", "orders"]


def test_extension_rules(spark):
    assert _apply(spark, N.file_extension, ["orders.csv", ".hidden", "noext", "a.tar.gz", "x."]) == \
        [".csv", "", "", ".gz", "."]
    assert _apply(spark, N.strip_extension, ["orders.csv", ".hidden", "a.tar.gz"]) == ["orders", ".hidden", "a.tar"]


def test_timestamped_name(spark):
    ts = dt.datetime(2025, 10, 30, 14, 30, 0)
    df = spark.createDataFrame([("orders.csv", ts), ("datafile", ts), ("archive.tar.gz", ts)],
                               "n string, t timestamp_ntz")
    got = [r.y for r in df.select(N.timestamped_name("n", "t").alias("y")).collect()]
    assert got == ["orders_2025-10-30_14-30-00.csv", "datafile_2025-10-30_14-30-00",
                   "archive.tar_2025-10-30_14-30-00.gz"]


def test_admission(spark):
    df = spark.createDataFrame([("a.csv", 10), ("PM162", 10), ("x.exe", 10), ("e.csv", 0), (" ", 5)],
                               "name string, size long")
    got = [r.reason for r in admit(df, allowed=("csv", "")).collect()]
    assert got[0] is None and got[1] is None
    assert got[2] == "Invalid file type. Expected CSV, (no extension) file but received 'x.exe'. Please upload a valid file."
    assert got[3] == "File is empty or not provided"
    assert got[4] == "Invalid filename"
    req = spark.createDataFrame([("r", 1, "a.csv", 1), ("r", 2, "b.exe", 1), ("r", 3, "c.exe", 1), ("s", 1, "d.csv", 1)],
                                "request_id string, position_key int, name string, size long")
    out = {r.request_id: r for r in admit_all(req, allowed=("csv",)).collect()}
    assert out["r"].message.startswith("File #2 validation failed: Invalid file type.")
    assert out["s"].admitted and out["s"].message is None


CSV_CASES = [
    ('John,"Smith, Jr.",30', ["John", "Smith, Jr.", "30"]),
    ('"O\'Reilly","Author ""John"" Doe",50', ["O'Reilly", 'Author "John" Doe', "50"]),
    ("a,,c,", ["a", "", "c", ""]),
    ("  x  , y ", ["x", "y"]),
    ('ab"cd"ef,g', ["abcdef", "g"]),
]


def test_csv_row_parse(spark):
    assert _apply(spark, CV.csv_row_parse, [a for a, _ in CSV_CASES]) == [b for _, b in CSV_CASES]


def test_csv_to_tsv(spark):
    got = _apply(spark, lambda c: CV.csv_to_tsv(c, 3), ["value1,value2", "a,b,c,d", '"x\ty",z,'])
    assert got == ["value1\tvalue2\t", "a\tb\tc", "x y\tz\t"]


def test_header_columns(spark):
    got = _apply(spark, lambda c: CV.header_columns(c, "csv"), ['Customer Name,"Price ($)",,1st'])
    assert got == [["customer_name", "price", "col_1st"]]
    got = _apply(spark, lambda c: CV.header_columns(c, "naive"), ["A, B ,,C,,"])
    assert got == [["a", "b", "", "c"]]


def test_detect_format(spark):
    df = spark.createDataFrame([("x.tsv", None), ("x.csv", " "), ("PM162", None), ("x.csv", "TSV"),
                                ("x", "json")], "n string, r string")
    got = [r.f for r in df.select(N.detect_format("n", "r").alias("f")).collect()]
    assert got == ["tsv", "csv", "tsv", "tsv", "invalid"]


def toggled(line):
    """The quote-toggle reading, character by character."""
    fields, field, inside, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if c == '"' and inside and line[i + 1:i + 2] == '"':
            field.append(c)
            i += 1
        elif c == '"':
            inside = not inside
        elif c == "," and not inside:
            fields.append("".join(field))
            field = []
        else:
            field.append(c)
        i += 1
    return [f.strip(" ") for f in [*fields, "".join(field)]]


def test_csv_parse_matches_toggle_reading_and_is_linear(spark):
    import random

    from lineforge.functions import csvtext as CV
    rng = random.Random(7)
    lines = ["".join(rng.choice('ab", "') for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    lines += ['"' + "x," * 500_000 + '"', ",".join('"a,b"' for _ in range(20_000)), '"' + '""' * 4_000 + '"']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for r in df.select("line", CV.csv_row_parse("line").alias("f")).collect():
        assert r.f == toggled(r.line), r.line[:80]
