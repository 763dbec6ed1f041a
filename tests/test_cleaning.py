"""Cleaning and tab-check goldens (rule: 5 tabs, auto-fix, no reject, all cleaning flags)."""

from pyspark.sql import functions as F

from lineforge import schemas
from lineforge.functions import text as tx
from lineforge.operators import validate as V

TAB, C1, C2, C3 = "\t", "\u0001", "\u0002", "\u0003"


def _rules(spark, **flags):
    seed = dict(file_pattern="TST", table_name="tst", expected_tab_count=5, validation_enabled=True,
                auto_fix_enabled=True, reject_on_violation=False, replace_control_chars=True,
                replace_non_latin_chars=True, collapse_consecutive_replaced=True,
                enable_data_transformation=False, transformer_class_name=None, description="test")
    seed.update(flags)
    names = ("file_pattern", "table_name", "expected_tab_count", "validation_enabled", "auto_fix_enabled",
             "reject_on_violation", "replace_control_chars", "replace_non_latin_chars",
             "collapse_consecutive_replaced", "enable_data_transformation", "transformer_class_name",
             "description")
    return V.rules_df(spark, seeds=(tuple(seed[n] for n in names),))


def _run(spark, lines, **flags):
    df = spark.createDataFrame([("b1", "TST1", "TST", i + 1, ln) for i, ln in enumerate(lines)],
                               "batch_id string, file_name string, file_pattern string, line_number long, line string")
    v = V.validate_lines(V.rule_join(df, _rules(spark, **flags)))
    rows = v.orderBy("line_number").collect()
    issues = V.validation_issues(v).orderBy("line_number", "issue_seq").collect()
    return rows, issues


def test_control_chars_replaced(spark):
    line = f"field1{C1}{C2}field2{TAB}field3{C3}{TAB}field4{TAB}field5{TAB}field6"
    rows, issues = _run(spark, [line])
    assert all(ord(c) >= 32 or c == TAB for c in rows[0].cleaned)
    assert "*" in rows[0].cleaned
    kinds = [(i.issue_type, i.severity, i.auto_fixed) for i in issues]
    assert ("CONTROL_CHARACTERS", "WARNING", True) in kinds
    # the line has 4 tabs: also an insufficient-tab issue
    assert ("INSUFFICIENT_TABS", "ERROR", False) in kinds
    ctrl = [i for i in issues if i.issue_type == "CONTROL_CHARACTERS"][0]
    assert ctrl.description == "Line 1: Found 3 control character(s), replaced with asterisk"
    assert ctrl.fix_description == "Replaced 3 control character(s) with asterisk (*)"


def test_non_latin_replaced(spark):
    rows, issues = _run(spark, ["café\t世界\tñoño\t☕\ttest\tfield6"])
    assert "caf*" in rows[0].cleaned
    assert rows[0].cleaned.isascii()
    assert any(i.issue_type == "NON_LATIN_CHARACTERS" for i in issues)


def test_consecutive_collapsed(spark):
    rows, issues = _run(spark, [f"field1{C1}{C2}{C3}\tfield2世界日本\ta\tb\tc\tfield6"])
    assert "**" not in rows[0].cleaned
    col = [i for i in issues if i.issue_type == "CONSECUTIVE_REPLACED_CHARS"]
    assert col and col[0].description.endswith("consecutive replaced character(s) collapsed, replaced with asterisk")
    assert rows[0].n_collapsed == 5  # 3 + 4 asterisks -> 2


def test_flags_off_untouched(spark):
    line = f"café{C1}世界\ta\tb\tc\td\te"
    rows, issues = _run(spark, [line], replace_control_chars=False, replace_non_latin_chars=False,
                        collapse_consecutive_replaced=False)
    assert rows[0].cleaned == line
    assert not [i for i in issues if i.issue_type in ("CONTROL_CHARACTERS", "NON_LATIN_CHARACTERS")]


def test_excess_tabs_fixed(spark):
    line = f"field1{C1}\tfield2\t\tfield3世界\tfield4\t\tfield5\t\tfield6"
    rows, issues = _run(spark, [line])
    r = rows[0]
    assert r.tab_issue == "EXCESS_TABS" and r.tab_fixed
    assert r.fixed_line.count(TAB) == 5
    tab = [i for i in issues if i.issue_type == "EXCESS_TABS"][0]
    assert tab.severity == "WARNING" and tab.auto_fixed
    assert tab.fix_description == "Converted 3 excess tabs to spaces"
    assert tab.description == "Line 1: Expected 5 tabs but found 8 tabs"
    assert tab.expected_value == "5 tabs" and tab.actual_value == "8 tabs"


def test_valid_line_unchanged(spark):
    line = "field1 with spaces\tfield2  \tfield3\tfield4\tfield5\tfield6"
    rows, issues = _run(spark, [line])
    assert rows[0].fixed_line == line and not issues


def test_empty_line_insufficient(spark):
    rows, issues = _run(spark, [""])
    assert [i.issue_type for i in issues] == ["INSUFFICIENT_TABS"]
    assert rows[0].tab_count == 0


def test_three_lines(spark):
    good = "a\tb\tc\td\te\tf"
    rows, issues = _run(spark, [good, f"a{C1}\tb\tc\td\te\tf", "á\tb\tc\td\te\tf"])
    by_line = {}
    for i in issues:
        by_line.setdefault(i.line_number, []).append(i.issue_type)
    assert 1 not in by_line
    assert by_line[2] == ["CONTROL_CHARACTERS"]
    assert by_line[3] == ["NON_LATIN_CHARACTERS"]


def test_only_control_flag(spark):
    rows, _ = _run(spark, [f"café{C1}世界\tb\tc\td\te\tf"], replace_non_latin_chars=False,
                   collapse_consecutive_replaced=False)
    assert rows[0].cleaned == "café*世界\tb\tc\td\te\tf"


def test_reject_on_violation_critical(spark):
    rows, issues = _run(spark, ["a\tb", "a\tb\tc\td\te\tf\tg"], reject_on_violation=True, auto_fix_enabled=False)
    assert [i.severity for i in issues] == ["CRITICAL", "CRITICAL"]
    df = spark.createDataFrame([("b1", "TST1", "TST", 1, "a\tb")],
                               "batch_id string, file_name string, file_pattern string, line_number long, line string")
    v = V.validate_lines(V.rule_join(df, _rules(spark, reject_on_violation=True, auto_fix_enabled=False)))
    gate = V.reject_gate(V.validation_issues(v)).collect()
    assert gate[0].rejected and gate[0].critical_issues == 1


def test_no_rule_passes_through(spark):
    df = spark.createDataFrame([("b", "XX1", "XX1", 1, f"a{C1}\t\t\t")],
                               "batch_id string, file_name string, file_pattern string, line_number long, line string")
    v = V.validate_lines(V.rule_join(df, V.rules_df(spark)))
    r = v.collect()[0]
    assert not r.validated and r.fixed_line == f"a{C1}\t\t\t" and r.tab_issue is None


def test_supplementary_counts_two(spark):
    df = spark.createDataFrame([("a😀b",)], "x string")
    r = df.select(tx.count_non_latin("x").alias("n"),
                  tx.count_replacements(F.col("x"), tx.replace_non_latin("x")).alias("m")).collect()[0]
    assert r.n == 2 and r.m == 2


def test_fix_excess_tabs_expression(spark):
    df = spark.createDataFrame([("a\tb\tc\td",), ("a\tb",), ("\t\t\t",)], "x string")
    got = [r.y for r in df.select(tx.fix_excess_tabs("x", 2).alias("y")).collect()]
    assert got == ["a\tb\tc d", "a\tb", "\t\t "]


def test_issue_text_guard(spark):
    df = spark.createDataFrame([("\u0000" + "x" * 600,)], "x string")
    r = df.select(tx.issue_text("x").alias("y")).collect()[0].y
    assert r.startswith("*") and len(r) == 503 and r.endswith("...")


def test_quality_status_order(spark):
    cases = [((0, 0, 0), "CLEAN"), ((1, 1, 0), "CORRECTED"), ((1, 1, 1), "WITH_ERRORS"),
             ((0, 1, 0), "WITH_WARNINGS"), ((0, 0, 1), "CLEAN")]
    df = spark.createDataFrame([c for c, _ in cases], "c int, w int, e int")
    got = [r.s for r in df.select(V.quality_status("c", "w", "e").alias("s")).collect()]
    assert got == [s for _, s in cases]


def test_rule_seeds_match_schema():
    assert len(schemas.RULE_SEEDS) == 10
    for seed in schemas.RULE_SEEDS:
        table = seed[1]
        # expected tabs = data columns - 1, except the first-N tables PM2 / PM3
        width = len(schemas.TABLES[table])
        assert seed[2] in (width - 1, width - 2)


def test_first_line_keeps_its_columns(spark, tmpdir_path):
    """The query gives file name and text of each first line, of rows that come twice too."""
    import duckdb

    from lineforge.plans import catalog

    spark.createDataFrame([(1, "en", "a b c\nd"), (1, "fr", "x\ny z"), (2, "de", "\nq"), (3, None, "one q"), (4, "en", None), (None, "fr", "n m")],
                          "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmpdir_path}/documents.parquet")
    got = catalog.QUERIES["first_line"](spark, tmpdir_path)
    assert got.columns == ["batch_id", "file_name", "first_line", "field_count"]
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmpdir_path}/documents.parquet/*.parquet'")
        want = con.execute(catalog.ORACLE["first_line"]).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
