"""IM2 transform goldens, pin fixes, rule-driven dispatch and the audit issue."""

import pytest
from pyspark.sql import functions as F

from lineforge.functions import text as tx
from lineforge.operators import transform as TR
from lineforge.operators import validate as V

IM2_CASES = [
    ("  field1  \t  field2  \t  field3  \t  field4  ", "field1\tfield2\tfield3\tfield4"),
    ("field1\tfield2\tfield3\t0000/00/00\tfield5", "field1\tfield2\tfield3\t\tfield5"),
    ("field1\tfield2\tfield3\t2023/12/25\tfield5", "field1\tfield2\tfield3\t2023/12/25\tfield5"),
    ("field1\tfield2\tfield3\t0000/12/25\tfield5", "field1\tfield2\tfield3\t0000/12/25\tfield5"),
    ("field1\tfield2", "field1\tfield2"),
    ("field1\tfield2\tfield3\t0000/00/00", "field1\tfield2\tfield3\t"),
    ("field1\t\tfield3\t0000/00/00\t\tfield6", "field1\t\tfield3\t\t\tfield6"),
    ("", ""),
    (None, None),
]


def test_im2_goldens(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(IM2_CASES)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", tx.im2_transform("x").alias("y")).collect()}
    assert [got[i] for i in range(len(IM2_CASES))] == [b for _, b in IM2_CASES]


@pytest.mark.parametrize("line,expected", [
    ("12345\t\tabc", "12345\t0000\tabc"),
    ("1234567", "1234567"),            # length 7 is not > 7
    ("12345\t1234\tx", "12345\t1234\tx"),
])
def test_pin_fix_control(spark, line, expected):
    r = spark.createDataFrame([(line,)], "x string").select(tx.pin_fix_control("x").alias("y")).collect()[0]
    assert r.y == expected


@pytest.mark.parametrize("line,expected", [
    ("12345\t    \tdesc", "12345\t0000\tdesc"),
    ("12345\t\tab", "12345\t0000"),
    ("12345\t0319\tx", "12345\t0319\tx"),
    ("123456", "123456"),
    ("12345\t٣abc", "12345\t٣abc"),  # a Unicode digit counts as a digit
])
def test_pin_fix_nondigit(spark, line, expected):
    r = spark.createDataFrame([(line,)], "x string").select(tx.pin_fix_nondigit("x").alias("y")).collect()[0]
    assert r.y == expected


def _rules(spark, pattern, name, enabled=True):
    seeds = [s for s in __import__("lineforge.schemas", fromlist=["RULE_SEEDS"]).RULE_SEEDS]
    return V.rules_df(spark, seeds=seeds, overrides={pattern: {"enable_data_transformation": enabled,
                                                               "transformer_class_name": name}})


def _lines(spark, pattern, lines):
    return spark.createDataFrame([("b", pattern + "62", pattern, i + 1, ln) for i, ln in enumerate(lines)],
                                 "batch_id string, file_name string, file_pattern string, line_number long, line string")


@pytest.mark.parametrize("name", ["pm2", "PM2Transformer", "some.pkg.PM2Transformer"])
def test_dispatch_by_rule_name(spark, name):
    v = V.validate_lines(V.rule_join(_lines(spark, "PM2", ["12345\t    \tL1\tI\tR"]), _rules(spark, "PM2", name)))
    out = TR.apply_transform(v).collect()[0]
    assert out.out_line == "12345\t0000\tL1\tI\tR"


@pytest.mark.parametrize("name,enabled", [(None, True), ("", True), ("unknown", True), ("pm2", False)])
def test_disabled_or_unknown_is_noop(spark, name, enabled):
    v = V.validate_lines(V.rule_join(_lines(spark, "PM2", ["12345\t\tab\tx\ty"]),
                                     _rules(spark, "PM2", name, enabled)))
    out = TR.apply_transform(v).collect()[0]
    assert out.out_line == out.fixed_line and out.transform_key is None


def test_audit_issue(spark):
    v = V.validate_lines(V.rule_join(_lines(spark, "PM2", ["12345\t    \tL1\tI\tR", "12345\t0319\tx\ty\tz"]),
                                     _rules(spark, "PM2", "pm2")))
    audit = TR.transform_audit(TR.apply_transform(v)).collect()
    assert len(audit) == 1
    a = audit[0]
    assert (a.file_name, a.line_number, a.issue_type, a.severity, a.auto_fixed) == ("PM2", 1, "DATA_TRANSFORMATION",
                                                                                    "WARNING", True)
    assert a.description == "Empty PIN value '0000' inserted"
    assert a.fix_description == "Applied data transformation (empty PIN fix)"
    assert a.original_line == "12345\t    \tL1\tI\tR" and a.corrected_line == "12345\t0000\tL1\tI\tR"


def test_user_transform_can_drop_lines(spark):
    reg = dict(TR.registered())
    reg["dropx"] = lambda line, n: F.when(line.startswith("x"), F.lit(None)).otherwise(F.upper(line))
    v = V.validate_lines(V.rule_join(_lines(spark, "PM4", ["x\ta\tb\tc", "y\ta\tb\tc"]),
                                     _rules(spark, "PM4", "dropx")))
    TR.register_transform("dropx", reg["dropx"])
    out = TR.apply_transform(v).orderBy("line_number").collect()
    assert [r.out_line for r in out] == ["Y\tA\tB\tC"]


def _ruled(spark):
    return spark.createDataFrame(
        [("b", 1, "one", True, "mine"), ("b", 2, "two", True, "pm1"), ("b", 3, "bad", True, "MineTransformer"), ("b", 4, "four", False, "mine")],
        "batch_id string, line_number long, fixed_line string, enable_data_transformation boolean, transformer_class_name string")


def test_a_passed_registry_is_honoured(spark):
    out = TR.apply_transform(_ruled(spark), registry={"mine": lambda line, n: F.upper(line)})
    assert {r.line_number: r.out_line for r in out.collect()} == {1: "ONE", 2: "two", 3: "BAD", 4: "four"}
    assert TR.apply_transform(_ruled(spark), registry={}).count() == 4


def test_a_failing_python_transform_keeps_the_line(spark):
    def shout(line, number):
        if line == "bad":
            raise ValueError(line)
        return None if number == 9 else line.upper() + str(number)

    out = TR.apply_transform(_ruled(spark), registry={"mine": TR.python_transform(shout)})
    assert {r.line_number: r.out_line for r in out.collect()} == {1: "ONE1", 2: "two", 3: "bad", 4: "four"}
