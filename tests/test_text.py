import datetime
import re

import pytest
from pyspark.sql import functions as F

from ligneo.functions import text


def value(spark, raw, expression):
    return spark.createDataFrame([(raw,)], "v string").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw, expected", [
    ("20250310", datetime.date(2025, 3, 10)), ("10032025", datetime.date(2025, 3, 10)), ("10/03/2025", datetime.date(2025, 3, 10)),
    ("99999999", None), ("01021201", None), ("00010101", None), ("2025", None), ("", None),
])
def test_parse_date(spark, raw, expected):
    assert value(spark, raw, text.parse_date) == expected


@pytest.mark.parametrize("raw, start, length, expected", [
    ("ABC", 1, 2, "AB"), ("ABC", 3, 5, "C"), ("ABC", 4, 1, ""), (" \tA\u00a0", 1, 9, "A"),
])
def test_field(spark, raw, start, length, expected):
    assert value(spark, raw, lambda c: text.field(c, start, length)) == expected


@pytest.mark.parametrize("raw, expected", [("0" * 60, False), (" 0" * 30, False), ("A" * 49, False), ("A" + "0" * 49, True)])
def test_valid_line(spark, raw, expected):
    assert value(spark, raw, text.is_valid_line) is expected


@pytest.mark.parametrize("raw, expected", [("02", 2), (" 2", 2), ("x2", 0), ("-2", 0), ("2", 0), ("", 0)])
def test_counter(spark, raw, expected):
    assert value(spark, raw, lambda c: text.counter(c, 1, 2)) == expected


def test_put_field_pads_short_line_and_cuts_value(spark):
    assert value(spark, "AB", lambda c: text.put_field(c, 4, 2, "xyz")) == "AB xy"
    assert value(spark, "ABCDEF", lambda c: text.put_field(c, 2, 3, "x")) == "Ax  EF"


@pytest.mark.parametrize("raw, expected", [
    ("IPP 0000000000001", "IPP [masqué]"), (r"D:\PMSI\2024", r"D:\PMSI\2024"), ("12345678", "12345678"), ("123456789", "[masqué]"),
])
def test_redact(spark, raw, expected):
    assert value(spark, raw, text.redact_digit_runs) == expected


@pytest.mark.parametrize("raw, expected", [("=1+1", "'=1+1"), ("\tx", "'\tx"), ("a=b", "a=b"), ("", "")])
def test_csv_guard(spark, raw, expected):
    assert value(spark, raw, text.csv_guard) == expected


@pytest.mark.parametrize("raw, expected", [("94 800", "940000"), ("9", "9"), ("94800", "94000"), (" 948 ", "940  ")])
def test_postal_code(spark, raw, expected):
    assert value(spark, raw, text.postal_code) == expected


@pytest.mark.parametrize("a, b, expected", [("abc", "abc", 0), ("abc", "abd", 1), ("abc", "ab", 1), ("", "ab", 2), ("xbc", "ab", 2)])
def test_line_distance(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(text.line_distance(F.col("a"), F.col("b")).alias("d"))
    assert row.first()["d"] == expected


def test_latin1_replaces_foreign_characters(spark):
    assert value(spark, "é€a", lambda c: F.decode(text.latin1(c).cast("binary"), "ISO-8859-1")) == "é?a"


def test_a_value_that_is_named_often_is_cut_once(spark, specs, lines_of):
    """A date is read from one slice of its piece, not from four of the whole line."""
    from ligneo.operators import records

    lines = lines_of(("a", "RPS", ["x" * 110 + "01022024" + "31022024" + " " * 24 + "0000", "short", ""]))
    main, _, _ = records.rps_tables(lines, specs["RPS"], 2024)
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = main._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(re.findall(r"_piece3#\d+, 15, 8\)", plan)) == 2  # as a key and as a field
    got = [(str(r["dtdebseq"]), r["dtfinseq"], str(r["DATE_DE_DEBUT_DE_SEQUENCE"]), r["das"]) for r in main.orderBy("line_no").collect()]
    assert got == [("2024-02-01", None, "2024-02-01", ""), ("None", None, "None", ""), ("None", None, "None", "")]
