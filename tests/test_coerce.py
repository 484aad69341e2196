import datetime as dt
import math
import random

from pyspark.sql import functions as F

from riskloom import fixed
from riskloom.functions import coerce
from riskloom.functions.numfmt import double_text, whole_text
from riskloom.operators import clean


def test_missing_tokens(column):
    words = fixed.NA_TOKENS + ["NONE", "none", " NA", "0", None]
    got = column(words, coerce.missing_to_null("s"))
    assert got == [None] * len(fixed.NA_TOKENS) + ["NONE", "none", " NA", "0", None]


def test_numbers(column):
    cases = {
        " 12 ": 12.0, "+7": 7.0, "1e5": 1e5, "1E+5": 1e5, ".5": 0.5, "5.": 5.0, "\t3\n": 3.0,
        "-0": 0.0, "1e400": math.inf, "inf": math.inf, "-Infinity": -math.inf, "iNf": math.inf,
    }
    assert column(list(cases), coerce.to_number(F.col("s"))) == list(cases.values())
    bad = ["nan", "1,234", "$5", "1_000", "0x10", "1d", "1.5f", "1e", "", "--3", "+ 5", "TRUE",
           "\xa05", "1.2.3", "１２", None]
    assert column(bad, coerce.to_number(F.col("s"))) == [None] * len(bad)


def test_nan_of_a_typed_column_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "x double")
    got = df.select(coerce.number_column(df, "x").alias("x")).collect()
    assert [r["x"] for r in got] == [None, 2.0]
    assert df.select(coerce.number_column(df, "absent").alias("x")).first()["x"] is None


def test_flags(column):
    on = ["y", " YES ", "True", "1", "t", "　Y"]
    off = ["n", "No", "FALSE", "0", "f", "maybe", "1.0", "", None]
    got = column(on + off, coerce.to_flag(F.col("s")))
    assert got == [1.0] * len(on) + [0.0] * len(off)


def test_01(column):
    got = column([None, -0.5, 0.9, 1.0, 1.7, math.inf], coerce.to_01(F.col("s")), "double")
    assert got == [0, 0, 0, 1, 1, 1]


def test_status(column):
    got = column(["  SUCCESS ", "a \t\n b", None, "", "\xa0x\x1fy", "straße"],
                 coerce.normalize_status(F.col("s")))
    assert got == ["SUCCESS", "A B", "UNKNOWN", "", "X Y", "STRASSE"]


def test_timestamps(column):
    good = dt.datetime(2026, 1, 2, 3, 4, 5)
    cases = ["2026-01-02 03:04:05", "2026-1-2 3:4:5", "2026-01-02  03:04:05"]
    assert column(cases, coerce.parse_timestamp(F.col("s"))) == [good] * 3
    bad = [" 2026-01-02 03:04:05", "2026-01-02", "2026-01-02T03:04:05", "2026-02-30 00:00:00",
           "2026-01-02 24:00:00", "12:30", "9999-12-31 00:00:00", "0001-01-01 00:00:00", "x", None]
    assert column(bad, coerce.parse_timestamp(F.col("s"))) == [None] * len(bad)
    more = ["2026-01-02T03:04:05", "2026-01-02", "01/02/2026 03:04:05", "2026/01/02 03:04:05"]
    got = column(more, coerce.parse_timestamp(F.col("s"), coerce.TIMESTAMP_FORMATS))
    assert got == [good, dt.datetime(2026, 1, 2), good, good]


def test_first_value_gives_the_format(spark):
    df = spark.createDataFrame(
        [(2, "2026-01-02 03:04:05"), (1, "2026-01-02T03:04:05"), (0, None)], "n int, s string"
    )
    assert coerce.guess_timestamp_format(df, "s", ["n"]).name == "iso_t"


def test_times_and_hours(spark):
    rows = [
        ("a", "2026-09-19 00:00:00", None), ("b", "2026-09-19 00:00:01", "25"),
        ("c", "bad", "13.5"), ("d", "bad", "x"), ("e", "2026-01-01 22:00:00", "23"),
    ]
    df = spark.createDataFrame(rows, "k string, transaction_timestamp string, transaction_hour string")
    got = {r["k"]: (r["ts_future"], r["ts_invalid"], r["hour"]) for r in clean.clean_times(df).collect()}
    assert got == {
        "a": (False, False, 0.0), "b": (True, True, 0.0), "c": (False, True, 13.5),
        "d": (False, True, None), "e": (False, False, 23.0),
    }


def test_amounts(spark):
    df = spark.createDataFrame([("5",), ("0",), ("-1",), ("x",), ("inf",)], "amount string")
    out = clean.fill_amount(clean.clean_amount(df), 7.0).collect()
    assert [r["amount_invalid"] for r in out] == [False, True, True, True, False]
    assert [r["amount_filled"] for r in out] == [5.0, 7.0, 7.0, 7.0, math.inf]
    assert [r["amount_raw"] for r in out] == ["5", "0", "-1", "x", "inf"]


def test_number_text(column):
    rng = random.Random(5)
    values = [0.0, 1.0, 1e7, 123456789.25, 1e15, 9.5e15, 1e16, 1.5e300, 1e-3, 5e-4, 1e-5, -2.5e-7,
              math.inf, -math.inf, 0.1, 100000.0]
    values += [round(rng.uniform(-1, 1) * 10 ** rng.randint(-4, 12), 3) for _ in range(200)]
    assert column(values, double_text(F.col("s")), "double") == [repr(v) for v in values]
    halves = [0.5, 1.5, 2.5, 1e12 + 0.5, -0.4, 99999.5, None, math.inf]
    expected = ["nan" if v is None else f"{v:.0f}" for v in halves]
    assert column(halves, whole_text(F.col("s")), "double") == [e.replace("-0", "0") for e in expected]


def test_absent_columns(spark):
    df = spark.createDataFrame([("x",)], "other string")
    row = df.select(
        clean.is_high_risk(df).alias("h"), clean.is_kyc_bad(df).alias("k"),
        clean.is_politically_exposed(df).alias("p"),
    ).first()
    assert tuple(row) == (False, True, False)
    out = clean.clean_transactions(df).first()
    assert out["amount_invalid"] and out["ts_invalid"] and out["status_clean"] == "UNKNOWN"


def test_no_trim_on_categories(spark):
    df = spark.createDataFrame(
        [(" VERIFIED", "high"), ("verified", None), (None, "HIGH ")], "kyc_status string, risk_rating string"
    )
    got = [tuple(r) for r in df.select(clean.is_kyc_bad(df), clean.is_high_risk(df)).collect()]
    assert got == [(True, True), (False, False), (True, False)]


def test_numbers_as_a_reader_infers_them(spark):
    df = spark.createDataFrame(
        [("1", "1.0", "5", None, "x", "007"), ("2", "1", None, None, "3", "8")],
        "a string, b string, c string, d string, e string, f string",
    )
    kinds = clean.infer_numbers(df)
    assert kinds == {"a": "bigint", "b": "double", "c": "double", "f": "bigint"}
    got = [tuple(r) for r in clean.as_read(df, kinds).collect()]
    assert got == [(1, 1.0, 5.0, None, "x", 7), (2, 1.0, None, None, "3", 8)]
    assert clean.infer_numbers(df, ["d", "e"]) == {}
