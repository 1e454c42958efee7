from datetime import date

from pyspark.sql import functions as F

from evtide.operators import merge as M

ROWS = "k int, i int, v string, flag boolean, d date, p string, day date, n string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def one(df, column):
    return {r.k: r.x for r in df.groupBy("k").agg(column.alias("x")).collect()}


def test_majority_ties_go_to_the_first_met(spark):
    df = frame(spark, [(1, 2, "b", None, None, None, None, None), (1, 1, "a", None, None, None, None, None), (1, 3, "unknown", None, None, None, None, None), (1, 4, "unknown", None, None, None, None, None), (2, 1, "", None, None, None, None, None), (2, 2, None, None, None, None, None, None)])
    assert {r.k: r.v for r in M.majority(df, "k", "v", F.col("i")).collect()} == {1: "a", 2: None}


def test_latest_longest_any(spark):
    early, late = date(2020, 1, 1), date(2021, 1, 1)
    df = frame(spark, [(1, 1, "old", False, None, None, early, None), (1, 2, "new", None, None, None, late, None), (1, 3, "neu", None, None, None, late, None), (1, 4, "undated!", None, None, None, None, None), (2, 1, None, None, None, None, None, None), (3, 1, "x", True, None, None, None, None)])
    assert one(df, M.latest(F.col("v"), F.col("day"), F.col("i"))) == {1: "new", 2: None, 3: "x"}
    assert one(df, M.longest(F.col("v"), F.col("day"), F.col("i"))) == {1: "undated!", 2: None, 3: "x"}
    assert one(df, M.any_true(F.col("flag"))) == {1: False, 2: None, 3: True}


def test_best_date(spark):
    a, b, c = date(2020, 1, 1), date(2020, 2, 1), date(2020, 3, 1)
    df = frame(spark, [(1, 1, None, None, a, "month", a, None), (1, 2, None, None, b, "day", c, None), (1, 3, None, None, c, "day", b, None), (1, 4, None, None, a, "day", None, None), (2, 1, None, None, a, "year", None, None), (2, 2, None, None, b, "approximate", None, None), (3, 1, None, None, None, "day", a, None)])
    assert one(df, M.best_date(F.col("d"), F.col("p"), F.col("day"), F.col("i"))) == {1: c, 2: b, 3: None}


def test_company_list_fills_gaps(spark):
    df = spark.createDataFrame([("e", 1, "n", None, "US"), ("e", 2, "n", "T", "GB"), ("e", 3, "", "Z", "Z"), ("e", 4, None, "Z", "Z"), ("e", 5, "m", "", None)], "e string, i int, name string, ticker string, country string")
    got = {r.name: (r.ticker, r.country) for r in M.company_list(df, "e", "name", ["ticker", "country"], F.col("i")).collect()}
    assert got == {"n": ("T", "US"), "m": (None, None)}
