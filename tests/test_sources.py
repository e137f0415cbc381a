import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.functions.columns import finite, has_word
from panelwright.sources import prices, tables


def rows(spark, *tickers):
    return spark.createDataFrame([(t, dt.date(2020, 1, d), 1.0, 2.0, 0.5, float(d), None, 10) for t in tickers for d in (1, 2, 3)], prices.SCHEMA)


JAN, FEB, MAR = dt.date(2020, 1, 1), dt.date(2020, 2, 1), dt.date(2020, 3, 1)


def days(spark, close, *pairs):
    return spark.createDataFrame([(t, d, 1.0, 2.0, 0.5, float(close), None, 10) for t, d in pairs], prices.SCHEMA)


def closes(df):
    return sorted((r.ticker, r.date.month, r.date.day, r.close) for r in df.collect())


def test_snapshot_round_trip(spark, tmp_path):
    path = str(tmp_path / "p")
    assert prices.read(spark, path).count() == 0
    assert prices.write(rows(spark, "A", "B"), path, JAN, FEB) == 6
    assert prices.write(rows(spark, "B", "C").withColumn("close", F.lit(9.0)), path, JAN, FEB) == 3  # B is there
    assert prices.read(spark, path).where("ticker = 'B'").agg(F.max("close")).first()[0] == 3
    assert prices.write(rows(spark, "B").withColumn("close", F.lit(9.0)), path, JAN, FEB, refresh=True) == 3
    assert prices.read(spark, path).where("ticker = 'B'").agg(F.max("close")).first()[0] == 9
    assert prices.write(rows(spark, "A").where("false"), path, JAN, FEB, refresh=True) == 0
    assert prices.read(spark, path, JAN, dt.date(2020, 1, 3), ["A"]).count() == 2
    plan = prices.read(spark, path, dt.date(2020, 1, 2), None, ["A"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(date" in plan
    with pytest.raises(ValueError):
        prices.write(rows(spark, "A"), path, FEB, JAN)


def test_periods_are_stored_and_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "p")
    year = days(spark, 1, ("A", dt.date(2020, 1, 5)), ("A", dt.date(2020, 2, 5)), ("B", dt.date(2020, 1, 6)))
    assert prices.write(year, path, JAN, FEB) == 2
    assert prices.write(year, path, FEB, MAR) == 1  # another period of a known ticker
    assert closes(prices.read(spark, path)) == [("A", 1, 5, 1), ("A", 2, 5, 1), ("B", 1, 6, 1)]
    twice = year.withColumn("close", F.lit(2.0))
    assert prices.write(twice, path, JAN, FEB) == 0
    assert prices.write(twice.where("ticker = 'A'"), path, FEB, MAR, refresh=True) == 1
    assert closes(prices.read(spark, path)) == [("A", 1, 5, 1), ("A", 2, 5, 2), ("B", 1, 6, 1)]
    assert prices.write(days(spark, 3, ("A", dt.date(2020, 1, 7))), path, JAN, MAR) == 1  # overlaps both: its days are those of A from now on
    assert closes(prices.read(spark, path)) == [("A", 1, 7, 3), ("B", 1, 6, 1)]
    assert closes(prices.read(spark, path, JAN, FEB, exact=True)) == [("A", 1, 5, 1), ("B", 1, 6, 1)]
    live = {(r.ticker, r.start, r.end): r.n_rows for r in prices.stored(spark, path).collect()}
    assert live == {("A", JAN, FEB): 1, ("B", JAN, FEB): 1, ("A", FEB, MAR): 1, ("A", JAN, MAR): 1}
    assert prices.compact(spark, path) >= 1 and closes(prices.read(spark, path)) == [("A", 1, 7, 3), ("B", 1, 6, 1)]


def test_two_writers_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "p")
    with ThreadPoolExecutor(2) as both:
        got = list(both.map(lambda t: prices.write(rows(spark, t), path, JAN, FEB), ("A", "B")))
    assert got == [3, 3] and prices.read(spark, path).count() == 6
    (tmp_path / "p" / "manifest" / "broken").mkdir()  # a commit that was not finished
    assert prices.read(spark, path).count() == 6


def test_checks(spark):
    df = rows(spark, "A")
    assert prices.require(df).columns == list(prices.REQUIRED)
    with pytest.raises(ValueError, match="close, volume"):
        prices.require(df.drop("close", "volume"))
    gaps = df.withColumn("close", F.when(F.col("close") > 1, F.col("close")))
    assert prices.drop_null_prices(gaps).count() == 2
    assert prices.null_report(gaps).first().asDict() == {"ticker": "A", "rows_before": 3, "rows_after": 2, "dropped": 1}


def test_normalised(spark):
    df = spark.createDataFrame([(1.0, 0.5), (2.0, None), (3.0, float("nan"))], "Close double, `Adj Close` double")
    assert [r.close_price for r in prices.normalised(df).collect()] == [0.5, 2.0, 3.0]
    assert prices.normalised(df.drop("Adj Close")).first().adj_close == 1.0


def test_profiles_and_lookup(spark, tmp_path):
    df = spark.createDataFrame([(1, 30, 1.5, 2, 3, 4), (2, None, None, None, None, None)], tables.PROFILE_SCHEMA)
    tables.write_profiles(df, str(tmp_path / "c"))
    assert tables.read_profiles(spark, str(tmp_path / "c")).exceptAll(df).isEmpty()
    s = spark.createDataFrame([("Ab", "s1", 2), ("C", "s1", 1)], "ticker string, sector string, position int")
    assert tables.sectors(s).first().tickers == ["C", "Ab"]
    got = {r.asked: r.found for r in tables.lookup(spark.createDataFrame([("aB",), ("x",)], "asked string"), s, "asked").collect()}
    assert got == {"aB": True, "x": False}


def test_columns(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), ("Infinity",)], "v string")
    assert [r[0] for r in df.select(finite(F.expr("try_cast(v as double)"))).collect()] == [1.5, 0, 0, 0, 0]
    t = spark.createDataFrame([("Brand#1, ok",), ("brand#10",), ("Brand#1",)], "t string")
    assert [r[0] for r in t.select(has_word(F.col("t"), F.lit("brand#1"))).collect()] == [True, False, True]


def test_universes(spark):
    from panelwright.operators import text
    from panelwright.sources import dims

    u, x = dims.universe(spark), dims.extended(spark)
    assert u.count() == u.select("ticker").distinct().count() == 20 and x.count() == x.select("ticker").distinct().count() == 100
    assert {r.sector: r.tickers for r in tables.sectors(u).collect()}["Healthcare"] == ["JNJ", "UNH"]
    m = spark.createDataFrame([(1, "How much is Coca-Cola worth?"), (2, "amd or micron"), (3, "advanced technology")], "message_id int, text string")
    assert {r.message_id: r.tickers for r in text.mentions(m, u).collect()} == {1: ["KO"], 2: ["AMD", "MU"], 3: []}
