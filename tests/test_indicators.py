import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright.operators import indicators as ind

SCHEMA = "ticker string, date date, close double, volume bigint"
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, series: dict[str, list], start="2020-01-01"):
    rows = []
    for ticker, values in series.items():
        days = pd.bdate_range(start, periods=len(values))
        rows += [(ticker, d.date(), None if v is None else float(v), 1000 + i) for i, (d, v) in enumerate(zip(days, values))]
    return spark.createDataFrame(rows, SCHEMA)


def walk(n, seed=0, start=100.0):
    return (start * np.exp(np.cumsum(np.random.default_rng(seed).normal(0.0005, 0.015, n)))).tolist()


def expected(values):
    c = pd.Series(values, dtype=float)
    d = c.diff()
    gain, loss = d.clip(lower=0).fillna(0.0), (-d).clip(lower=0).fillna(0.0)
    g, l = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (gain, loss))
    out = pd.DataFrame({"daily_return": c.pct_change(), "ma_5": c.rolling(5).mean(), "ma_20": c.rolling(20).mean(), "ma_50": c.rolling(50).mean()})
    out["volatility"] = out["daily_return"].rolling(20).std()
    out["rsi"] = 100 - 100 / (1 + g / l)
    out["macd"] = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    return out


def test_all_indicators_agree_with_pandas(spark):
    series = {"A": walk(300, 1), "B": walk(120, 2)}
    got = ind.indicators(frame(spark, series)).toPandas().sort_values(["ticker", "date"])
    for t, values in series.items():
        mine, want = got[got.ticker == t].reset_index(drop=True), expected(values)
        for c in want.columns:
            a, b = mine[c].astype(float).to_numpy(), want[c].to_numpy()
            assert (np.isnan(a) == np.isnan(b)).all(), c
            np.testing.assert_allclose(a[~np.isnan(a)], b[~np.isnan(b)], rtol=1e-9, atol=1e-10, err_msg=c)


def test_long_series_do_not_overflow(spark):
    values = walk(6000, 3)
    df = ind.with_ema(ind.with_row_number(frame(spark, {"A": values}, "1995-01-02")), {"e": ("close", 2 / 13), "w": ("close", 1 / 14), "slow": ("close", 1 / 900)})
    got = df.orderBy("date").toPandas()
    for c, a in (("e", 2 / 13), ("w", 1 / 14), ("slow", 1 / 900)):
        np.testing.assert_allclose(got[c], pd.Series(values).ewm(alpha=a, adjust=False).mean(), rtol=1e-10)


@SLOW
@given(values=st.lists(st.floats(1, 10_000), min_size=80, max_size=120))
def test_property_features_have_no_nulls(spark, values):
    got = ind.features(frame(spark, {"A": values})).toPandas()
    assert not got[list(ind.FEATURES)].isna().any().any()
    assert ((got.rsi >= 0) & (got.rsi <= 100)).all()


def test_edges_of_history(spark):
    df = frame(spark, {"short": walk(79), "just": walk(80, 5)})
    assert ind.features(df).groupBy("ticker").count().collect() == [("just", 31)]
    assert ind.labelled(df).count() == 1
    gate = {r.ticker: (r.kept, r.reason) for r in ind.history_gate(df, 80).collect()}
    assert gate == {"just": (True, None), "short": (False, "79 rows, needs 80")}


def test_rsi_of_rising_falling_and_flat_series(spark):
    got = ind.indicators(frame(spark, {"up": range(1, 90), "down": range(200, 100, -1), "flat": [5] * 90})).where("rn = 60").toPandas().set_index("ticker")
    assert got.rsi["up"] == 100 and got.rsi["down"] == pytest.approx(0) and np.isnan(got.rsi["flat"])
    assert got.volatility["flat"] == 0


def test_label_boundaries(spark):
    df = spark.createDataFrame([(0.1,), (0.1000001,), (0.0,), (-1e-9,), (None,)], "r double").select(ind.label(F.col("r")).alias("l"))
    assert [r.l for r in df.collect()] == ["Hold", "Buy", "Hold", "Avoid", None]
    with pytest.raises(ValueError):
        ind.label(F.lit(0.1), 0)


def test_zero_previous_close_is_undefined(spark):
    got = frame(spark, {"A": [0, 5, 6]}).select("date", ind.daily_return(F.col("close")).alias("r")).orderBy("date").collect()
    assert [r.r for r in got] == [None, None, pytest.approx(0.2)]


def test_sequences_stay_within_a_ticker(spark):
    df = frame(spark, {"A": range(10), "B": range(100, 103)}).withColumn("x", F.col("close"))
    got = ind.sequences(df, 4, ("x",)).toPandas()
    assert len(got) == 7 and set(got.ticker) == {"A"}
    assert [w["x"] for w in got.sort_values("date").window.iloc[0]] == [0, 1, 2, 3]


def test_history_and_change(spark):
    got = {r.ticker: r for r in ind.history(frame(spark, {"A": range(1, 101), "B": range(1, 11)})).collect()}
    assert got["A"].price_change_30d == pytest.approx((100 - 79) / 79 * 100) and len(got["A"].prices) == 90 and got["A"].prices[-1] == 100
    assert got["B"].price_change_30d == 0 and len(got["B"].dates) == 10


def test_rebased_and_drawdown(spark):
    df = ind.drawdown(ind.rebased(frame(spark, {"A": [50, 60, 30, 45]})), "rebased", points=True).orderBy("date").toPandas()
    assert df.rebased.tolist() == [100, 120, 60, 90] and df.drawdown.tolist() == [0, 0, -60, -30]
    assert ind.drawdown(frame(spark, {"A": [50, 60, 30, 45]})).agg(F.min("drawdown")).first()[0] == -0.5


def test_one_exchange_serves_all_indicators(spark):
    plan = ind.indicators(frame(spark, {"A": walk(100)}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_empty_panel(spark):
    assert ind.labelled(frame(spark, {"A": [1.0]}).where("false")).count() == 0


def test_latest(spark):
    got = ind.latest(frame(spark, {"A": [1, 2], "B": [3]})).toPandas().set_index("ticker")
    assert got.close.to_dict() == {"A": 2, "B": 3} and isinstance(got.date["A"], dt.date)
