import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import ledger

SCHEMA = "ticker string, window_id int, i int, date date, close double, pred string, target string"


def make(spark, windows):
    rows, day = [], dt.date(2020, 1, 1)
    for (t, w), (closes, preds) in windows.items():
        rows += [(t, w, i, day + dt.timedelta(days=100 * w + i), float(c), {"B": "Buy", "H": "Hold", "A": "Avoid"}[p], "Buy") for i, (c, p) in enumerate(zip(closes, preds))]
    return spark.createDataFrame(rows, SCHEMA)


def walked(closes, preds, cost, model):
    """The same ledger, one decision after another."""
    n, i, points, trades, half = len(closes), 0, [], [], False
    while i < n:
        at, r = i, 0.0
        if preds[i] == "B":
            out = next((j for j in range(i + 1, n) if preds[j] != "B"), n - 1)
            r = (closes[out] - closes[i]) / closes[i] - 2 * cost
            trades.append((i, out, r))
            i = out + 1
        else:
            if preds[i] == "H" and i + 1 < n:
                r = (closes[i + 1] - closes[i]) / closes[i]
                if model == "per_day":
                    r -= 2 * cost
                else:
                    stays = i + 2 < n and preds[i + 1] == "H"
                    r -= cost * ((not half) + (not stays))
                    half = stays
                r *= 0.5
            i += 1
        points.append((at, r))
    return points, trades


@pytest.mark.parametrize("model", ledger.COST_MODELS)
def test_random_windows_agree_with_the_walk(spark, model):
    rng = np.random.default_rng(7)
    windows = {}
    for k in range(60):
        n = int(rng.integers(1, 14))
        windows[(f"t{k % 5}", k // 5)] = (rng.uniform(50, 150, n).tolist(), "".join(rng.choice(list("BHA"), n)))
    windows[("t0", 90)], windows[("t0", 91)], windows[("t0", 92)] = ([1, 2, 3], "HHH"), ([1, 2, 3], "AAA"), ([3, 2], "AB")
    s = make(spark, windows)
    got = ledger.points(s, 0.001, model).toPandas()
    sold = ledger.trades(s, 0.001).toPandas()
    for (t, w), (closes, preds) in windows.items():
        points, trades = walked(closes, preds, 0.001, model)
        mine = got[(got.ticker == t) & (got.window_id == w)].sort_values("i")
        assert mine.i.tolist() == [i for i, _ in points]
        np.testing.assert_allclose(mine.r, [r for _, r in points], atol=1e-12)
        mine = sold[(sold.ticker == t) & (sold.window_id == w)].sort_values("entry_i")
        assert list(zip(mine.entry_i, mine.exit_i)) == [(a, b) for a, b, _ in trades]
        np.testing.assert_allclose(mine.net_return, [r for *_, r in trades], atol=1e-12)
    curve = ledger.equity(ledger.points(s, 0.001, model)).toPandas()
    for t in ("t0", "t3"):
        value = 10_000 * np.cumprod([1 + r for (a, w), x in sorted(windows.items()) if a == t for _, r in walked(*x, 0.001, model)[0]])
        np.testing.assert_allclose(curve[curve.ticker == t].sort_values("seq").value, value, rtol=1e-12)


def test_free_trading_makes_the_cost_models_equal(spark):
    s = make(spark, {("A", 0): ([1, 2, 1.5, 3, 2, 2.5], "HHBHAH")})
    assert ledger.points(s, 0.0, "per_day").exceptAll(ledger.points(s, 0.0)).isEmpty()


def test_total_loss_keeps_the_curve_defined(spark):
    s = make(spark, {("A", 0): ([1, 0, 1], "BAA")})
    assert ledger.equity(ledger.points(s, 0.001)).orderBy("seq").collect()[0].value == pytest.approx(-20.0)


def test_metrics(spark):
    s = make(spark, {("A", 0): ([100, 110, 105, 120], "BHAH"), ("A", 1): ([100, 90], "BA")})
    m = ledger.metrics(s, 0.0).first()
    assert m.n_trades == 2 and m.n_wins == 1 and m.win_rate == 0.5
    assert m.total_return == pytest.approx(1.1 * 0.9 - 1) and m.benchmark_return == pytest.approx(1.2 * 0.9 - 1)
    assert m.accuracy == pytest.approx(2 / 6) and m.max_drawdown == pytest.approx(-10)
    w = ledger.window_results(s, 0.0).orderBy("window_id").toPandas()
    assert w.n_trades.tolist() == [1, 1] and w.n_wins.tolist() == [1, 0]
    assert ledger.summary(ledger.metrics(s, 0.0)).first().pooled_win_rate == 0.5


def test_entry_odds(spark):
    s = make(spark, {("A", 0): ([1, 2, 3, 2, 4], "BBAAA"), ("B", 0): ([1, 2], "AB")})
    got = {r.ticker: r.win_odds for r in ledger.random_entry_odds(s, ledger.trades(s, 0.0), 0.0).collect()}
    assert got == {"A": pytest.approx(2 / 3), "B": 0.0}


def test_mean_curve_carries_short_ones_on(spark):
    c = spark.createDataFrame([("A", 1, 100.0), ("A", 2, 110.0), ("A", 3, 120.0), ("B", 1, 50.0), ("B", 2, 40.0)], "ticker string, seq int, value double")
    got = ledger.mean_curve(c).orderBy("seq").toPandas()
    np.testing.assert_allclose(got.pct, [0, -5, 0], atol=1e-12)


def test_config():
    for bad in (("monthly", 0.1, 1, 1, 1), ("per_day", -1, 1, 1, 1), ("per_day", 0, 0, 1, 1)):
        with pytest.raises(ValueError):
            ledger.check_config(*bad)


def test_no_signals(spark):
    s = make(spark, {("A", 0): ([1.0], "A")}).where(F.lit(False))
    assert ledger.metrics(s).count() == 0 and isinstance(ledger.points(s).toPandas(), pd.DataFrame)
