import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from panelwright.operators import stationarity


def plain_kpss(x):
    """From the definition: centred values, Bartlett weights over autocovariances."""
    n, e = len(x), x - x.mean()
    cov = np.array([e[i:] @ e[: n - i] for i in range(stationarity.width_of(n) + 1)])
    lags = stationarity.bandwidth(n, cov)
    long_run = e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[: n - i]) for i in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / n / long_run), lags


def plain_adf(x):
    """A least-squares fit for every lag order, on the values as they are."""
    most, dx = stationarity.orders_of(len(x)), np.diff(x)

    def fitted(lags, start):
        y = dx[start:]
        a = np.column_stack([x[start:-1], *(dx[start - i : len(dx) - i] for i in range(1, lags + 1)), np.ones(len(y))])
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        rss = ((y - a @ beta) ** 2).sum()
        se = np.sqrt(rss / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])
        return beta[0] / se, len(y) * np.log(rss / len(y)) + 2 * a.shape[1]

    best = min(range(most + 1), key=lambda k: fitted(k, most)[1])
    return fitted(best, best)[0], best


def test_adf_p_values_at_published_critical_values():
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert stationarity.adf_p(t) == pytest.approx(p, abs=0.002)
    assert stationarity.adf_p(-20) == 0 and stationarity.adf_p(3) == 1


def test_stationarity(spark):
    rng = np.random.default_rng(3)
    noise, walk = rng.normal(size=400), np.cumsum(rng.normal(size=400))
    rows = [("A", i, float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(noise, walk))] + [("B", i, float(i), None, 1.0) for i in range(10)]
    got = stationarity.panel(spark.createDataFrame(rows, "ticker string, t int, noise double, walk double, flat double"), ("noise", "walk", "flat"), order="t")
    by = {(r.ticker, r.feature): r.verdict for r in got.collect()}
    assert by == {("A", "noise"): "stationary", ("A", "walk"): "non-stationary"}


def drawn_series(seed, n):
    rng = np.random.default_rng(seed)
    u = rng.normal(size=n)
    pulled = np.zeros(n)
    for i in range(2, n):
        pulled[i] = 0.5 * pulled[i - 1] - 0.3 * pulled[i - 2] + u[i]
    return {"noise": u, "walk": 50 + np.cumsum(u), "pulled": pulled + 1e3, "drift": np.arange(n) * 0.1 + rng.normal(size=n)}


@pytest.mark.parametrize("block", (64, 1 << 16))
def test_sums_of_blocks_give_the_plain_tests(spark, block):
    series = {("A", c): x for c, x in drawn_series(1, 700).items()} | {("B", c): x for c, x in drawn_series(2, 20).items()} | {(None, c): x for c, x in drawn_series(3, 128).items()}
    rows = [(t, i, *(float(series[t, c][i]) for c in ("noise", "walk", "pulled", "drift"))) for t, n in (("A", 700), ("B", 20), (None, 128)) for i in range(n)]
    rows += [("A", 1000, float("nan"), float("inf"), None, None), ("C", 1, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "ticker string, t int, noise double, walk double, pulled double, drift double")
    got = {(r.ticker, r.feature): r for r in stationarity.panel(df.repartition(3), ("noise", "walk", "pulled", "drift"), order="t", block=block).collect()}
    assert set(got) == set(series)
    for key, x in series.items():
        r, (k, klags), (t, lags) = got[key], plain_kpss(x), plain_adf(x)
        assert (r.n_obs, r.kpss_lags, r.adf_lags) == (len(x), klags, lags)
        assert r.kpss == pytest.approx(k, rel=1e-9) and r.adf == pytest.approx(t, rel=1e-6) and r.adf_p == pytest.approx(stationarity.adf_p(t))
        assert r.kpss_p == pytest.approx(np.interp(k, [c for c, _ in stationarity.KPSS_TABLE], [p for _, p in stationarity.KPSS_TABLE]))


def test_long_series_are_thinned_only_on_demand(spark):
    x = np.cumsum(np.random.default_rng(7).normal(size=3000))
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate(x)], "ticker string, t int, x double")
    for most, kept in ((1000, x[::3]), (None, x), (5000, x)):
        r = stationarity.panel(df, ("x",), order="t", most=most, block=512).first()
        assert r.n_obs == len(kept) and (r.kpss, r.kpss_lags) == pytest.approx(plain_kpss(kept)) and (r.adf, r.adf_lags) == pytest.approx(plain_adf(kept), rel=1e-6)
        s = stationarity.kpss_panel(df, ("x",), order="t", most=most, block=512).first()
        assert (s.kpss, s.kpss_p, s.kpss_lags) == pytest.approx((r.kpss, r.kpss_p, r.kpss_lags))


def test_series_without_noise(spark):
    """A line is fitted whole; equal values and empty tables give no row."""
    df = spark.createDataFrame([("A", i, float(i), 2.0, float(i % 2)) for i in range(60)], "ticker string, t int, line double, flat double, flips double")
    got = {r.feature: r for r in stationarity.panel(df, ("line", "flat", "flips"), order="t").collect()}
    assert set(got) == {"line", "flips"} and got["line"].adf_p > 0.05 and got["flips"].adf_p == 0
    assert stationarity.panel(df.limit(0), ("line",), order="t").count() == 0


def test_kpss_agrees_with_sql(spark, sf):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()["kpss_tests"]).df().sort_values(["ticker", "feature"]).reset_index(drop=True)
    got = entry.queries()["kpss_tests"](spark, sf).toPandas().sort_values(["ticker", "feature"]).reset_index(drop=True)
    assert len(got) > 20 and (got[["ticker", "feature", "n_obs", "kpss_lags", "kpss_stationary"]] == want[["ticker", "feature", "n_obs", "kpss_lags", "kpss_stationary"]]).all(axis=None)
    assert np.allclose(got[["kpss", "kpss_p"]], want[["kpss", "kpss_p"]], atol=2e-6)
