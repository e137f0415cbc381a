import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import splits


def panel(spark, n_dates, tickers=("A", "B")):
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=n_dates)]
    return spark.createDataFrame([(t, d, ["Buy", "Hold", "Avoid"][i % 3]) for t in tickers for i, d in enumerate(days)], "ticker string, date date, target string"), days


@pytest.mark.parametrize("n,size,horizon", [(100, 0.2, 10), (50, 0.25, 0), (37, 0.5, 5)])
def test_purged_split_leaves_a_gap(spark, n, size, horizon):
    df, days = panel(spark, n)
    out, meta = splits.purged_split(df, size, horizon)
    by = {s: sorted(g.date.unique()) for s, g in out.toPandas().groupby("side")}
    at = min(max(round(n * (1 - size)), 1), n - 1)
    assert by["test"] == days[at:] and by["train"] == days[: at - horizon]
    row = meta.first()
    assert row.split_date == days[at] and row.n_purged == 2 * horizon


def test_purged_split_errors(spark):
    df, _ = panel(spark, 20)
    for size, horizon in ((0, 1), (1, 1), (0.2, -1), (0.2, 16), (0.2, 99)):
        with pytest.raises(ValueError):
            splits.purged_split(df, size, horizon)
    with pytest.raises(ValueError):
        splits.purged_split(panel(spark, 1)[0])


def test_row_cut_split_counts_rows(spark):
    df, days = panel(spark, 100, ("A", "B", "C"))
    out = splits.row_cut_split(df, 0.8, 20).toPandas()
    rows = df.toPandas().sort_values(["date", "ticker"]).reset_index(drop=True)
    cut = rows.date[240]
    assert (out.side == "test").sum() == 60
    assert out[out.side == "train"].date.max() < cut - pd.Timedelta(days=20)


def test_stratified_split_keeps_shares(spark):
    df, _ = panel(spark, 300)
    got = splits.stratified_split(df).groupBy("target", "side").count().toPandas().pivot(index="target", columns="side", values="count")
    assert (got.train == 160).all() and (got.test == 40).all()
    a, b = splits.stratified_split(df), splits.stratified_split(df.repartition(5))
    assert a.exceptAll(b).isEmpty()


@pytest.mark.parametrize("train,test,step", [(10, 5, 5), (10, 5, 3), (7, 4, 9)])
def test_walk_forward_is_the_window_loop(spark, train, test, step):
    df, days = panel(spark, 40, ("A",))
    got = splits.walk_forward(df, train, test, step).toPandas()
    want, w, s = set(), 0, 0
    while s + train + test <= 40:
        want |= {(w, "train", i, days[s + i]) for i in range(train)} | {(w, "test", i, days[s + train + i]) for i in range(test)}
        w, s = w + 1, s + step
    assert set(zip(got.window_id, got.side, got.i, got.date)) == want and len(got) == len(want)
    assert splits.walk_forward(df, 30, 11, 5).count() == 0
    assert splits.walk_forward(df, train, test, step, purge_rows=2).where("side = 'train'").groupBy("window_id").count().agg(F.max("count")).first()[0] == train - 2


def test_regimes_and_validation(spark):
    df, days = panel(spark, 200)
    r = spark.createDataFrame([("late", days[150], days[199]), ("early", days[0], days[10])], "regime string, start date, end date")
    out = splits.regime_split(df, r, 10, 100, 50).toPandas()
    assert set(out.regime) == {"late"} and (out[out.side == "train"].date < days[150] - pd.Timedelta(days=10)).all() and (out.side == "test").sum() == 100
    got = splits.trailing_validation(df).groupBy("ticker", "side").count().toPandas()
    assert set(got[got.side == "validation"]["count"]) == {30}
