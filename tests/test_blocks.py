import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import blocks
from panelwright.operators import indicators as ind


def panel(spark, lengths):
    rng = np.random.default_rng(3)
    rows = []
    for name, n in lengths.items():
        day = dt.date(2000, 1, 1)
        for c in 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))):
            rows.append((name, day, float(c), int(rng.integers(1, 99))))
            day += dt.timedelta(days=int(rng.choice([1, 1, 1, 3, 40])))  # uneven
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume long")


def same(a, b, key=("ticker", "date")):
    a, b = ({tuple(r[k] for k in key): r.asDict() for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and a
    for k in a:
        for c in a[k]:
            if isinstance(a[k][c], float):
                assert b[k][c] == pytest.approx(a[k][c], rel=1e-9, abs=1e-9), (k, c)
            else:
                assert a[k][c] == b[k][c], (k, c)


@pytest.mark.parametrize("block", [50, 97, 4096])
def test_blocks_give_what_windows_give(spark, block):
    p = panel(spark, {"A": 700, "B": 81, "C": 79, "D": 1})
    same(ind.indicators(p), ind.indicators(p, block))
    same(ind.labelled(p), ind.labelled(p, block=block))


def test_sequences_and_peaks(spark):
    p = ind.labelled(panel(spark, {"A": 400, "B": 100}))
    same(ind.sequences(p, 20).select("ticker", "date", "rn", F.to_json("window").alias("w")), ind.sequences(p, 20, block=23).select("ticker", "date", F.col("rn").cast("int").alias("rn"), F.to_json("window").alias("w")))
    for points in (False, True):
        same(ind.drawdown(p, points=points), ind.drawdown(p, points=points, block=40).withColumn("rn", F.col("rn").cast("int")))


def test_row_numbers_of_uneven_numbers(spark):
    x = sorted(set(np.random.default_rng(0).lognormal(0, 3, 500).tolist()))
    df = spark.createDataFrame([("A", v) for v in x] + [(None, 2.0), (None, 1.0), ("B", 7.0)], "ticker string, at double")
    got = blocks.numbered(df, order="at", rows=32).collect()
    assert [r.rn for r in sorted((r for r in got if r.ticker == "A"), key=lambda r: r.at)] == list(range(len(x)))
    assert {(r.ticker, r.at): (r.rn, r.n_rows) for r in got if r.ticker != "A"} == {(None, 1.0): (0, 2), (None, 2.0): (1, 2), ("B", 7.0): (0, 1)}
    with pytest.raises(ValueError):
        blocks.cut(df, 40, order="at", rows=32)
    assert blocks.cut(df.where("false"), 3, order="at", rows=32).count() == 0


def test_one_long_series_runs_in_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("A").alias("ticker"), F.col("id").alias("at"), F.expr("cast(pmod(hash(id), 1000) as double)").alias("x"))
    got = blocks.own(blocks.cut(df, 19, order="at", rows=4096).withColumn("m", ind.moving_average(F.col("x"), 20, ind.BLOCKED, "at")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # 200,000 rows would do in one task
    try:
        per = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) >= 4 and max(r["count"] for r in per) < 120_000 and sum(r["count"] for r in per) == 200_000


@pytest.mark.parametrize("block", [None, 5000])
def test_averages_of_any_alpha(spark, block):
    n = 100_000
    x = np.random.default_rng(1).normal(50, 10, n)
    alphas = {"a": 0.001, "b": 0.00001, "c": 0.6, "d": 1.0, "e": 0.999, "f": 2 / 13}
    want = {}
    for name, a in alphas.items():
        y, out = x[0], np.empty(n)
        for i, v in enumerate(x):
            y = (1 - a) * y + a * v
            out[i] = y
        want[name] = out
    df = spark.createDataFrame(__import__("pandas").DataFrame({"ticker": "A", "at": np.arange(n), "x": x}))
    df = blocks.cut(df, 0, order="at", rows=block) if block else ind.with_row_number(df, order="at")
    got = ind.with_ema(df, {k: ("x", a) for k, a in alphas.items()}, order="at", block=block).orderBy("at").toPandas()
    for name in alphas:
        assert np.abs(got[name].to_numpy() - want[name]).max() < 1e-8, name
    with pytest.raises(ValueError):
        ind.with_ema(df, {"z": ("x", 0.0)}, order="at")
