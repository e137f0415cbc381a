import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import draws, tails
from panelwright.operators import metrics, stats
from panelwright.plans import queries


@pytest.mark.parametrize(
    "value,want",
    [
        (tails.t_two_sided(2.228, 10), 0.05), (tails.t_two_sided(12.706, 1), 0.05), (tails.chi2_sf(3.841, 1), 0.05), (tails.chi2_sf(18.307, 10), 0.05), (tails.f_sf(3.490, 3, 12), 0.05), (tails.f_sf(4.965, 1, 10), 0.05),
        (tails.studentized_range_sf(3.877, 3, 10), 0.05), (tails.studentized_range_sf(3.314, 3, 1e6), 0.05), (tails.studentized_range_sf(2.829, 2, 60), 0.05), (tails.normal_sf(1.959964), 0.025), (tails.binomial_test(9, 13), 0.266845703125), (tails.binomial_test(10, 10, 0.5, "greater"), 2**-10), (tails.binomial_test(3, 10, 0.5, "less"), 0.171875),
    ],
)
def test_tails_agree_with_tables(value, want):
    assert value == pytest.approx(want, rel=2e-3)


def test_quantile_inverts():
    for p in (0.025, 0.5, 0.975):
        assert 1 - tails.f_sf(tails.f_quantile(p, 5, 17), 5, 17) == pytest.approx(p, abs=1e-9)


def test_wilson_golden_value(spark):
    r = spark.createDataFrame([(9, 13), (0, 5), (5, 5), (1, 0), (6, 5)], "k int, n int").select(stats.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert (r[0].w.lower, r[0].w.upper) == (pytest.approx(0.4237, abs=1e-3), pytest.approx(0.8732, abs=1e-3))
    assert r[1].w.lower == 0 and r[2].w.upper == 1 and r[3].w is None and r[4].w is None


def test_mcnemar(spark):
    def table(only_a, only_b, both=5):
        rows, k = [], 0
        for n, a, b in ((only_a, "x", "y"), (only_b, "y", "x"), (both, "x", "x")):
            for _ in range(n):
                rows += [("a", k, "x", a), ("b", k, "x", b)]
                k += 1
        return stats.mcnemar(spark.createDataFrame(rows, "model string, row_id bigint, y_true string, y_pred string")).first()

    assert table(0, 0).p_value == 1 and table(0, 0).leader is None
    assert table(20, 4).p_value == pytest.approx(tails.binomial_test(4, 24)) and table(20, 4).leader == "a"
    assert table(5, 20).statistic == pytest.approx(14**2 / 25) and table(5, 20).p_value == pytest.approx(tails.chi2_sf(14**2 / 25, 1))


def groups(spark):
    rng = np.random.default_rng(0)
    data = {g: rng.normal(m, 1, n).round(1) for g, m, n in (("a", 0, 20), ("b", 0.5, 25), ("c", 1.5, 15))}
    return data, spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs], "g string, x double")


def test_anova_kruskal_tukey(spark):
    data, df = groups(spark)
    xs = list(data.values())
    every = np.concatenate(xs)
    between = sum(len(x) * (x.mean() - every.mean()) ** 2 for x in xs) / 2
    within = sum(((x - x.mean()) ** 2).sum() for x in xs) / (60 - 3)
    a = stats.anova(df, "g", "x").first()
    assert a.f == pytest.approx(between / within) and 0 < a.p_value < 0.01
    order = np.argsort(every, kind="stable")
    ranks = np.empty(60)
    for v in np.unique(every):
        at = np.flatnonzero(every[order] == v)
        ranks[order[at]] = at.mean() + 1
    parts = np.split(ranks, np.cumsum([len(x) for x in xs])[:-1])
    h = 12 / (60 * 61) * sum(p.sum() ** 2 / len(p) for p in parts) - 3 * 61
    t = np.unique(every, return_counts=True)[1].astype(float)
    k = stats.kruskal(df, "g", "x").first()
    assert k.h == pytest.approx(h / (1 - (t**3 - t).sum() / (60**3 - 60)))
    q = {(r.a, r.b): r for r in stats.tukey(df, "g", "x").collect()}
    assert q[("a", "c")].q == pytest.approx(abs(xs[0].mean() - xs[2].mean()) / math.sqrt(within / 2 * (1 / 20 + 1 / 15))) and q[("a", "c")].p_value < 0.01
    small = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, x double")
    assert stats.anova(small, "g", "x").first().f is None
    tied = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, x double")
    assert stats.kruskal(tied, "g", "x").first().h is None


def test_t_and_sharpe(spark):
    x = np.random.default_rng(1).normal(0.1, 1, 50)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", float("nan")), ("b", 1.0)], "g string, r double")
    got = {r.g: r for r in stats.one_sample_t(df, ("g",), "r").collect()}
    t = x.mean() / (x.std(ddof=1) / math.sqrt(50))
    assert got["a"].t == pytest.approx(t) and got["a"].p_value == pytest.approx(tails.t_two_sided(t, 49)) and got["b"].t is None
    s = {r.g: r for r in stats.sharpe_interval(df.where("not isnan(r)"), ("g",)).collect()}
    sr = x.mean() / x.std(ddof=1)
    assert s["a"].upper == pytest.approx((sr + 1.959964 * math.sqrt((1 + sr**2 / 2) / 50)) * math.sqrt(252), rel=1e-5) and s["b"].sharpe is None
    other = spark.createDataFrame([(i, 0.0) for i in range(50)], "k int, r double")
    mine = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k int, r double")
    assert stats.paired_t(mine, other, ("k",), "r", ()).first().t == pytest.approx(t)


def test_chance_matched_golden(spark):
    rows = [(i < 60, 0.5) for i in range(100)]
    got = stats.chance_matched(spark.createDataFrame(rows, "won boolean, win_odds double"), ()).first()
    assert got.z == pytest.approx(2.0) and got.p_value == pytest.approx(tails.normal_sf(2))


def test_bootstrap_covers_the_mean_and_repeats(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("x"))
    mean = ({"s": F.col("x"), "n": F.lit(1)}, F.col("s") / F.col("n"))
    a = stats.bootstrap(df, *mean, ("id",), 300).first()
    assert a.estimate == 4.5 and a.lower < 4.5 < a.upper and 0.5 < a.upper - a.lower < 1.2 and a.resamples == 300
    assert stats.bootstrap(df.repartition(7), *mean, ("id",), 300).first() == pytest.approx(a)


def test_bootstrap_against_written_out_draws(spark):
    df = spark.createDataFrame([(f"k{i}", float(i * i % 17)) for i in range(60)], "k string, x double")
    got = stats.bootstrap(df, {"s": F.col("x"), "q": F.col("x") * F.col("x"), "n": F.lit(1)}, F.sqrt(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2))), ("k",), 50, seed=9).first()
    import hashlib

    def stir(v):
        a = v % 2**31 * draws.A % 2**31
        b = (a ^ (a >> 15)) * draws.B % 2**31
        return b ^ (b >> 13)

    values = []
    for rep in range(50):
        w, x = [], []
        for i in range(60):
            number = int(hashlib.md5(f"k{i}".encode()).hexdigest()[:13], 16)
            u = stir(stir(stir(number % 2**31 + 9) ^ (number >> 31)) + rep)
            w.append(sum(u >= e for e in draws.poisson_edges()))
            x.append(float(i * i % 17))
        w, x = np.array(w), np.array(x)
        values.append(np.sqrt((w @ x**2) / w.sum() - (w @ x / w.sum()) ** 2))
    assert (got.lower, got.upper) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))
    first = df.select(draws.draw(draws.key_number("k"), 9, 3).alias("u")).first().u
    number = int(hashlib.md5(b"k0").hexdigest()[:13], 16)
    assert first == stir(stir(stir(number % 2**31 + 9) ^ (number >> 31)) + 3)


def test_draws_are_even_and_apart():
    u = draws.stirred(draws.base(np.arange(20_000) * 977 + 5, 42)[:, None] + np.arange(40, dtype=np.uint64)).astype(float) / draws.SPAN
    assert abs(u.mean() - 0.5) < 0.002 and abs(u.var() - 1 / 12) < 0.001 and np.abs(np.corrcoef(u.T) - np.eye(40)).max() < 0.04
    w = np.searchsorted(np.array(draws.poisson_edges()) / draws.SPAN, u.ravel(), "right")
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_little_bootstrap_of_a_median(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(3, 1, 4000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None), (-2, float("nan"))], "id long, x double")
    got = stats.little_bootstrap(df, "x", stats.weighted_median, ("id",), 200, 1000).first()
    half = 1.96 * 1.2533 / np.sqrt(4000)
    assert got.bags == 4 and got.lower < got.estimate < got.upper and abs((got.upper - got.lower) / (2 * half) - 1) < 0.3 and abs(got.estimate - 3) < 3 * half
    assert stats.little_bootstrap(df.repartition(5), "x", stats.weighted_median, ("id",), 200, 1000).first() == pytest.approx(got)
    assert stats.weighted_median(np.array([3.0, 1.0, 2.0]), np.array([1, 1, 2])) == 2.0 and stats.weighted_median(np.array([1.0, 4.0]), np.array([1, 1])) == 2.5


def test_reliability(spark):
    rng = np.random.default_rng(2)
    trait = rng.normal(0, 1, 200)
    m = np.clip(np.rint(2.5 + trait[:, None] + rng.normal(0, 0.7, (200, 4))), 1, 4).astype(int)
    df = spark.createDataFrame([tuple(map(int, r)) for r in m], "a int, b int, c int, d int")
    got = stats.cronbach(df, ("a", "b", "c", "d")).first()
    want = 4 / 3 * (1 - m.var(axis=0, ddof=1).sum() / m.sum(axis=1).var(ddof=1))
    assert got.alpha == pytest.approx(want)
    items = {r.item: r for r in stats.item_analysis(df, ("a", "b", "c", "d")).collect()}
    assert items["b"].item_rest == pytest.approx(np.corrcoef(m[:, 1], m.sum(axis=1) - m[:, 1])[0, 1])
    rest = np.delete(m, 2, axis=1)
    assert items["c"].alpha_without == pytest.approx(3 / 2 * (1 - rest.var(axis=0, ddof=1).sum() / rest.sum(axis=1).var(ddof=1)))
    f = stats.feldt(stats.cronbach(df, ("a", "b", "c", "d")), 4).first()
    assert f.lower < want < f.upper
    assert stats.cronbach(df.limit(1), ("a", "b")).first().alpha is None


def test_scores_by_hand(spark):
    y = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), ("a", "d")]
    df = spark.createDataFrame([("m", *p) for p in y], "model string, y_true string, y_pred string")
    got = metrics.scores(df).first()
    f1 = {"a": 2 * 0.5 * (1 / 3) / (0.5 + 1 / 3), "b": 2 * (2 / 3) / (2 / 3 + 1), "c": 0, "d": 0}
    assert got.accuracy == pytest.approx(0.5) and got.balanced_accuracy == pytest.approx((1 / 3 + 1 + 0) / 3)
    assert got.f1_macro == pytest.approx(sum(f1.values()) / 4) and got.f1_weighted == pytest.approx((3 * f1["a"] + 2 * f1["b"]) / 6)
    m = metrics.confusion_matrix(df, labels=("a", "b", "c")).toPandas().set_index("y_true")
    assert m.a.to_dict() == {"a": 1, "b": 0, "c": 1} and m.c.sum() == 0
    assert metrics.class_recall(df, "b").first().recall == 1


def test_best_model_and_baselines(spark):
    s = spark.createDataFrame([("x", 0.5, 0.6), ("y", 0.5, 0.7), ("base", 0.48, 0.9)], "model string, f1_weighted double, accuracy double")
    b = metrics.best_model(s, ("base",)).first()
    assert b.model == "y" and b.margin == pytest.approx(0.02) and b.negligible
    rows = [("train", "Hold", i) for i in range(60)] + [("train", "Buy", i) for i in range(20)] + [("test", "Avoid", i) for i in range(3000)]
    p = metrics.baselines(spark.createDataFrame(rows, "side string, target string, k int"), key=("k",))
    got = p.groupBy("model", "y_pred").count().toPandas().pivot(index="model", columns="y_pred", values="count").fillna(0)
    assert got.Hold["majority"] == 3000 and abs(got.Buy["stratified"] - 750) < 120 and got.Avoid["stratified"] == 0 and abs(got.Avoid["uniform"] - 1000) < 120


def test_sample_size(spark):
    n = spark.range(1).select(stats.sample_size(F.lit(0.6), F.lit(0.1))).first()[0]
    assert n == math.ceil((1.959964 + 0.841621) ** 2 * 0.24 / 0.01)


def test_answers_are_spread_and_grouped_where_they_are(spark, sf):
    wide = queries.wide_responses(spark, sf)
    assert queries.responses(spark, sf).rdd.getNumPartitions() >= 64
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "pivotfirst" not in plan.lower()
    long = queries.responses(spark, sf).groupBy("respondent_id").pivot("item_id", list(queries.ITEMS)).agg(F.first("score"))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, long.collect()))
