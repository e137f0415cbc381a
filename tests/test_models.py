import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import blocks, indicators, ledger, metrics, models, rules, splits

COLS = ("x", "y")


def data(spark, n=300):
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 1, n), rng.normal(5, 3, n)
    target = np.where(x > 0.4, "Buy", np.where(x > -0.4, "Hold", "Avoid"))
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([("A", day + dt.timedelta(days=i), 100.0 + i, float(a), float(b), str(t)) for i, (a, b, t) in enumerate(zip(x, y, target))], "ticker string, date date, close double, x double, y double, target string")


@pytest.mark.parametrize("kind", ["lr", "dt", "rf"])
def test_fit_predict_save_load(spark, tmp_path, kind):
    df = data(spark)
    model, scale = models.fit(df, kind, COLS, **({"numTrees": 5} if kind == "rf" else {}))
    got = models.predict(df, model, scale)
    assert got.where("target = y_pred").count() > 270 and got.select("x").exceptAll(df.select("x")).isEmpty()
    models.save(model, scale, spark, str(tmp_path / kind))
    again = models.predict(df, *models.load(spark, str(tmp_path / kind)))
    assert models.same_predictions(got, again)
    with pytest.raises(Exception):
        models.load(spark, str(tmp_path / "nothing"))
    if kind == "rf":
        assert models.importances(model, COLS)["x"] > 0.8


def test_errors(spark):
    with pytest.raises(ValueError, match="unknown model"):
        models.estimator("svm", 10)
    with pytest.raises(ValueError, match="missing features: z"):
        models.scaled(data(spark), {"z": (0, 1)})


def test_scaling_uses_the_population_deviation(spark):
    assert models.scaling(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double"), ["x"])["x"] == (pytest.approx(7 / 3), pytest.approx(1.2472191))


def test_softmax_regression_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 3, 200)
    w = models.softmax_regression(x, y, 3)
    a = np.hstack([x, np.ones((200, 1))])
    p = np.exp(a @ w.T)
    p /= p.sum(axis=1, keepdims=True)
    grad = (p - np.eye(3)[y]).T @ a + w * np.array([1, 1, 1, 0])
    assert np.abs(grad).max() < 1e-5


def test_walk_forward_models_feed_the_ledger(spark):
    w = splits.walk_forward(data(spark), 100, 20, 40)
    s = models.walk_forward_signals(w, columns=COLS)
    assert s.count() == 20 * 5 and s.where("pred = target").count() > 80
    assert ledger.metrics(s, step=40).count() == 1
    fixed = models.walk_forward_signals(w, columns=COLS, model=lambda x, y, z: [1] * len(z))
    assert {r.pred for r in fixed.select("pred").distinct().collect()} == {"Buy"}
    one = w.withColumn("target", F.when(F.col("window_id") == 0, "Buy").otherwise(F.col("target")))
    assert models.walk_forward_signals(one, columns=COLS).count() == 0
    for kind in ("dt", "rf"):
        s = models.walk_forward_signals(w, kind, COLS, trees=15)
        assert s.count() == 20 * 5 and s.where("pred = target").count() > 75, kind
        assert s.exceptAll(models.walk_forward_signals(w.repartition(3), kind, COLS, trees=15)).isEmpty()
    with pytest.raises(ValueError, match="unknown model"):
        models.walk_forward_signals(w, "svm")


def test_a_tree_fits_its_rows_and_splits_where_impurity_falls_most():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = ((x[:, 1] > 0.3).astype(int) + (x[:, 0] > 0) * (x[:, 1] > 0.3)).astype(int)
    tree = models.grow(x, y, 3, 10, 2)
    assert (models.leaf_shares(tree, x, 3).argmax(axis=1) == y).all()

    def impurity(here):
        return sum(len(p) * (1 - ((np.bincount(p, minlength=3) / len(p)) ** 2).sum()) for p in (y[here], y[~here]) if len(p))

    best = min(impurity(x[:, f] <= v) for f in range(3) for v in x[:-1, f])
    assert impurity(x[:, tree[0]] <= tree[1]) == pytest.approx(best)
    stump = models.grow(np.ones((5, 2)), np.array([0, 1, 1, 2, 1]), 3, 4, 2)
    assert len(stump) == 1 and stump[0].tolist() == [0.2, 0.6, 0.2]  # nothing to split on


def test_sliding_windows_are_the_copied_windows(spark):
    rng = np.random.default_rng(6)
    day = dt.date(2020, 1, 1)
    rows = [(t, day + dt.timedelta(days=i), 100.0 + i, float(rng.normal()), float(rng.normal()), str(rng.choice(models.LABELS))) for t, n in (("A", 230), ("B", 61), ("C", 49), ("D", 50)) for i in range(n)]
    p = spark.createDataFrame(rows, "ticker string, date date, close double, x double, z double, target string")
    for train, test, step, copies in ((40, 10, 10, 1.4), (40, 10, 7, 2.0), (40, 10, 25, 1.1), (40, 10, 60, 1.4)):
        for kind in ("lr", "dt"):
            a = models.walk_forward_signals(splits.walk_forward(p, train, test, step), kind, ["x", "z"])
            b = models.sliding_signals(p, train, test, step, kind, ["x", "z"], copies=copies)
            assert a.count() and a.select(sorted(a.columns)).exceptAll(b.select(sorted(a.columns))).isEmpty() and a.count() == b.count()


def test_trees_of_windows_are_unbounded():
    x = np.arange(64.0)[:, None]
    y = np.arange(64) % 2
    assert (models.window_model("dt")(x, y, x) == y).all() and not (models.window_model("dt", depth=2)(x, y, x) == y).all()


def test_many_groups_fit_as_each_alone(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g, shift in (("a", 0.0), ("b", 1.5), ("c", -1.0)):
        x = rng.normal(shift, 3, (150, 2)) * [1, 1000]
        s = x @ np.array([[1, 0.001], [-0.5, 0.002], [0.2, 0]]).T + rng.gumbel(size=(150, 3))
        rows += [(g, float(u), float(v), models.LABELS[int(k)]) for (u, v), k in zip(x, s.argmax(axis=1) if g != "c" else s[:, :2].argmax(axis=1))]
    rows += [("single", 1.0, 2.0, "Buy"), ("single", 2.0, 2.0, "Buy")]
    df = spark.createDataFrame(rows, "g string, x double, z double, target string")
    fitted = models.fit_many(df.repartition(3), "g", ["x", "z"])
    assert sorted(fitted) == ["a", "b", "c"] and fitted["c"][0].tolist() == [0, 1]
    for g, (kinds, mean, sd, w) in fitted.items():
        x = np.array([r[1:3] for r in rows if r[0] == g])
        y = np.searchsorted(kinds, [models.LABELS.index(r[3]) for r in rows if r[0] == g])
        np.testing.assert_allclose(mean, x.mean(axis=0), rtol=1e-9)
        np.testing.assert_allclose(sd, x.std(axis=0), rtol=1e-9)
        want = models.softmax_regression((x - mean) / sd, y, len(kinds))
        np.testing.assert_allclose(w[:, :-1], want[:, :-1], atol=1e-4)
        got = [r.y_pred for r in models.predict_many(df.where(F.col("g") == g).orderBy("x"), fitted, "g", ["x", "z"]).collect()]
        order = np.argsort(x[:, 0])
        votes = np.hstack([(x - mean) / sd, np.ones((len(x), 1))]) @ w.T
        assert got == [models.LABELS[kinds[k]] for k in votes[order].argmax(axis=1)]
    assert models.fit_many(df.where("false"), "g", ["x", "z"]) == {} and models.predict_many(df, {}, "g", ["x", "z"]).count() == 0


def test_groups_are_split_by_their_own_dates(spark):
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(g, day + dt.timedelta(days=i * k)) for g, n, k in (("a", 50, 1), ("b", 33, 3)) for i in range(n)], "g string, date date")
    both = splits.purged_split_by(df, "g", 0.2, 5)
    for g in ("a", "b"):
        alone, _ = splits.purged_split(df.where(F.col("g") == g), 0.2, 5)
        assert both.where(F.col("g") == g).exceptAll(alone).isEmpty() and alone.count() == both.where(F.col("g") == g).count()


def test_risk_classifier(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(18, 80)), float(rng.integers(0, 99)), int(rng.integers(1, 30)), int(rng.integers(0, 30)), int(rng.integers(1, 11))) for i in range(600)]
    p = spark.createDataFrame(rows, "investor_id bigint, age int, income double, horizon int, experience int, risk_score int")
    p = p.withColumn("category", rules.risk_class(*[F.col(c) for c in ("age", "horizon", "experience", "risk_score")]))
    out, fitted = models.risk_classifier(p, kinds=("lr", "dt"))
    s = {r.model: r for r in metrics.scores(out).collect()}
    assert set(s) == {"majority", "lr", "dt"} and set(fitted) == {"lr", "dt"} and s["dt"].accuracy > 0.9 > s["majority"].accuracy
    assert metrics.best_model(metrics.scores(out), ("majority",)).first().model == "dt"
    sides = out.where("model = 'dt'").groupBy("y_true").count().collect()
    assert sum(r["count"] for r in sides) == pytest.approx(120, abs=3)  # a fifth of every category


def test_leakage_gap(spark):
    got = {r.model: r for r in models.leakage_diagnostic(data(spark), "dt", 5, {"columns": COLS}).collect()}
    assert got["random"].gap == 0 and not got["random"].severe
    for r in got.values():
        assert r.gap == pytest.approx(got["random"].f1_weighted - r.f1_weighted) and r.severe == (r.gap > 0.15)


def test_weights_and_thresholds(spark):
    df = spark.createDataFrame([("Buy", 0.2), ("Hold", 0.06), ("Hold", 0.04), ("Avoid", -0.1)], "target string, fwd_return double")
    assert {r.target: r.weight for r in models.class_weights(df).collect()} == {"Buy": pytest.approx(4 / 3), "Hold": pytest.approx(2 / 3), "Avoid": pytest.approx(4 / 3)}
    got = models.threshold_sweep(df, (0.05, 0.1)).groupBy("threshold", "target").count().toPandas()
    assert got[(got.threshold == 0.05) & (got.target == "Buy")]["count"].iloc[0] == 2


def test_sequence_model_runs(spark):
    rng = np.random.default_rng(4)
    day = dt.date(2020, 1, 1)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.05, 160)))
    p = indicators.labelled(spark.createDataFrame([("A", day + dt.timedelta(days=i), float(c), 10) for i, c in enumerate(close)], "ticker string, date date, close double, volume bigint"))
    _, rows = models.sequence_classifier(p, 5, (4,), max_iter=3)
    assert 0 < rows.count() < p.count() / 4 and rows.where("y_pred is null").count() == 0


def test_sequence_validation_scores_the_later_windows_of_every_stock(spark):
    rng = np.random.default_rng(5)
    day = dt.date(2020, 1, 1)
    series = {t: 100 * np.exp(np.cumsum(rng.normal(0, 0.05, n))) for t, n in (("A", 200), ("B", 260))}
    rows = [(t, day + dt.timedelta(days=i), float(c), 10) for t, x in series.items() for i, c in enumerate(x)]
    p = indicators.labelled(spark.createDataFrame(rows, "ticker string, date date, close double, volume bigint")).persist()
    model, scored = models.sequence_validation(p, 5)
    assert model.numFeatures == 5 * len(indicators.FEATURES)
    got = scored.select("ticker", "date", "y_pred").toPandas()
    for t, of in p.select("ticker", "date").toPandas().groupby("ticker"):
        days = sorted(of["date"])[4:]
        assert sorted(got[got.ticker == t]["date"]) == days[len(days) - int(len(days) * 0.15):]
    assert got.y_pred.isin(models.LABELS).all()
    # what comes after the cut changes no fit
    cut = got.groupby("ticker")["date"].min().to_dict()
    after = F.lit(False)
    for t, first in cut.items():
        after = after | ((F.col("ticker") == t) & (F.col("date") >= F.lit(first)))
    other = p.withColumns({c: F.when(after, F.lit(9.0)).otherwise(F.col(c)) for c in indicators.FEATURES}).withColumn("target", F.when(after, "Buy").otherwise(F.col("target")))
    again, _ = models.sequence_validation(other, 5)
    np.testing.assert_allclose(again.coefficientMatrix.toArray(), model.coefficientMatrix.toArray(), atol=1e-6)


def test_sequence_query_scores_all_stocks_and_no_training_row(spark, sf):
    from panelwright.plans import queries

    (row,) = queries.sequence_model(spark, sf).collect()
    n = queries.labelled(spark, sf).groupBy("ticker").count().collect()
    want = sum(max(1, min(int((r["count"] - 19) * 0.15), r["count"] - 20)) for r in n if r["count"] > 20)
    assert row.n_test == want


def test_queries_use_the_whole_options(spark, sf, monkeypatch):
    """Steps, forests and resamples as in the other queries and the reference."""
    from panelwright.operators import stats
    from panelwright.plans import queries

    seen = {}

    def spy(module, name, result=None):
        real = getattr(module, name)

        def call(*args, **kw):
            seen.setdefault(name, []).append((args[1:], kw))
            return real(*args, **kw) if result is None else result

        monkeypatch.setattr(module, name, call)

    one = spark.range(1)
    spy(models, "sliding_signals", one)
    spy(ledger, "metrics", one)
    spy(models, "train_and_compare", (spark.createDataFrame([("m", "Buy", "Buy")], "model string, y_true string, y_pred string"), {}))
    spy(stats, "bootstrap", one)
    queries.walk_forward_models(spark, sf)
    queries.trained_models(spark, sf)
    queries.bootstrap_mean(spark, sf)
    assert seen["sliding_signals"][0][0] == (queries.TRAIN, queries.TEST, queries.STEP) and seen["metrics"][0][1] == {"train": queries.TRAIN, "test": queries.TEST, "step": queries.STEP}
    assert seen["train_and_compare"] == [((), {})]
    assert seen["bootstrap"][0][0][-1] == 10_000
    forest = models.estimator("rf", 10)
    assert (forest.getOrDefault("numTrees"), forest.getOrDefault("maxDepth")) == (100, 15)


def test_a_forest_grown_together_is_its_trees_one_by_one():
    rng = np.random.default_rng(3)
    x, y, z = rng.normal(size=(120, 1)).round(1), rng.integers(0, 3, 120), rng.normal(size=(40, 1))
    weights = np.stack([np.bincount(rng.integers(0, 120, 120), minlength=120) for _ in range(5)])
    for depth in (None, 0, 3):
        alone = sum(models.leaf_shares(models.grow(np.repeat(x, w, axis=0), np.repeat(y, w), 3, depth, 2), z, 3) for w in weights)
        assert np.allclose(models.forest_votes(x, y, z, 3, weights, 1, depth, 2, rng), alone)


def test_windows_of_a_small_panel_are_fitted_in_many_tasks(spark):
    rows = spark.range(2000).select((F.col("id") % 20).cast("string").alias("ticker"), F.lit(0).alias("block"))
    got = blocks.spread(rows, "ticker", "block").groupBy("ticker", "block").applyInPandas(lambda f: f.head(1), "ticker string, block int")
    assert got.groupBy(F.spark_partition_id()).count().count() > 8


def test_models_that_are_compared_share_one_reading_of_the_panel(spark):
    rows, read = data(spark), spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(frame.num_rows)
            yield frame

    n = rows.count()
    out, _ = models.train_and_compare(rows.mapInArrow(counted, rows.schema), ("lr", "dt"), columns=COLS)
    assert out.select("model").distinct().count() == 5 and read.value == n


def test_splits_that_are_compared_share_one_reading_of_the_panel(spark):
    rows, read = data(spark), spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            read.add(frame.num_rows)
            yield frame

    models.leakage_diagnostic(rows.mapInArrow(counted, rows.schema), "dt", 5, {"columns": COLS}).collect()
    assert read.value == rows.count()
