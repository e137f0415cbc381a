"""Scaling, fitting, comparing and keeping classifiers on panels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import folders
from . import blocks, ledger, metrics, splits, stats
from .indicators import FEATURES, label, sequences

#: Rows of a task of a fit, while there are at most MANY_TASKS of them: each sends sums of every node of a forest, so there are not more than help. Larger tables have tasks of BIG_TASK_ROWS.
TASK_ROWS, MANY_TASKS, BIG_TASK_ROWS = 1 << 12, 24, 1 << 17

LABELS = metrics.LABELS  # in order of their integer codes: Avoid 0, Buy 1, Hold 2


def code(target: Column, labels: Iterable[str] = LABELS) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in labels]), target) - 1).cast("double")


def decode(prediction: Column, labels: Iterable[str] = LABELS) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), prediction.cast("int") + 1)


def scaling(train: DataFrame, columns: Iterable[str] = FEATURES) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column of the training rows, in one pass; a constant column scales by 1."""
    columns = list(columns)
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def scaled(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    missing = [c for c in scale if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()})


def estimator(kind: str, n_train: int, seed: int = 42, **options):
    """lr: multinomial logistic regression with the penalty of C = 1; dt: decision tree; rf: random forest of 100 trees."""
    common = {"featuresCol": "features", "labelCol": "code", "predictionCol": "prediction"}
    if kind == "lr":
        return LogisticRegression(family="multinomial", regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False, maxIter=options.pop("maxIter", 200), **common, **options)
    if kind == "dt":
        return DecisionTreeClassifier(seed=seed, maxDepth=options.pop("maxDepth", 10), minInstancesPerNode=options.pop("minInstancesPerNode", 2), **common, **options)
    if kind == "rf":
        tuned = {"cacheNodeIds": True, "maxMemoryInMB": 512} | options  # rows know their nodes, and no step sends the forest to every task
        return RandomForestClassifier(seed=seed, numTrees=tuned.pop("numTrees", 100), maxDepth=tuned.pop("maxDepth", 15), **common, **tuned)
    raise ValueError(f"unknown model type {kind!r}: one of lr, dt, rf")


def fit(train: DataFrame, kind: str = "lr", columns: Iterable[str] = FEATURES, labels: Iterable[str] = LABELS, **options) -> tuple[PipelineModel, dict[str, tuple[float, float]]]:
    """Fit on ``train(features.., target)``: scaling by training rows only, then the estimator."""
    columns = list(columns)
    scale = scaling(train, columns)
    ready = scaled(train, scale).withColumn("code", code(F.col("target"), labels)).where(F.col("code") >= 0).select(*columns, "code").persist()
    try:
        n = ready.count()
        if not n:
            raise ValueError("no training rows")
        dealt = ready.repartition(max(min(-(-n // TASK_ROWS), MANY_TASKS), -(-n // BIG_TASK_ROWS)), *columns)
        model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), estimator(kind, n, **options)]).fit(dealt)
    finally:
        ready.unpersist()
    return model, scale


def predict(df: DataFrame, model: PipelineModel, scale: dict[str, tuple[float, float]], labels: Iterable[str] = LABELS) -> DataFrame:
    """``df`` with ``y_pred``; its feature columns stay as they were."""
    keep = df.columns
    held = df.select(*keep, F.struct(*keep).alias("__row"))
    out = model.transform(scaled(held, scale))
    return out.select("__row.*", decode(F.col("prediction"), labels).alias("y_pred"))


def importances(model: PipelineModel, columns: Iterable[str] = FEATURES) -> dict[str, float]:
    return dict(zip(columns, model.stages[-1].featureImportances.toArray().tolist()))


def save(model: PipelineModel, scale: dict[str, tuple[float, float]], spark, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(c, m, s) for c, (m, s) in scale.items()], "column string, mean double, sd double").coalesce(1).write.mode("overwrite").parquet(f"{path}/scale")


def load(spark, path: str) -> tuple[PipelineModel, dict[str, tuple[float, float]]]:
    """Fails if there is no model; the scaling may be absent."""
    model = PipelineModel.load(f"{path}/model")
    try:
        rows = spark.read.parquet(f"{path}/scale").collect()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    return model, {r["column"]: (r["mean"], r["sd"]) for r in rows}


def same_predictions(a: DataFrame, b: DataFrame) -> bool:
    """Whether two prediction tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def train_and_compare(panel: DataFrame, kinds: tuple[str, ...] = ("lr", "dt", "rf"), test_size: float = 0.2, horizon: int = 30, options: dict[str, dict] | None = None, columns: Iterable[str] = FEATURES) -> tuple[DataFrame, dict]:
    """Purged split, naive baselines, all models: long predictions (model, ticker, date, y_true, y_pred) and the fitted models."""
    split, _ = splits.purged_split(folders.kept(panel, "panel"), test_size, horizon)
    test = split.where("side = 'test'")
    ready, fitted = split.persist(), {}
    try:
        out = metrics.baselines(ready)
        for kind in kinds:
            fitted[kind] = fit(ready.where("side = 'train'"), kind, columns, **(options or {}).get(kind, {}))
    finally:
        ready.unpersist()
    for kind, (model, scale) in fitted.items():
        got = predict(test, model, scale)
        out = out.unionByName(got.select(F.lit(kind).alias("model"), "ticker", "date", F.col("target").alias("y_true"), "y_pred"))
    return out, fitted


def risk_classifier(profiles: DataFrame, target: str = "category", kinds: tuple[str, ...] = ("lr", "dt", "rf"), columns: tuple[str, ...] = ("age", "income", "horizon", "experience", "risk_score"), options: dict[str, dict] | None = None, key: str = "investor_id") -> tuple[DataFrame, dict]:
    """The same three models for the risk category of a profile, on a stratified split: long predictions (model, key, y_true, y_pred) and the fitted models.

    Rows without a category are left out. The best model is that of :func:`metrics.best_model`.
    """
    rows = profiles.where(F.col(target).isNotNull()).withColumn("target", F.col(target))
    labels = sorted(r[0] for r in rows.select("target").distinct().collect())  # a handful of categories
    split = splits.stratified_split(rows, key=(key,))
    train, test = split.where("side = 'train'"), split.where("side = 'test'")
    majority = train.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").first()
    out = test.select(F.lit("majority").alias("model"), key, F.col("target").alias("y_true"), F.lit(majority["target"] if majority else None).alias("y_pred"))
    fitted = {}
    for kind in kinds:
        fitted[kind] = fit(train, kind, columns, labels, **(options or {}).get(kind, {}))
        got = predict(test, *fitted[kind], labels)
        out = out.unionByName(got.select(F.lit(kind).alias("model"), key, F.col("target").alias("y_true"), "y_pred"))
    return out, fitted


def leakage_diagnostic(panel: DataFrame, kind: str = "rf", embargo_days: int = 60, options: dict | None = None) -> DataFrame:
    """The same model under a random split, a cut by time, and a cut with an embargo: scores of each (``model`` names the split).

    ``gap``: how far the weighted F1 of the random split lies above the split's own; ``severe``: by more than SEVERE_GAP.
    """
    panel = folders.kept(panel, "panel")
    cases = {"random": splits.stratified_split(panel), "chronological": splits.row_cut_split(panel, embargo_days=0), "embargo": splits.row_cut_split(panel, embargo_days=embargo_days)}
    out = None
    for name, split in cases.items():
        model, scale = fit(split.where("side = 'train'"), kind, **(options or {}))
        got = predict(split.where("side = 'test'"), model, scale).select(F.lit(name).alias("model"), F.col("target").alias("y_true"), "y_pred")
        out = got if out is None else out.unionByName(got)
    rows = metrics.scores(out)
    gap = F.max(F.when(F.col("model") == "random", F.col("f1_weighted"))).over(Window.partitionBy()) - F.col("f1_weighted")  # three rows
    return rows.withColumn("gap", gap).withColumn("severe", F.col("gap") > SEVERE_GAP)


SEVERE_GAP = 0.15


def threshold_sweep(panel: DataFrame, thresholds: tuple[float, ...] = (0.05, 0.075, 0.10, 0.15)) -> DataFrame:
    """The panel once for each label threshold (``threshold``, ``target``); the indicators are computed once."""
    many = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = panel.drop("target").select("*", many)
    return rows.withColumn("target", label(F.col("fwd_return"), F.col("threshold")))


def fit_many(train: DataFrame, by: str, columns: Iterable[str] = FEATURES, c: float = 1.0, steps: int = 40) -> dict:
    """A scaler and a multinomial logistic regression for every value of ``by`` of ``train(by, target, features..)``, all fitted together.

    A Newton step is one aggregation: a task adds up the gradient and the Hessian of every group, Spark adds up the tasks', and the driver solves
    a small system a group. Groups that have settled drop out; a step that would raise a group's loss is halved. ``by`` has a few values;
    their rows may be any number. Returns {value: (classes, mean, sd, weights)}; a group of one class has no model. The optimum is that of :func:`softmax_regression`.
    """
    columns = list(columns)
    d = len(columns) + 1
    codes = {label: i for i, label in enumerate(LABELS)}
    rows = train.where(F.col("target").isin(*LABELS)).select(F.col(by).alias("g"), code(F.col("target")).cast("int").alias("y"), F.array(*[F.col(x).cast("double") for x in columns]).alias("x")).persist()
    k = len(codes)

    def batches(frames: Iterator[pa.RecordBatch], names: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for frame in frames:
            x = frame.column("x").flatten().to_numpy(zero_copy_only=False).reshape(frame.num_rows, -1)
            y, g = frame.column("y").to_numpy(), np.array(frame.column("g").to_pylist(), object)
            for j, name in enumerate(names):
                mine = g == name
                if mine.any():
                    yield j, x[mine], y[mine]

    def summed(names: list, width: int, add: Callable) -> np.ndarray:
        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(names), width))
            for j, x, y in batches(frames, names):
                total[j] += add(j, x, y)
            yield pa.RecordBatch.from_pydict({"i": np.arange(total.size), "v": total.ravel()})

        out = np.zeros(len(names) * width)
        for i, v in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect():  # a few numbers a group
            out[i] = v
        return out.reshape(len(names), width)

    try:
        names = sorted(r[0] for r in rows.select("g").distinct().collect())
        middle = np.array(rows.agg(*[F.avg(F.col("x")[j]) for j in range(d - 1)]).first(), float) if names else None
        first = summed(names, 2 * (d - 1) + 1 + k, lambda j, x, y: np.concatenate(((x - middle).sum(axis=0), ((x - middle) ** 2).sum(axis=0), [len(x)], np.bincount(y, minlength=k))))
        model, live = {}, []
        for name, s in zip(names, first):
            n, kinds = s[2 * d - 2], np.flatnonzero(s[2 * d - 1 :])
            mean, sd = s[: d - 1] / n, np.sqrt(np.maximum(s[d - 1 : 2 * d - 2] / n - (s[: d - 1] / n) ** 2, 0))
            sd[sd < 1e-12 * (1 + np.abs(mean + middle))] = 1
            if len(kinds) > 1:
                model[name] = [kinds, mean + middle, sd, np.zeros((len(kinds), d))]
                live.append(name)
        ridge = np.diag(np.append(np.full(d - 1, 1.0 / c), 1e-9))

        def at(points: dict) -> dict:
            """Loss, gradient and Hessian of the groups at these weights."""
            some = list(points)

            def add(j: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
                kinds, mean, sd, _ = model[some[j]]
                a = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
                s = a @ points[some[j]].T
                s -= s.max(axis=1, keepdims=True)
                q = np.exp(s)
                q /= q.sum(axis=1, keepdims=True)
                place = np.searchsorted(kinds, y)
                loss = -np.log(np.maximum(q[np.arange(len(y)), place], 1e-300)).sum()
                m = len(kinds)
                hess = np.zeros((m, d, m, d))
                for u in range(m):
                    for v in range(m):
                        hess[u, :, v] = (a * (q[:, u] * ((u == v) - q[:, v]))[:, None]).T @ a
                out = np.zeros(1 + k * d + (k * d) ** 2)
                grad = ((q - np.eye(m)[place]).T @ a).ravel()
                out[0], out[1 : 1 + m * d], out[1 + k * d : 1 + k * d + (m * d) ** 2] = loss, grad, hess.reshape(-1)
                return out

            got = {}
            for name, s in zip(some, summed(some, 1 + k * d + (k * d) ** 2, add)):
                w, m = points[name], len(model[name][0])
                grad = s[1 : 1 + m * d].reshape(m, d) + w @ ridge
                got[name] = (s[0] + 0.5 * np.einsum("kd,de,ke->", w, ridge, w), grad, s[1 + k * d : 1 + k * d + (m * d) ** 2].reshape(m * d, m * d) + np.kron(np.eye(m), ridge))
            return got

        state = at({name: model[name][3] for name in live}) if live else {}
        pace = dict.fromkeys(live, 1.0)
        for _ in range(steps):
            if not live:
                break
            points = {}
            for name in live:
                _, grad, hess = state[name]
                points[name] = model[name][3] - pace[name] * np.linalg.solve(hess + 1e-8 * np.eye(len(hess)), grad.ravel()).reshape(grad.shape)
            after, left = at(points), []
            for name in live:
                gain = state[name][0] - after[name][0]
                if gain >= 0:
                    model[name][3], state[name], pace[name] = points[name], after[name], 1.0
                    if gain >= 1e-10 * max(1.0, abs(after[name][0])):
                        left.append(name)
                else:
                    pace[name] /= 2
                    if pace[name] > 1e-6:
                        left.append(name)
            live = left
    finally:
        rows.unpersist()
    return {name: tuple(m) for name, m in model.items()}


def predict_many(test: DataFrame, fitted: dict, by: str, columns: Iterable[str] = FEATURES) -> DataFrame:
    """``test`` with ``y_pred`` under its group's model of :func:`fit_many`; rows of groups without a model are left out. All expressions are Spark's own."""
    columns = list(columns)
    scores = None
    for name, (kinds, mean, sd, w) in fitted.items():
        inner = w[:, :-1] / sd
        fixed = w[:, -1] - inner @ mean
        each = [sum((F.col(x) * float(v) for x, v in zip(columns, row)), F.lit(float(b))) for row, b in zip(inner, fixed)]
        pairs = F.array(*[F.struct(s.alias("s"), F.lit(-int(k)).alias("k"), F.lit(LABELS[k]).alias("label")) for k, s in zip(kinds, each)])
        mine = F.when(F.col(by) == F.lit(name), F.array_max(pairs)["label"])
        scores = mine if scores is None else F.coalesce(scores, mine)
    return test.withColumn("y_pred", F.lit(None).cast("string") if scores is None else scores).where(F.col("y_pred").isNotNull())


def _studied(rows: DataFrame, by: str, train: int, test: int, step: int, cost: float, columns: Iterable[str] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """For ``rows(by, ticker, date, target, features..)``: scores of one regression and three baselines a group, and the groups' backtests. No loop over groups."""
    ready = splits.purged_split_by(rows, by).persist()
    try:
        fitted = fit_many(ready.where("side = 'train'"), by, columns)
    finally:
        ready.unpersist()
    got = predict_many(ready.where("side = 'test'"), fitted, by, columns).select(by, F.lit("lr").alias("model"), "ticker", "date", F.col("target").alias("y_true"), "y_pred")
    scored = metrics.scores(metrics.baselines(ready, by=(by,)).unionByName(got), (by, "model"))
    text = F.col(by).cast("string")
    signals = sliding_signals(rows.withColumn("ticker", F.concat_ws("\u0001", text, "ticker")), train, test, step)
    per = ledger.metrics(signals, cost, train=train, test=test, step=step).withColumn(by, F.substring_index("ticker", "\u0001", 1).cast(dict(rows.dtypes)[by]))
    return scored, ledger.summary(per, (by,)).select(by, "n_tickers", "mean_total_return", "mean_sharpe", "mean_excess_return", "pooled_win_rate")


def threshold_study(panel: DataFrame, thresholds: tuple[float, ...] = (0.05, 0.075, 0.10, 0.15), train: int = 500, test: int = 60, step: int = 60, cost: float = 0.001, columns: Iterable[str] = FEATURES) -> DataFrame:
    """A row a label threshold: class shares, a regression against the best naive baseline, and the backtest of per-window models. All thresholds are fitted together (:func:`fit_many`)."""
    rows = threshold_sweep(panel, thresholds)
    shares = rows.groupBy("threshold").agg(*[F.avg((F.col("target") == x).cast("double")).alias(f"share_{x.lower()}") for x in LABELS])
    scored, backtest = _studied(rows, "threshold", train, test, step, cost, columns)
    best = metrics.best_model(scored, ("majority", "stratified", "uniform"), by=("threshold",))
    return shares.join(best, "threshold").join(backtest, "threshold")


def universe_study(panel: DataFrame, universes: DataFrame, train: int = 500, test: int = 60, step: int = 60, cost: float = 0.001, columns: Iterable[str] = FEATURES) -> DataFrame:
    """A row a universe and model of ``universes(universe, ticker)``: a regression fitted on that universe alone, against its baselines, with its backtest."""
    scored, backtest = _studied(panel.join(universes.select("universe", "ticker").distinct(), "ticker"), "universe", train, test, step, cost, columns)
    return scored.select("universe", "model", "n_test", "accuracy", "f1_weighted").join(backtest, "universe")


def regime_study(panel: DataFrame, regimes: DataFrame, columns: Iterable[str] = FEATURES, **limits: int) -> dict[str, DataFrame]:
    """A model for each regime, fitted on what lies before it, all together: ``correct`` (regime, correct: 0 or 1 a test row), ``accuracy`` with
    intervals, and ``anova``, ``kruskal`` and ``tukey`` of the correct rows over regimes."""
    sides = splits.regime_split(panel, regimes, **limits)
    fitted = fit_many(sides.where("side = 'train'"), "regime", columns)
    out = predict_many(sides.where("side = 'test'"), fitted, "regime", columns).select("regime", (F.col("y_pred") == F.col("target")).cast("double").alias("correct"))
    per = out.groupBy("regime").agg(F.sum("correct").cast("long").alias("k"), F.count("*").alias("n"))
    ci = stats.wilson(F.col("k"), F.col("n"))
    accuracy = per.withColumns({"accuracy": ci["estimate"], "lower": ci["lower"], "upper": ci["upper"]})
    return {"correct": out, "accuracy": accuracy, "anova": stats.anova(out, "regime", "correct"), "kruskal": stats.kruskal(out, "regime", "correct"), "tukey": stats.tukey(out, "regime", "correct")}


def class_weights(train: DataFrame) -> DataFrame:
    """``train`` with ``weight`` = n / (classes * rows of the class)."""
    counts = {r["target"]: r["n"] for r in train.groupBy("target").agg(F.count("*").alias("n")).collect()}  # a row a class
    total = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col("target") == k, total / (len(counts) * n)) for k, n in counts.items()])
    return train.withColumn("weight", weight)


def sequence_classifier(panel: DataFrame, length: int = 20, hidden: tuple[int, ...] = (32,), seed: int = 42, max_iter: int = 50, share: float = 0.15):
    """A network over the flattened window of ``length`` rows: (model, the later windows of every stock with y_pred).

    The windows of each ticker are split by time; scaling and fit see the training side alone. The network
    knows no row weights, so :func:`sequence_validation` is the baseline with weighted classes.
    """
    from pyspark.ml.functions import array_to_vector

    sides = splits.trailing_validation(sequences(panel, length), share).withColumn("code", code(F.col("target"))).where("code >= 0")
    scale = scaling(sides.where("side = 'train'"))
    flat = F.flatten(F.transform("window", lambda w: F.array(*[(w[c] - m) / s for c, (m, s) in scale.items()])))
    rows = sides.withColumn("features", array_to_vector(flat))
    net = MultilayerPerceptronClassifier(layers=[length * len(FEATURES), *hidden, len(LABELS)], seed=seed, maxIter=max_iter, featuresCol="features", labelCol="code")
    model = net.fit(rows.where("side = 'train'").select("features", "code"))
    return model, model.transform(rows.where("side = 'validation'")).withColumn("y_pred", decode(F.col("prediction")))


def sequence_validation(panel: DataFrame, length: int = 20, share: float = 0.15, max_iter: int = 200):
    """Logistic regression over the flattened window of ``length`` rows, classes weighted n / (classes * rows of the class).

    The windows of each ticker are split by time: scaling, weights and fit see the training side alone, and
    the validation side of every ticker is returned with ``y_pred``.
    """
    from pyspark.ml.functions import array_to_vector

    sides = splits.trailing_validation(sequences(panel, length), share).withColumn("code", code(F.col("target"))).where("code >= 0")
    scale = scaling(sides.where("side = 'train'"))
    flat = F.flatten(F.transform("window", lambda w: F.array(*[(w[c] - m) / s for c, (m, s) in scale.items()])))
    rows = sides.withColumn("features", array_to_vector(flat))
    train = class_weights(rows.where("side = 'train'")).select("features", "code", "weight").persist()
    try:
        model = estimator("lr", train.count(), maxIter=max_iter, weightCol="weight").fit(train)
    finally:
        train.unpersist()
    return model, model.transform(rows.where("side = 'validation'")).withColumn("y_pred", decode(F.col("prediction")))


def softmax_regression(x: np.ndarray, y: np.ndarray, classes: int, c: float = 1.0, steps: int = 40) -> np.ndarray:
    """Multinomial logistic regression with an L2 penalty of weight 1 / c, by Newton steps with halving; the last column is the intercept."""
    n, d = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    one_hot = np.eye(classes)[y]
    ridge = np.diag(np.append(np.full(d, 1.0 / c), 1e-9))
    w = np.zeros((classes, d + 1))

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        s = a @ v.T
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        return float(-np.log(np.maximum(p[np.arange(n), y], 1e-300)).sum() + 0.5 * np.einsum("kd,de,ke->", v, ridge, v)), p

    value, p = loss(w)
    for _ in range(steps):
        grad = (p - one_hot).T @ a + w @ ridge
        size = classes * (d + 1)
        hess = np.zeros((size, size))
        for j in range(classes):
            for k in range(j, classes):
                q = p[:, j] * ((j == k) - p[:, k])
                block = (a * q[:, None]).T @ a + (ridge if j == k else 0)
                hess[j * (d + 1) : (j + 1) * (d + 1), k * (d + 1) : (k + 1) * (d + 1)] = block
                hess[k * (d + 1) : (k + 1) * (d + 1), j * (d + 1) : (j + 1) * (d + 1)] = block.T
        step = np.linalg.solve(hess + 1e-8 * np.eye(size), grad.ravel()).reshape(w.shape)
        t = 1.0
        while t > 1e-6:
            new, q = loss(w - t * step)
            if new <= value:
                break
            t /= 2
        else:
            break
        done = value - new < 1e-10 * max(1.0, abs(value))
        w, value, p = w - t * step, new, q
        if done:
            break
    return w


def grow(x: np.ndarray, y: np.ndarray, classes: int, depth: int | None, least: int, rng: np.random.Generator | None = None) -> tuple:
    """A decision tree by Gini impurity: a leaf is its class shares, an inner node (feature, threshold, left, right).

    ``depth``: None for any. ``least``: rows of a node that may still be split. With ``rng`` a node looks at sqrt(features) features drawn anew.
    """
    shares = np.bincount(y, minlength=classes) / len(y)
    if depth == 0 or len(y) < least or shares.max() == 1:
        return (shares,)
    some = np.arange(x.shape[1]) if rng is None else rng.permutation(x.shape[1])[: max(1, int(x.shape[1] ** 0.5))]
    order = np.argsort(x[:, some], axis=0, kind="stable")
    value = np.take_along_axis(x[:, some], order, axis=0)
    left = np.cumsum(np.eye(classes)[y[order]], axis=0)[:-1]  # [cut, feature, class]: rows of each class left of the cut
    right = left[-1] + np.eye(classes)[y[order[-1]]] - left
    n = np.arange(1, len(y))[:, None]
    gain = (left**2).sum(axis=2) / n + (right**2).sum(axis=2) / (len(y) - n)
    gain[value[1:] == value[:-1]] = -1
    cut, f = np.unravel_index(gain.argmax(), gain.shape)
    if gain[cut, f] < 0:
        return (shares,)
    edge = (value[cut, f] + value[cut + 1, f]) / 2
    edge = value[cut, f] if edge >= value[cut + 1, f] else edge  # where no number lies between the two
    here = x[:, some[f]] <= edge
    below = None if depth is None else depth - 1
    return some[f], edge, grow(x[here], y[here], classes, below, least, rng), grow(x[~here], y[~here], classes, below, least, rng)


def leaf_shares(tree: tuple, z: np.ndarray, classes: int) -> np.ndarray:
    if len(tree) == 1:
        return np.tile(tree[0], (len(z), 1))
    out, here = np.empty((len(z), classes)), z[:, tree[0]] <= tree[1]
    out[here], out[~here] = leaf_shares(tree[2], z[here], classes), leaf_shares(tree[3], z[~here], classes)
    return out


def forest_votes(x: np.ndarray, y: np.ndarray, z: np.ndarray, classes: int, weights: np.ndarray, width: int, depth: int | None, least: int, rng: np.random.Generator) -> np.ndarray:
    """Class shares of ``z`` added up over a forest: a tree for each row of ``weights`` (how often it drew each training row), each grown as :func:`grow` does.

    All trees grow together, level by level: a level sorts the rows of all its nodes once for each of the ``width`` features that a node draws.
    """
    codes = [np.unique(c, return_inverse=True) for c in x.T]
    values, rank = [v for v, _ in codes], np.stack([r for _, r in codes], axis=1)
    tree, row = np.nonzero(weights)
    w, node, n_nodes = weights[tree, row].astype(float), tree, len(weights)
    z_row, z_node = np.tile(np.arange(len(z)), n_nodes), np.repeat(np.arange(n_nodes), len(z))
    votes, level = np.zeros((len(z), classes)), 0
    while True:
        counts = np.bincount(node * classes + y[row], weights=w, minlength=n_nodes * classes).reshape(-1, classes)
        total = counts.sum(axis=1)
        open_ = (total >= least) & (counts.max(axis=1) < total) & (depth is None or level < depth)
        drawn = rng.random((n_nodes, x.shape[1])).argsort(axis=1)[:, :width]
        best, feature, at, after = np.full(n_nodes, -1.0), np.zeros(n_nodes, int), np.zeros(n_nodes, int), np.zeros(n_nodes, int)
        live = open_[node]
        node, row, w = node[live], row[live], w[live]
        for f in drawn.T if len(node) else ():
            order = np.argsort(node * len(x) + rank[row, f[node]])
            here, r = node[order], rank[row[order], f[node[order]]]
            start = np.flatnonzero(np.diff(here, prepend=-1))
            some = here[start]
            left = np.zeros((len(here), classes))
            left[np.arange(len(here)), y[row[order]]] = w[order]
            left = left.cumsum(axis=0)
            left -= np.repeat(left[start] - np.eye(classes)[y[row[order[start]]]] * w[order[start], None], np.diff(start, append=len(here)), axis=0)
            right, n = counts[here] - left, left.sum(axis=1)
            gain = (left**2).sum(axis=1) / n + (right**2).sum(axis=1) / np.maximum(total[here] - n, 1)
            gain[:-1][(here[1:] != here[:-1]) | (r[1:] == r[:-1])] = -1
            gain[-1] = -1
            top = np.maximum.reduceat(gain, start)
            better = top > best[some]
            first = np.minimum.reduceat(np.where(gain == np.repeat(top, np.diff(start, append=len(here))), np.arange(len(here)), len(here)), start)[better]
            some = some[better]
            best[some], feature[some], at[some], after[some] = top[better], f[some], r[first], r[first + 1]
        ends = best < 0
        done = ends[z_node]
        np.add.at(votes, z_row[done], (counts / total[:, None])[z_node[done]])
        if ends.all():
            return votes
        low, high = (np.array([values[f][k] for f, k in zip(feature, side)]) for side in (at, after))
        edge = (low + high) / 2
        edge = np.where(edge >= high, low, edge)  # where no number lies between the two
        child = 2 * (np.cumsum(~ends) - 1)
        live, z_row, z_node = ~ends[node], z_row[~done], z_node[~done]
        node, row, w = node[live], row[live], w[live]
        node = child[node] + (rank[row, feature[node]] > at[node])
        z_node = child[z_node] + (z[z_row, feature[z_node]] > edge[z_node])
        n_nodes, level = 2 * int((~ends).sum()), level + 1


def window_model(kind: str, seed: int = 42, trees: int = 100, depth: int | None = None) -> Callable:
    """``model(x_train, y_train, x_test) -> codes`` for one window: lr, dt or rf (of ``trees``). Trees grow until their leaves are pure, or to ``depth``."""

    def run(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        kinds, y = np.unique(y, return_inverse=True)
        if kind == "lr":
            w = softmax_regression(x, y, len(kinds))
            votes = np.hstack([z, np.ones((len(z), 1))]) @ w.T
        elif kind == "dt":
            votes = leaf_shares(grow(x, y, len(kinds), depth, 2), z, len(kinds))
        else:
            rng = np.random.default_rng(seed)
            drawn = np.stack([np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)) for _ in range(trees)])
            votes = forest_votes(x, y, z, len(kinds), drawn, max(1, int(x.shape[1] ** 0.5)), depth, 2, rng)
        return kinds[votes.argmax(axis=1)]

    if kind not in KINDS:
        raise ValueError(f"unknown model type {kind!r}: one of {', '.join(KINDS)}")
    return run


KINDS = ("lr", "dt", "rf")


def _window_codes(x: np.ndarray, y: np.ndarray, z: np.ndarray, predict_codes: Callable) -> list[str] | None:
    """Signals of a test side under a scaler and a model fitted on the training side; None if that has one class only."""
    if len(np.unique(y)) < 2:
        return None
    sd = x.std(axis=0)
    sd[sd == 0] = 1
    mean = x.mean(axis=0)
    return [LABELS[int(k)] for k in np.asarray(predict_codes((x - mean) / sd, y, (z - mean) / sd))]


def _without_failures(signals: DataFrame) -> DataFrame:
    """A ticker with any window that could not be fitted is left out whole."""
    failed = F.count_if(F.col("pred").isNull()).over(Window.partitionBy("ticker"))
    return signals.withColumn("__f", failed).where("__f = 0").drop("__f")


def sliding_signals(panel: DataFrame, train: int = 500, test: int = 60, step: int = 60, kind: str = "lr", columns: Iterable[str] = FEATURES, model: Callable | None = None, trees: int = 100, copies: float = 1.4) -> DataFrame:
    """:func:`walk_forward_signals` of all windows of a panel, whose rows are shuffled about once, not once a window.

    A ticker's windows are cut into blocks, so long that rows which two blocks need make up ``copies`` at most; a task gets the rows of a
    block and slides over its windows. A block holds about (train + test) * copies / (copies - 1) rows, however long the series is.
    """
    columns = list(columns)
    predict_codes = model or window_model(kind, trees=trees)
    span = train + test
    windows = max(1, -(-(span - step) // int(step * (copies - 1)) if step * (copies - 1) >= 1 else span))
    stride = windows * step  # rows from one block to the next

    n = F.count("*").over(Window.partitionBy("ticker"))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("date")) - 1
    rows = panel.select("ticker", "date", "close", "target", *[c for c in columns if c != "close"]).withColumns({"__p": place, "panel_rows": n}).where(F.col("panel_rows") >= span)
    last_block = F.expr(f"((panel_rows - {span}) div {step}) div {windows}")
    first = F.greatest(F.lit(0), F.ceil((F.col("__p") - (stride - step + span) + 1) / stride))
    rows = rows.withColumn("__block", F.explode(F.sequence(F.least(first.cast("long"), last_block), F.least(F.expr(f"__p div {stride}"), last_block))))
    rows = rows.where(F.col("__p") < F.col("__block") * stride + (stride - step + span))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__p")
        p, total, block = frame["__p"].to_numpy(), int(frame["panel_rows"].iloc[0]), int(frame["__block"].iloc[0])
        y = frame["target"].map({k: i for i, k in enumerate(LABELS)}).to_numpy()
        x, out = frame[columns].to_numpy(float), []
        for w in range(block * windows, min((block + 1) * windows, (total - span) // step + 1)):
            at = w * step - int(p[0])
            cut, end = at + train, at + span
            codes = _window_codes(x[at:cut], y[at:cut], x[cut:end], predict_codes)
            got = frame.iloc[cut:end][["ticker", "date", "close", "target", "panel_rows"]].copy()
            out.append(got.assign(window_id=w, i=np.arange(test), pred=codes))
        return pd.concat(out)[["ticker", "window_id", "i", "date", "close", "target", "panel_rows", "pred"]]

    kinds = dict(rows.dtypes)
    schema = f"ticker {kinds['ticker']}, window_id int, i int, date {kinds['date']}, close double, target string, panel_rows long, pred string"
    return _without_failures(blocks.spread(rows, "ticker", "__block").groupBy("ticker", "__block").applyInPandas(run, schema))


def walk_forward_signals(windows: DataFrame, kind: str = "lr", columns: Iterable[str] = FEATURES, model: Callable | None = None, trees: int = 100) -> DataFrame:
    """A fresh scaler and classifier for every (ticker, window), trained on that window alone: signals for the ledger.

    ``windows`` comes from :func:`splits.walk_forward`. A group holds train + test rows of one window,
    whatever the size of the panel. ``kind`` is lr, dt or rf (of ``trees`` trees); ``model(x_train, y_train,
    x_test) -> codes`` may be given instead. A ticker with a window whose training rows have a single class is left out whole.
    """
    columns = list(columns)
    predict_codes = model or window_model(kind, trees=trees)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "i"])
        train, test = frame[frame["side"] == "train"], frame[frame["side"] == "test"]
        y = train["target"].map({k: i for i, k in enumerate(LABELS)}).to_numpy()
        out = test[["ticker", "window_id", "i", "date", "close", "target", "panel_rows"]].copy()
        out["pred"] = _window_codes(train[columns].to_numpy(float), y, test[columns].to_numpy(float), predict_codes)
        return out

    kinds = {c: t for c, t in windows.dtypes}
    schema = f"ticker {kinds['ticker']}, window_id int, i int, date {kinds['date']}, close double, target string, panel_rows long, pred string"
    got = windows.select("ticker", "window_id", "side", "i", "date", "close", "target", "panel_rows", *[c for c in columns if c not in ("close",)]).groupBy("ticker", "window_id").applyInPandas(run, schema)
    return _without_failures(got)
