"""Classifier evaluation from confusion counts: one shuffle of rows, everything after on a few cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.columns import ratio

LABELS = ("Avoid", "Buy", "Hold")


def class_balance(rows: DataFrame, by: tuple[str, ...] = (), target: str = "target", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts and shares of each label within each group of ``by``."""
    counts = rows.groupBy(*by, F.col(target).alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.where(F.col("label").isin(*labels)).withColumn("share", ratio(F.col("n"), total))


def confusion_counts(predictions: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """``predictions(..by, y_true, y_pred)`` -> (..by, y_true, y_pred, n)."""
    return predictions.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(predictions: DataFrame, by: tuple[str, ...] = ("model",), labels: tuple[str, ...] = LABELS) -> DataFrame:
    """A row for each group and true label, a column for each predicted label in fixed order, zeros filled."""
    return predictions.groupBy(*by, "y_true").pivot("y_pred", list(labels)).count().na.fill(0, list(labels))


def class_report(predictions: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Per label: precision, recall, f1 (0 where undefined) and support, over labels seen on either side."""
    cells = confusion_counts(predictions, by)
    one = cells.select(*by, F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hits"))
    two = cells.select(*by, F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits"))
    per = one.union(two).groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision, recall = ratio(F.col("hits"), F.col("predicted"), 0.0), ratio(F.col("hits"), F.col("support"), 0.0)
    per = per.withColumns({"precision": precision, "recall": recall})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0)
    return per.withColumn("f1", f1)


def scores(predictions: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """One row a group: n_test, accuracy, balanced accuracy, weighted precision, recall, f1, macro f1."""
    per = class_report(predictions, by)
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), total)

    return per.groupBy(*by).agg(
        total.alias("n_test"), ratio(F.sum("hits"), total).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        weighted("precision").alias("precision_weighted"), weighted("recall").alias("recall_weighted"), weighted("f1").alias("f1_weighted"), F.avg("f1").alias("f1_macro"),
    )


def comparison(score_rows: DataFrame, digits: int = 4) -> DataFrame:
    """Scores rounded half-even for reporting, the best weighted F1 first."""
    named = [c for c, kind in score_rows.dtypes if kind == "double"]
    return score_rows.withColumns({c: F.bround(c, digits) for c in named}).orderBy(F.desc("f1_weighted"), F.desc("accuracy"), "model")


def best_model(score_rows: DataFrame, baselines: tuple[str, ...], negligible: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each group of ``by``, the model of the highest weighted F1 (then accuracy, then name) that is no baseline, its margin over the best baseline, and whether that is negligible."""
    is_base = F.col("model").isin(*baselines)
    order = F.struct("f1_weighted", "accuracy")
    best = score_rows.where(~is_base).groupBy(*by).agg(F.max_by("model", order).alias("model"), F.max_by("f1_weighted", order).alias("f1_weighted"), F.max_by("accuracy", order).alias("accuracy"))
    base = score_rows.where(is_base).groupBy(*by).agg(F.max("f1_weighted").alias("baseline_f1"))
    out = (best.join(base, list(by), "left") if by else best.crossJoin(base)).withColumn("margin", F.col("f1_weighted") - F.col("baseline_f1"))
    return out.withColumn("negligible", F.col("margin") < negligible)


def class_recall(predictions: DataFrame, label: str = "Buy", by: tuple[str, ...] = ("model",)) -> DataFrame:
    """The share of true ``label`` rows that were predicted so."""
    return predictions.where(F.col("y_true") == label).groupBy(*by).agg(F.avg((F.col("y_pred") == label).cast("double")).alias("recall"), F.count("*").alias("support"))


def seed_stability(score_rows: DataFrame, by: tuple[str, ...] = ("model",)) -> DataFrame:
    """Mean, least and largest accuracy and macro F1 over seeds."""
    return score_rows.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in ("accuracy", "f1_macro") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def comparable(predictions: DataFrame, restricted: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions on only those rows that ``restricted`` has too."""
    return predictions.join(restricted.select(key).distinct(), key, "left_semi")


def baselines(panel: DataFrame, seed: int = 42, key: tuple[str, ...] = ("ticker", "date"), target: str = "target", labels: tuple[str, ...] = LABELS, by: tuple[str, ...] = ()) -> DataFrame:
    """Predictions (by, model, keys, y_true, y_pred) of the three naive models on the test side of ``panel(side, target)``, within each group of ``by``.

    majority: the most frequent training label (first in order on a tie); stratified: drawn by a
    seeded number of the key (:mod:`..functions.draws`) against the training shares; uniform: drawn evenly. Without ``by`` there must be training rows; groups without any are left out.
    """
    counts = panel.where("side = 'train'").groupBy(*by).agg(F.count_if(F.col(target).isin(*labels)).alias("__all"), *[F.count_if(F.col(target) == x).alias(f"__n{i}") for i, x in enumerate(labels)]).where("__all > 0")
    if not by and counts.isEmpty():
        raise ValueError("no training rows")
    major = F.array_max(F.array(*[F.struct(F.col(f"__n{i}").alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(labels)]))["x"]
    u = [draws.uniform(draws.key_number(*key), seed, i) for i in range(2)]

    def drawn(v: Column, edges: list) -> Column:
        return F.coalesce(*[F.when(v < edge, name) for name, edge in zip(labels, edges)], F.lit(labels[-1]))

    upto = [sum((F.col(f"__n{j}") for j in range(i + 1)), F.lit(0)) / F.col("__all") for i in range(len(labels) - 1)]
    even = [F.lit((i + 1) / len(labels)) for i in range(len(labels) - 1)]
    test = panel.where("side = 'test'").select(*by, *key, F.col(target).alias("y_true"), u[0].alias("__u0"), u[1].alias("__u1"))
    test = test.join(counts, list(by)) if by else test.crossJoin(counts)  # one row
    picks = {"majority": major, "stratified": drawn(F.col("__u0"), upto), "uniform": drawn(F.col("__u1"), even)}
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("y_pred")) for m, p in picks.items()])).alias("m")
    return test.select(*by, *key, "y_true", rows).select(*by, "m.model", *key, "y_true", "m.y_pred")


def profile(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Long profile (column, n, missing, mean, sd, min, max) in one pass."""
    stats = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")
    return rows.select(stats).select("s.*").groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("min"), F.max("x").alias("max"))


def correlations(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Pearson correlations (a, b, r) of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = rows.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])).alias("c")
    return wide.select(cells).select("c.*")
