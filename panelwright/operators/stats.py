"""Intervals and tests: sufficient statistics in Spark, a closing formula on one row a group."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws, tails
from ..functions.columns import ratio


RANGES = 256  #: of values, ranked apart


def _doubles(f):
    """A closing formula as a vectorised function of aggregated columns; null where an argument is null."""

    @F.pandas_udf(T.DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        def one(*args):
            return None if any(pd.isna(a) for a in args) else float(f(*args))

        return pd.Series([one(*row) for row in zip(*columns)], dtype="float64")

    return run


t_two_sided = _doubles(tails.t_two_sided)
t_upper = _doubles(tails.t_sf)
f_upper = _doubles(tails.f_sf)
f_quantile = _doubles(tails.f_quantile)
chi2_upper = _doubles(tails.chi2_sf)
normal_upper = _doubles(tails.normal_sf)
studentized_upper = _doubles(lambda q, k, df: tails.studentized_range_sf(q, int(k), df))
binomial_two_sided = _doubles(lambda k, n, p: tails.binomial_test(int(k), int(n), p))
binomial_greater = _doubles(lambda k, n, p: tails.binomial_test(int(k), int(n), p, "greater"))
binomial_less = _doubles(lambda k, n, p: tails.binomial_test(int(k), int(n), p, "less"))


def interval(estimate: Column, lower: Column, upper: Column, confidence: float, n: Column) -> Column:
    return F.struct(estimate.alias("estimate"), lower.alias("lower"), upper.alias("upper"), F.lit(confidence).alias("confidence"), n.alias("n"), (upper - lower).alias("width"))


def excludes(x: Column, value: float) -> Column:
    """Whether an interval struct leaves ``value`` out."""
    return (F.lit(value) < x["lower"]) | (F.lit(value) > x["upper"])


def wilson(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """Wilson interval of k of n, clamped to [0, 1]; null unless n > 0 and 0 <= k <= n."""
    z = tails.normal_quantile(0.5 + confidence / 2)
    p = ratio(k, n)
    spread = 1 + ratio(F.lit(z * z), n)
    centre = (p + ratio(F.lit(z * z), 2 * n)) / spread
    half = F.sqrt(ratio(p * (1 - p), n) + ratio(F.lit(z * z), 4 * n * n)) * z / spread
    lower = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    upper = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.when((n > 0) & k.between(0, n), interval(p, lower, upper, confidence, n))


def chance_matched(trades: DataFrame, by: tuple[str, ...], won: str = "won", odds: str = "win_odds") -> DataFrame:
    """z of the wins against each trade's own odds (Poisson-binomial), and its upper tail; null without variance."""
    p = F.col(odds)
    got = trades.groupBy(*by).agg(F.sum(F.col(won).cast("int")).alias("k"), F.count("*").alias("n"), F.sum(p).alias("expected"), F.sum(p * (1 - p)).alias("variance"))
    z = F.when(F.col("variance") > 0, (F.col("k") - F.col("expected")) / F.sqrt("variance"))
    return got.withColumn("z", z).withColumn("p_value", normal_upper("z"))


def mcnemar(predictions: DataFrame, key: str = "row_id") -> DataFrame:
    """All pairs of models (a < b): discordant counts, statistic and p-value; exact below 25, with continuity correction above."""
    rows = predictions.select(key, "model", (F.col("y_true") == F.col("y_pred")).alias("ok"))
    pair = rows.select(key, F.col("model").alias("a"), F.col("ok").alias("ok_a")).join(rows.select(key, F.col("model").alias("b"), F.col("ok").alias("ok_b")), key).where("a < b")
    got = pair.groupBy("a", "b").agg(F.count_if(F.col("ok_a") & ~F.col("ok_b")).alias("only_a"), F.count_if(~F.col("ok_a") & F.col("ok_b")).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    chi = ratio(F.pow(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(2)), n)
    exact = binomial_two_sided(F.when((n > 0) & (n < 25), F.least("only_a", "only_b")), n, F.lit(0.5))
    got = got.withColumns({"statistic": F.when(n >= 25, chi), "exact_p": exact}).withColumn("p_value", F.when(n == 0, 1.0).when(n < 25, F.col("exact_p")).otherwise(chi2_upper("statistic", F.lit(1.0))))
    return got.drop("exact_p").withColumn("leader", F.when(F.col("only_a") > F.col("only_b"), F.col("a")).when(F.col("only_b") > F.col("only_a"), F.col("b")))


def _moments(rows: DataFrame, group: str, value: str, by: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*by, group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"))


def anova(rows: DataFrame, group: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One-way F test; null unless there are two groups of two at least and some variance within."""
    per = _moments(rows, group, value, by)
    total = per.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("least"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("ss"), F.sum((F.col("n") - 1) * F.col("variance")).alias("within")
    )
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    stat = F.when((F.col("k") >= 2) & (F.col("least") >= 2), ratio(ratio(between, F.col("k") - 1), ratio(F.col("within"), F.col("n") - F.col("k"))))
    return total.select(*by, "k", "n", stat.alias("f")).withColumn("p_value", f_upper("f", F.col("k") - 1, F.col("n") - F.col("k")))


def kruskal(rows: DataFrame, group: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Kruskal-Wallis with average ranks and tie correction.

    Ranks come from counts of distinct values, in up to RANGES ranges of them: a range's values are
    ranked in one task, and the counts of the ranges before give the rank at which it starts.
    """
    cells = rows.where(F.col(value).isNotNull()).groupBy(*by, group, value).agg(F.count("*").alias("n"))
    values = cells.groupBy(*by, value).agg(F.sum("n").alias("t"))
    cuts = values.agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("q")).first()["q"] or []
    edges = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    values = values.withColumn("__range", F.size(F.filter(edges, lambda e: e < F.col(value))))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = values.groupBy(*by, "__range").agg(F.sum("t").alias("__t")).select(*by, "__range", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__from"))
    run = Window.partitionBy(*by, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = values.join(starts, [*by, "__range"]).withColumn("rank", F.col("__from") + F.sum("t").over(run) - (F.col("t") - 1) / 2).select(*by, value, "rank", "t")
    ties = values.groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    summed = cells.join(ranks.drop("t"), [*by, value]).groupBy(*by, group).agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("n"))
    got = summed.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    got = got.join(ties, list(by)) if by else got.crossJoin(ties)
    n = F.col("n").cast("double")
    raw = F.col("s") * 12 / (n * (n + 1)) - 3 * (n + 1)
    h = F.when(F.col("k") >= 2, ratio(raw, 1 - ratio(F.col("ties"), n * n * n - n)))
    return got.select(*by, "k", "n", h.alias("h")).withColumn("p_value", chi2_upper("h", (F.col("k") - 1).cast("double")))


def tukey(rows: DataFrame, group: str, value: str) -> DataFrame:
    """All pairs of groups: difference of means, q and its p-value on the pooled variance."""
    per = _moments(rows, group, value, ())
    pool = per.agg(F.count("*").alias("k"), (F.sum("n") - F.count("*")).alias("df"), ratio(F.sum((F.col("n") - 1) * F.col("variance")), F.sum("n") - F.count("*")).alias("mse"))
    a = per.select(F.col(group).alias("a"), F.col("n").alias("na"), F.col("mean").alias("ma"))
    b = per.select(F.col(group).alias("b"), F.col("n").alias("nb"), F.col("mean").alias("mb"))
    pairs = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(pool))
    se = F.sqrt(F.col("mse") / 2 * (1 / F.col("na") + 1 / F.col("nb")))
    pairs = pairs.withColumns({"difference": F.col("ma") - F.col("mb"), "q": ratio(F.abs(F.col("ma") - F.col("mb")), se)})
    return pairs.withColumn("p_value", studentized_upper("q", "k", "df")).select("a", "b", "difference", "q", "p_value")


def sharpe_interval(returns: DataFrame, by: tuple[str, ...], value: str = "r", periods: int = 252, confidence: float = 0.95) -> DataFrame:
    """Annualised Sharpe ratio with the large-sample standard error sqrt((1 + SR^2 / 2) / n); null below three values or without spread."""
    z = tails.normal_quantile(0.5 + confidence / 2)
    got = returns.groupBy(*by).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    sr = F.when((F.col("n") >= 3) & (F.col("s") > 0), F.col("m") / F.col("s"))
    se = F.sqrt((1 + sr * sr / 2) / F.col("n"))
    scale = math.sqrt(periods)
    return got.select(*by, F.col("n"), (sr * scale).alias("sharpe"), ((sr - z * se) * scale).alias("lower"), ((sr + z * se) * scale).alias("upper"))


def one_sample_t(rows: DataFrame, by: tuple[str, ...], value: str, mu: float = 0.0) -> DataFrame:
    """t of the mean of finite values against ``mu``, two-sided."""
    x = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    got = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    t = F.when((F.col("n") >= 2) & (F.col("sd") > 0), (F.col("mean") - mu) / (F.col("sd") / F.sqrt("n")))
    return got.withColumn("t", t).withColumn("p_value", t_two_sided("t", (F.col("n") - 1).cast("double")))


def paired_t(a: DataFrame, b: DataFrame, key: tuple[str, ...], value: str, by: tuple[str, ...]) -> DataFrame:
    """t of the differences of two tables on their common keys; ``by`` are columns of the first."""
    both = a.select(*dict.fromkeys((*by, *key)), F.col(value).alias("__a")).join(b.select(*key, F.col(value).alias("__b")), list(key))
    return one_sample_t(both.withColumn("difference", F.col("__a") - F.col("__b")), by, "difference")


def bootstrap(rows: DataFrame, sums: dict[str, Column], statistic: Column, key: tuple[str, ...], resamples: int = 1000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of a statistic of sums of ``rows``, each row with its own Poisson(1) weight in every resample: one row (estimate, lower, upper, resamples).

    ``sums`` names columns to add up (nulls count as 0), and ``statistic`` is a formula of the sums, for example ``F.col("s") / F.col("n")`` of
    ``{"s": F.col("x"), "n": F.lit(1)}``. A task adds each row's weights, as a vector over all resamples, to one array a sum, and sends on these arrays alone:
    rows are never multiplied. Weights are draws from seed, resample and key (:mod:`..functions.draws`), the same in every run and partitioning.
    Statistics that no sums give are for :func:`little_bootstrap`.
    """
    names, edges = list(sums), np.array(draws.poisson_edges(), np.uint64)
    held = rows.select(draws.key_number(*key).alias("__k"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])

    def added(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, reps = np.zeros((len(names), resamples)), np.arange(resamples, dtype=np.uint64)
        for frame in frames:
            start = draws.base(frame.column("__k").to_numpy(), seed)
            x = np.vstack([frame.column(n).to_numpy() for n in names])
            for at in range(0, len(start), 64):
                u = draws.stirred(start[at : at + 64, None] + reps)
                total += x[:, at : at + 64] @ np.searchsorted(edges, u.ravel(), "right").reshape(u.shape)
        yield pa.RecordBatch.from_pydict({"rep": reps.astype(np.int64), **dict(zip(names, total))})

    schema = ", ".join(["rep long", *[f"`{n}` double" for n in names]])
    per = held.mapInArrow(added, schema).groupBy("rep").agg(*[F.sum(n).alias(n) for n in names]).select(statistic.alias("value"))
    lo = (1 - confidence) / 2
    ends = per.agg(F.percentile("value", F.lit(lo)).alias("lower"), F.percentile("value", F.lit(1 - lo)).alias("upper"), F.count("value").alias("resamples"))
    whole = held.agg(*[F.sum(n).alias(n) for n in names]).select(statistic.alias("estimate"))
    return whole.crossJoin(ends)  # one row each


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The median of ``values``, each taken ``weights`` times."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    low, high = np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], "right")
    return float(values[order[low]] + values[order[high]]) / 2


def little_bootstrap(rows: DataFrame, value: str, statistic: Callable[[np.ndarray, np.ndarray], float], key: tuple[str, ...], resamples: int = 200, bag_rows: int = 10_000, seed: int = 42, confidence: float = 0.95) -> DataFrame:
    """The same interval for any ``statistic(values, weights)``, such as a median: a bag of little bootstraps.

    Rows fall by a draw into bags of about ``bag_rows``; each bag, in a task of its own, is resampled to the size of the whole, and the ends of the bags' intervals are
    averaged. Null and non-finite values are left out. ``estimate`` is the mean of the bags' own values.
    """
    x = F.col(value).cast("double")
    fine = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).select(draws.key_number(*key).alias("__k"), x.alias("x"))
    n = fine.count()
    bags = max(1, -(-n // bag_rows))
    lo = (1 - confidence) / 2

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__k", "x"])
        values, bag = frame["x"].to_numpy(), int(frame["bag"].iloc[0])
        rng = np.random.default_rng([seed, bag])
        got = [statistic(values, rng.multinomial(n, np.full(len(values), 1 / len(values)))) for _ in range(resamples)]
        return pd.DataFrame([(statistic(values, np.ones(len(values), int)), *np.quantile(got, [lo, 1 - lo]))], columns=["estimate", "lower", "upper"])

    per = fine.withColumn("bag", (draws.draw(F.col("__k"), seed, 1) % bags).cast("int")).groupBy("bag").applyInPandas(one, "estimate double, lower double, upper double")
    return per.agg(*[F.avg(c).alias(c) for c in ("estimate", "lower", "upper")], F.lit(resamples).alias("resamples"), F.count("*").alias("bags"))


def sample_size(p: Column, effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Observations needed to tell a share p from p - effect, by the normal approximation."""
    z = tails.normal_quantile(1 - alpha / 2) + tails.normal_quantile(power)
    return F.ceil(ratio(F.lit(z * z) * p * (1 - p), effect * effect))


def cronbach(wide: DataFrame, items: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Alpha of item columns per cohort with its verbal label; null below two items or respondents or without variance."""
    k = len(items)
    total = sum((F.col(i) for i in items), F.lit(0)).cast("double")
    got = wide.groupBy(*by).agg(F.count("*").alias("n"), F.var_samp(total).alias("total_variance"), sum((F.var_samp(i) for i in items), F.lit(0.0)).alias("item_variance"))
    alpha = F.when((F.col("n") >= 2) & (F.col("total_variance") > 0) & F.lit(k >= 2), (1 - F.col("item_variance") / F.col("total_variance")) * (k / max(k - 1, 1)))
    got = got.withColumn("alpha", alpha)
    a = F.col("alpha")
    word = F.when(a >= 0.9, "excellent").when(a >= 0.8, "good").when(a >= 0.7, "acceptable").when(a >= 0.6, "questionable").when(a >= 0.5, "poor").when(a.isNotNull(), "unacceptable")
    return got.withColumn("label", word)


def item_analysis(wide: DataFrame, items: tuple[str, ...], weak: float = 0.30) -> DataFrame:
    """Per item: mean, deviation, correlation with the rest (0 if constant), alpha without it, whether it is weak. One pass."""
    k = len(items)
    total = sum((F.col(i) for i in items), F.lit(0)).cast("double")
    aggs = [F.var_samp(i).alias(f"v_{i}") for i in items] + [F.avg(i).alias(f"m_{i}") for i in items]
    aggs += [F.corr(F.col(i).cast("double"), total - F.col(i)).alias(f"r_{i}") for i in items] + [F.var_samp(total - F.col(i)).alias(f"t_{i}") for i in items]
    one = wide.agg(*aggs)

    def row(i: str) -> Column:
        rest = sum((F.col(f"v_{j}") for j in items if j != i), F.lit(0.0))
        alpha = F.when(F.lit(k > 2) & (F.col(f"t_{i}") > 0), (1 - rest / F.col(f"t_{i}")) * ((k - 1) / max(k - 2, 1)))
        r = F.coalesce(F.when(~F.isnan(f"r_{i}"), F.col(f"r_{i}")), F.lit(0.0))
        return F.struct(F.lit(i).alias("item"), F.col(f"m_{i}").alias("mean"), F.sqrt(f"v_{i}").alias("sd"), r.alias("item_rest"), alpha.alias("alpha_without"), (r < weak).alias("weak"))

    return one.select(F.explode(F.array(*[row(i) for i in items])).alias("x")).select("x.*")


def feldt(alphas: DataFrame, items: int, confidence: float = 0.95) -> DataFrame:
    """Feldt's interval for ``alphas(alpha, n)``."""
    tail = (1 - confidence) / 2
    d1, d2 = (F.col("n") - 1).cast("double"), ((F.col("n") - 1) * (items - 1)).cast("double")
    return alphas.withColumns({"__hi": f_quantile(F.lit(1 - tail), d1, d2), "__lo": f_quantile(F.lit(tail), d1, d2)}).withColumns({"lower": 1 - (1 - F.col("alpha")) * F.col("__hi"), "upper": 1 - (1 - F.col("alpha")) * F.col("__lo")}).drop("__hi", "__lo")
