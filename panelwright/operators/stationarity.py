"""KPSS and augmented Dickey-Fuller tests for many series at once, of any length, from sums that blocks of rows send on.

No series is gathered. A block of rows, with copies of the few rows before it, gives autocovariances, sums of its running sum, and
one Gram matrix of the level and its lagged differences. The sums of all blocks decide both tests but for KPSS's long-run variance. With
the Bartlett weights of l lags that is the sum of squares of all sums of l + 1 neighbours, over l + 1, and so comes from differences of the running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tails import normal_sf
from . import blocks

MIN_OBS, MAX_OBS = 20, 5000
# KPSS level critical values by p, and MacKinnon's (1994) response surface for the p-value of t, one variable with a constant.
KPSS_TABLE = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
ADF_LEAST, ADF_BREAK, ADF_MOST = -18.83, -1.61, 2.74
ADF_LOW = (2.1659, 1.4412, 0.038269)
ADF_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)
TINY = 1e-11  #: of a column's square, what is left of it beside the others: less counts as nothing
PIECE = 4096  #: rows of a lag matrix at a time
KPSS_COLUMNS = ("ticker", "feature", "n_obs", "kpss", "kpss_lags", "kpss_p", "kpss_stationary")


def width_of(n: int) -> int:
    """Autocovariances that settle KPSS's bandwidth."""
    return int(np.ceil(n ** (2 / 9)))


def orders_of(n: int) -> int:
    """The greatest lag order that ADF tries."""
    return max(0, min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3))


def bandwidth(n: int, cov: np.ndarray) -> int:
    """KPSS's data-driven number of lags from sums of products at lags 0, 1, ..."""
    later = cov[1:] / (n / 2)
    s0 = cov[0] / n + later.sum()
    s1 = np.arange(1, len(cov)) @ later
    return min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0, n - 1)


def lagged(z: np.ndarray, start: int, end: int, lags: int) -> np.ndarray:
    """A row for each of z[start:end]: one, the level before, ``lags`` differences before, and its own difference."""
    dz = np.diff(z)
    return np.column_stack([np.ones(end - start), z[start - 1 : end - 1], *(dz[start - 1 - i : end - 1 - i] for i in range(1, lags + 1)), dz[start - 1 : end - 1]])


def block_sums(z: np.ndarray, own: int, width: int, orders: int | None) -> np.ndarray:
    """What the rows z[own:] add to the sums of their series; z[:own] are copies of the rows before them, none in the first block.

    Sums of products at lags 0 to ``width``; unless ``orders`` is None also the Gram matrix of :func:`lagged`, of all rows that have so many
    lags, and the first ``orders`` + 1 values of the series.
    """
    out = [np.array([z[max(own, i) :] @ z[max(own, i) - i : len(z) - i] if max(own, i) < len(z) else 0.0 for i in range(width + 1)])]
    if orders is not None:
        gram = np.zeros((orders + 3, orders + 3))
        for start in range(max(own, orders + 1), len(z), PIECE):
            end = min(start + PIECE, len(z))
            rows = lagged(z[start - orders - 1 : end], orders + 1, end - start + orders + 1, orders)
            gram += rows.T @ rows
        out += [gram.ravel(), z[: orders + 1] if own == 0 else np.zeros(orders + 1)]
    return np.concatenate(out)


def adf(n: int, gram: np.ndarray, head: np.ndarray) -> tuple[float, int]:
    """t of the level and the lag order, from the Gram matrix of ``orders_of(n)`` lags and the values before the rows it is made of.

    One Cholesky factor holds the residuals of every order: what is left of the difference after the columns so far. The order of the least AIC,
    all on a common sample, is then fitted on all rows that it has. Columns that others explain are left out; a perfect fit has an infinite t, or 0 without a slope.
    """
    most = orders_of(n)
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    left = gram / np.outer(scale, scale)
    rss = [left[-1, -1]]
    for j in range(most + 2):
        if left[j, j] > TINY:
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
        rss.append(max(left[-1, -1], 1e-300))
    rows = n - 1 - most
    best = min(range(most + 1), key=lambda k: rows * np.log(rss[k + 2] / rows) + 2 * (k + 2))
    keep = [*range(best + 2), most + 2]
    full = gram[np.ix_(keep, keep)]
    if best < most:
        early = lagged(head, best + 1, most + 1, best)
        full = full + early.T @ early
    scale = np.sqrt(np.maximum(np.diag(full), 1e-300))
    full = full / np.outer(scale, scale)
    inverse = np.linalg.pinv(full[:-1, :-1], rcond=TINY, hermitian=True)
    beta = inverse @ full[:-1, -1]
    rest = full[-1, -1] - beta @ full[:-1, -1]
    if rest <= TINY:
        return (0.0 if abs(beta[1]) < 1e-6 else float(np.copysign(np.inf, beta[1]))), best
    return float(beta[1] / np.sqrt(rest / (n - 1 - best - (best + 2)) * inverse[1, 1])), best


def adf_p(t: float) -> float:
    """The p-value of a Dickey-Fuller t: the normal distribution at a polynomial in t, whose pieces meet at ADF_BREAK."""
    if t > ADF_MOST:
        return 1.0
    if t < ADF_LEAST:
        return 0.0
    return 1 - normal_sf(sum(c * t**k for k, c in enumerate(ADF_LOW if t <= ADF_BREAK else ADF_HIGH)))


def kpss_p(stat: Column) -> Column:
    """p between the published values on a line, within [0.01, 0.10]."""
    p = F.when(stat <= KPSS_TABLE[0][0], KPSS_TABLE[0][1])
    for (c0, p0), (c1, p1) in zip(KPSS_TABLE, KPSS_TABLE[1:]):
        p = p.when(stat <= c1, p0 + (stat - c0) * ((p1 - p0) / (c1 - c0)))
    return p.otherwise(KPSS_TABLE[-1][1])


def standardised(rows: DataFrame, columns: tuple[str, ...], entity: str = "ticker", order: str = "date", most: int | None = MAX_OBS, block: int = blocks.ROWS) -> DataFrame:
    """``(ticker, feature, rn, n_rows, z)``: the values of all series worth a test, by number from 0, less their mean and over their deviation.

    Null and non-finite values are left out. Series of more than ``most`` values are thinned to every n // ``most``-th one; None keeps all.
    Then series of fewer than MIN_OBS values, or of equal ones, are skipped.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")
    long = rows.select(F.col(entity).alias("ticker"), F.col(order).alias("at"), cells).select("ticker", "at", "c.*").where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    long = blocks.numbered(long.withColumn("__s", F.struct("ticker", "feature")), "__s", "at", block)
    if most is not None:
        long = long.withColumn("__step", F.greatest(F.expr(f"n_rows div {most}"), F.lit(1))).where("rn % __step = 0").withColumn("rn", F.expr("rn div __step"))
    moments = long.groupBy(F.col("__s").alias("__t")).agg(F.count("*").alias("__n"), F.avg("x").alias("__mean"), F.stddev_pop("x").alias("__sd"), F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    moments = moments.where((F.col("__n") >= MIN_OBS) & (F.col("__hi") > F.col("__lo")) & (F.col("__sd") > 0))
    z = ((F.col("x") - F.col("__mean")) / F.col("__sd")).alias("z")
    return long.join(moments, F.col("__s").eqNullSafe(F.col("__t"))).select("ticker", "feature", "rn", F.col("__n").alias("n_rows"), z)


def _closed(base: DataFrame, block: int, with_adf: bool) -> DataFrame:
    """A row a series: ``n_obs``, ADF's results (null without it), the sum of squares of the running sum, KPSS's lags."""

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rn")
        z, own, n = frame["z"].to_numpy(), int((~frame["__own"]).sum()), int(frame["n_rows"].iloc[0])
        run = np.cumsum(z[own:])
        sums = block_sums(z, own, width_of(n), orders_of(n) if with_adf else None)
        first = frame.iloc[0]
        return pd.DataFrame({"ticker": [first["ticker"]], "feature": [first["feature"]], "n": [n], "block": [first["__block"]], "m": [len(run)], "total": [run[-1]], "runs": [run.sum()], "squares": [run @ run], "v": [sums]})

    ticker = dict(base.dtypes)["ticker"]
    before = F.greatest(F.ceil(F.pow("n_rows", F.lit(2 / 9))), F.ceil(12 * F.pow(F.col("n_rows") / 100, F.lit(0.25))) + 1)
    parts = blocks.halo(base, before, rows=block).groupBy("ticker", "feature", "__block").applyInPandas(gather, f"ticker {ticker}, feature string, n bigint, block bigint, m bigint, total double, runs double, squares double, v array<double>")
    carry = F.coalesce(F.sum("total").over(Window.partitionBy("ticker", "feature").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.withColumn("c", carry).select("ticker", "feature", "n", F.posexplode(F.array_append("v", F.col("squares") + 2 * F.col("c") * F.col("runs") + F.col("m") * F.col("c") * F.col("c"))))
    sums = parts.groupBy("ticker", "feature", "n", "pos").agg(F.sum("col").alias("x"))
    sums = sums.groupBy("ticker", "feature", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ticker, feature, n, v in frame.itertuples(index=False):
                width, most = width_of(n), orders_of(n)
                tests = (None, None, None)
                if with_adf:
                    size = (most + 3) ** 2
                    t, lags = adf(n, v[width + 1 : width + 1 + size].reshape(most + 3, most + 3), v[width + 1 + size : -1])
                    tests = (t, lags, adf_p(t))
                out.append((ticker, feature, n, *tests, v[-1], bandwidth(n, v[: width + 1])))
            yield pd.DataFrame(out, columns=["ticker", "feature", "n_obs", "adf", "adf_lags", "adf_p", "squares", "kpss_lags"])

    return sums.mapInPandas(close, f"ticker {ticker}, feature string, n_obs int, adf double, adf_lags int, adf_p double, squares double, kpss_lags int")


def _tested(base: DataFrame, block: int, with_adf: bool) -> DataFrame:
    """Both tests from standardised series; the running sum is worked out in blocks, and meets itself kpss_lags + 1 rows on by row number, so no row number is hot."""
    rows = base.withColumn("__block", F.expr(f"rn div {block}"))
    totals = rows.groupBy(F.col("ticker").alias("__t"), F.col("feature").alias("__f"), F.col("__block").alias("__b")).agg(F.sum("z").alias("__total"))
    before = F.sum("__total").over(Window.partitionBy("__t", "__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("__t", "__f", "__b", F.coalesce(before, F.lit(0.0)).alias("__c"))
    run = F.sum("z").over(Window.partitionBy("ticker", "feature", "__block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("s", run).join(totals, F.col("ticker").eqNullSafe(F.col("__t")) & (F.col("feature") == F.col("__f")) & (F.col("__block") == F.col("__b")))
    rows = rows.select("ticker", "feature", "rn", (F.col("s") + F.col("__c")).alias("s"))
    closed = _closed(base, block, with_adf)
    named = closed.select(F.col("ticker").alias("__t"), F.col("feature").alias("__f"), F.struct(*closed.columns[2:]).alias("c"))
    rows = rows.join(named, F.col("ticker").eqNullSafe(F.col("__t")) & (F.col("feature") == F.col("__f")))
    ends = F.explode(F.array(F.struct(F.col("rn").alias("rn"), F.col("s").alias("s")), F.struct((F.col("rn") + F.col("c.kpss_lags") + 1).alias("rn"), (-F.col("s")).alias("s"))))
    sums = rows.select("ticker", "feature", "c", ends.alias("e")).groupBy("ticker", "feature", "c", "e.rn").agg(F.sum("e.s").alias("near"))
    out = sums.groupBy("ticker", "feature", "c").agg(F.sum(F.col("near") * F.col("near")).alias("near")).select("ticker", "feature", "c.*", "near")
    stat = F.when(F.col("near") > 0, F.col("squares") / F.col("n_obs") * (F.col("kpss_lags") + 1) / F.col("near")).otherwise(float("inf"))
    out = out.withColumn("kpss", stat).withColumn("kpss_p", kpss_p(F.col("kpss")))
    return out.withColumn("kpss_stationary", F.col("kpss_p") > 0.05)


def kpss_panel(rows: DataFrame, columns: tuple[str, ...], entity: str = "ticker", order: str = "date", most: int | None = MAX_OBS, block: int = blocks.ROWS) -> DataFrame:
    """One row per (ticker, feature): KPSS's level statistic, its lags and p-value. Series as in :func:`standardised`."""
    return _tested(standardised(rows, columns, entity, order, most, block), block, False).select(*KPSS_COLUMNS)


def panel(rows: DataFrame, columns: tuple[str, ...], entity: str = "ticker", order: str = "date", most: int | None = MAX_OBS, block: int = blocks.ROWS) -> DataFrame:
    """One row per (ticker, feature): both tests and a verdict. Series as in :func:`standardised`; ``block`` rows of one are a task's unit,
    at least as many as the greatest lag order and one more."""
    got = _tested(standardised(rows, columns, entity, order, most, block), block, True)
    a, k = F.col("adf_stationary"), F.col("kpss_stationary")
    verdict = F.when(a & k, "stationary").when(~a & ~k, "non-stationary").when(a, "difference-stationary").otherwise("trend-stationary")
    got = got.withColumn("adf_stationary", F.col("adf_p") < 0.05).withColumn("verdict", verdict)
    return got.select("ticker", "feature", "n_obs", "adf", "adf_lags", "adf_p", "adf_stationary", "kpss", "kpss_lags", "kpss_p", "kpss_stationary", "verdict")
