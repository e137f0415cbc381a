"""Walk-forward position ledger as window expressions over ``signals(ticker, window_id, i, date, close, pred, target)``.

Everything is partitioned by (ticker, window_id), which one exchange by ticker serves, then by ticker.
A maximal run of Buy rows is one position, sold at the first other row after it (or the window's
last row). The row that sells is spent: it takes no decision. A Hold row holds half a position for a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

KEY = ("ticker", "window_id")
COST_MODELS = ("on_change", "per_day")


def check_config(cost_model: str, cost: float, train: int, test: int, step: int) -> None:
    if cost_model not in COST_MODELS:
        raise ValueError(f"unknown cost model {cost_model!r}: one of {', '.join(COST_MODELS)}")
    if cost < 0 or min(train, test, step) < 1:
        raise ValueError("cost must not be negative; train, test and step must be positive")


def _annotated(signals: DataFrame) -> DataFrame:
    """Every row with its neighbours, its run, and where and at what price that run is sold: windows on one partitioning, no join."""
    w = Window.partitionBy(*KEY).orderBy("i")
    buy = F.col("pred") == "Buy"
    df = signals.withColumns({"__n": F.count("*").over(Window.partitionBy(*KEY)), "__before": F.lag("pred").over(w), "__before2": F.lag("pred", 2).over(w), "__next": F.lead("pred").over(w), "__next_close": F.lead("close").over(w), "__place": F.row_number().over(w) - 1})
    starts = buy & ~F.coalesce(F.col("__before") == "Buy", F.lit(False))
    df = df.withColumns({"__starts": starts, "__spent": ~buy & F.coalesce(F.col("__before") == "Buy", F.lit(False))})
    df = df.withColumn("__run", F.sum(F.col("__starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = (F.col("pred") == "Buy") | F.col("__spent")  # a run and the row that sells it
    run = Window.partitionBy(*KEY, "__run")
    sold = F.max(F.when(inside, F.struct("__place", "date", "close"))).over(run)
    return df.withColumn("__sold", sold)


def _net(cost: float):
    return ratio(F.col("__sold.close") - F.col("close"), F.col("close")) - 2 * cost


def trades(signals: DataFrame, cost: float = 0.001) -> DataFrame:
    """One row a Buy run: entry and exit row, dates, prices, net return and days held."""
    rows = _annotated(signals).where("__starts")
    return rows.select(
        *KEY, F.col("__place").alias("entry_i"), F.col("__sold.__place").alias("exit_i"), F.col("date").alias("entry_date"), F.col("__sold.date").alias("exit_date"), F.col("close").alias("entry_price"), F.col("__sold.close").alias("exit_price"),
        F.col("__n").alias("n_rows"), _net(cost).alias("net_return"), (F.col("__sold.__place") - F.col("__place")).alias("holding_days"),
    )


def points(signals: DataFrame, cost: float = 0.001, cost_model: str = "on_change") -> DataFrame:
    """The decisions that make the equity curve: (ticker, window_id, i, date, kind, r); r is the change of capital.

    Buy: the whole run, at its first row. Hold: half of the next row's change less costs, twice the
    cost a day, or with ``on_change`` the cost on each change only. Avoid, or a Hold on the last row: 0.
    """
    if cost_model not in COST_MODELS:
        raise ValueError(f"unknown cost model {cost_model!r}")
    rows = _annotated(signals).where(F.col("__starts") | ((F.col("pred") != "Buy") & ~F.col("__spent")))
    change = ratio(F.col("__next_close") - F.col("close"), F.col("close"))
    if cost_model == "per_day":
        costs = F.lit(2 * cost)
    else:
        was = F.coalesce((F.col("__before") == "Hold") & ~F.coalesce(F.col("__before2") == "Buy", F.lit(False)), F.lit(False))
        stays = F.coalesce(F.col("__next") == "Hold", F.lit(False)) & (F.col("__place") + 2 < F.col("__n"))
        costs = F.when(was, 0.0).otherwise(cost) + F.when(stays, 0.0).otherwise(cost)
    r = F.when(F.col("pred") == "Buy", _net(cost)).when((F.col("pred") == "Hold") & F.col("__next_close").isNotNull(), 0.5 * (change - costs)).otherwise(0.0)
    return rows.select(*KEY, "i", "date", F.col("pred").alias("kind"), r.alias("r"))


def equity(decisions: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """The curve: ``seq`` within the ticker and ``value`` after each decision, across windows in order."""
    w = Window.partitionBy("ticker").orderBy("window_id", "i")
    value = F.product(1 + F.col("r")).over(w.rowsBetween(Window.unboundedPreceding, 0)) * capital
    return decisions.withColumns({"seq": F.row_number().over(w), "value": value})


def benchmark(signals: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Buy and hold, compounded over windows of at least two rows: (ticker, window_id, value)."""
    per = signals.groupBy(*KEY).agg(F.min_by("close", "i").alias("a"), F.max_by("close", "i").alias("b"), F.count("*").alias("n"))
    r = F.when(F.col("n") >= 2, ratio(F.col("b") - F.col("a"), F.col("a"))).otherwise(0.0)
    run = Window.partitionBy("ticker").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*KEY, (F.product(1 + r).over(run) * capital).alias("value"))


def window_results(signals: DataFrame, cost: float = 0.001, cost_model: str = "on_change") -> DataFrame:
    """Per window: first and last date, sum of returns in percent, Buy trades and how many won."""
    dates = signals.groupBy(*KEY).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    made = points(signals, cost, cost_model).groupBy(*KEY).agg((F.sum("r") * 100).alias("return_pct"), F.count_if(F.col("kind") == "Buy").alias("n_trades"), F.count_if((F.col("kind") == "Buy") & (F.col("r") > 0)).alias("n_wins"))
    return dates.join(made, list(KEY), "left").na.fill(0, ["return_pct", "n_trades", "n_wins"])


def curve_metrics(curve: DataFrame, capital: float = 10_000.0, also: tuple = ()) -> DataFrame:
    """Per ticker from its curve: final value, total return, Sharpe (of changes between points, times sqrt 252), worst drawdown in percent; ``also``: further aggregates of its rows."""
    w = Window.partitionBy("ticker").orderBy("seq")
    before = F.lag("value").over(w)
    peak = F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumns({"c": ratio(F.col("value"), before) - 1, "d": ratio(F.col("value") - peak, peak)})
    got = rows.groupBy("ticker").agg(F.max_by("value", "seq").alias("final_value"), F.avg("c").alias("m"), F.stddev_samp("c").alias("s"), F.count("c").alias("n_changes"), (F.min("d") * 100).alias("max_drawdown"), *also)
    sharpe = F.when((F.col("n_changes") > 1) & (F.col("s") > 0), ratio(F.col("m"), F.col("s")) * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return got.select("ticker", "final_value", (F.col("final_value") / capital - 1).alias("total_return"), sharpe.alias("sharpe"), F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"), "n_changes", *got.columns[len(got.columns) - len(also) :])


def metrics(signals: DataFrame, cost: float = 0.001, cost_model: str = "on_change", capital: float = 10_000.0, train: int = 500, test: int = 60, step: int = 60) -> DataFrame:
    """Per ticker: returns and benchmark, both also a year, Sharpe, drawdown, trades, win rate, signal accuracy.

    A year's return counts ``days``: the ticker's rows (``panel_rows``, which :func:`splits.walk_forward` gives) less one
    training window, as the whole of the rest is time in the market. Signals without ``panel_rows`` are taken to end with their last window.
    """
    check_config(cost_model, cost, train, test, step)
    bought = F.col("kind") == "Buy"
    counts = (F.count_if(bought).alias("n_trades"), F.count_if(bought & (F.col("r") > 0)).alias("n_wins"))
    curve = curve_metrics(equity(points(signals, cost, cost_model), capital), capital, counts)
    known = "panel_rows" in signals.columns
    per = signals.groupBy(*KEY).agg(
        F.min_by("close", "i").alias("a"), F.max_by("close", "i").alias("b"), F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("target")).alias("hits"), F.max("i").alias("last"), *([F.max("panel_rows").alias("rows")] if known else [])
    )
    held = F.when(F.col("n") >= 2, ratio(F.col("b") - F.col("a"), F.col("a"))).otherwise(0.0)
    days = F.max("rows") - train if known else (F.count("*") - 1) * step + F.max(F.when(F.col("window_id") == 0, F.col("last"))) + 1
    seen = per.groupBy("ticker").agg((F.product(1 + held) - 1).alias("benchmark_return"), ratio(F.sum("hits"), F.sum("n")).alias("accuracy"), days.cast("long").alias("days"))
    out = curve.join(seen, "ticker")
    a_year = F.when(F.col("days") > 0, 252 / F.col("days")).otherwise(1.0)
    yearly = {name: F.pow(1 + F.col(total), a_year) - 1 for name, total in (("annual_return", "total_return"), ("annual_benchmark", "benchmark_return"))}
    return out.withColumns(yearly | {"win_rate": ratio(F.col("n_wins"), F.col("n_trades"), 0.0), "excess_return": F.col("total_return") - F.col("benchmark_return")})


def random_entry_odds(signals: DataFrame, made: DataFrame, cost: float = 0.001) -> DataFrame:
    """``made`` (trades) with ``win_odds``: of all entries in the window held as long, the share that gains after both costs."""
    asked = made.select(*KEY, F.col("holding_days").alias("h"), "n_rows").distinct().where("h > 0 and h < n_rows")
    rows = signals.select(*KEY, (F.row_number().over(Window.partitionBy(*KEY).orderBy("i")) - 1).alias("p"), "close")
    enter = rows.join(asked, list(KEY)).withColumn("q", F.col("p") + F.col("h"))
    leave = rows.select(*KEY, F.col("p").alias("q"), F.col("close").alias("then"))
    odds = enter.join(leave, [*KEY, "q"]).groupBy(*KEY, "h").agg(F.avg((ratio(F.col("then") - F.col("close"), F.col("close")) - 2 * cost > 0).cast("double")).alias("win_odds"))
    return made.join(odds.withColumnRenamed("h", "holding_days"), [*KEY, "holding_days"], "left").na.fill(0.0, ["win_odds"])


def mean_curve(curve: DataFrame) -> DataFrame:
    """Curves as percent of their first value, shorter ones carried on at their last, averaged by position."""
    first = F.first("value").over(Window.partitionBy("ticker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.select("ticker", "seq", ((ratio(F.col("value"), first) - 1) * 100).alias("pct"))
    n = rows.agg(F.max("seq").alias("length"))
    last = rows.groupBy("ticker").agg(F.max("seq").alias("to"), F.max_by("pct", "seq").alias("pct")).crossJoin(F.broadcast(n))
    padded = last.where("to < length").select("ticker", F.explode(F.sequence(F.col("to") + 1, F.col("length"))).alias("seq"), "pct")
    return rows.union(padded).groupBy("seq").agg(F.avg("pct").alias("pct"), F.count("*").alias("n_curves"))


def summary(metric_rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of the metrics over tickers, pooled win rate, and tickers without a trade."""
    means = ("total_return", "annual_return", "sharpe", "max_drawdown", "benchmark_return", "annual_benchmark", "excess_return", "win_rate", "accuracy", "n_trades")
    return metric_rows.groupBy(*by).agg(
        F.count("*").alias("n_tickers"), *[F.avg(c).alias(f"mean_{c}") for c in means], ratio(F.sum("n_wins"), F.sum("n_trades"), 0.0).alias("pooled_win_rate"), F.count_if(F.col("n_trades") == 0).alias("n_without_trades")
    )


def curve_returns(curve: DataFrame) -> DataFrame:
    """(ticker, r): the changes between the points of each curve."""
    before = F.lag("value").over(Window.partitionBy("ticker").orderBy("seq"))
    return curve.select("ticker", ratio(F.col("value") - before, before).alias("r"))


def interval_signs(intervals: DataFrame) -> DataFrame:
    """One row: how many intervals (lower, upper) lie above 0, below it, include it, or are undefined."""
    lo, hi = F.col("lower"), F.col("upper")
    known = lo.isNotNull() & hi.isNotNull() & ~F.isnan(lo) & ~F.isnan(hi)
    above, below = known & (lo > 0), known & (hi < 0)
    return intervals.agg(F.count_if(above).alias("n_above"), F.count_if(below).alias("n_below"), F.count_if(known & ~above & ~below).alias("n_including"), F.count_if(~known).alias("n_undefined"))


def benchmark_points(signals: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """:func:`benchmark` as curves with ``seq`` from 1, a point a window, for :func:`mean_curve`."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("window_id"))
    return benchmark(signals, capital).select("ticker", place.alias("seq"), "value")


def combined_report(signals: DataFrame, cost: float = 0.001, capital: float = 10_000.0, train: int = 500, test: int = 60, step: int = 60) -> DataFrame:
    """One row for all tickers together.

    total_pct, benchmark_pct and excess_pct: means of the tickers' whole returns, and their difference. curve_pct and benchmark_curve_pct: where the two
    mean curves end, each curve in percent of its own first point. drawdown_points: the worst fall of the mean curve; its Sharpe with a
    95 % interval (null below four points); pooled win rate and trades.
    """
    from . import stats

    per = metrics(signals, cost, capital=capital, train=train, test=test, step=step)
    curve = mean_curve(equity(points(signals, cost), capital)).withColumn("value", 100 + F.col("pct")).withColumn("ticker", F.lit("all"))
    held = mean_curve(benchmark_points(signals, capital)).agg(F.max_by("pct", "seq").alias("benchmark_curve_pct"))
    run = Window.partitionBy("ticker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # one point a position: as long as one series
    falls = curve.withColumn("fall", F.col("value") - F.max("value").over(run)).agg(F.max_by("pct", "seq").alias("curve_pct"), F.min("fall").alias("drawdown_points"), F.count("*").alias("n_points"))
    sharpe = stats.sharpe_interval(curve_returns(curve), ("ticker",)).select("sharpe", "lower", "upper")
    pooled = per.agg((F.avg("total_return") * 100).alias("total_pct"), (F.avg("benchmark_return") * 100).alias("benchmark_pct"), ratio(F.sum("n_wins"), F.sum("n_trades"), 0.0).alias("pooled_win_rate"), F.sum("n_trades").alias("n_trades"))
    row = falls.join(sharpe, F.lit(True), "left").crossJoin(pooled).crossJoin(held)  # one row each
    enough = F.col("n_points") >= 4
    excess = (F.col("total_pct") - F.col("benchmark_pct")).alias("excess_pct")
    return row.select("total_pct", "benchmark_pct", excess, "curve_pct", "benchmark_curve_pct", "drawdown_points", "n_points", *[F.when(enough, F.col(c)).alias(c) for c in ("sharpe", "lower", "upper")], "pooled_win_rate", "n_trades")
