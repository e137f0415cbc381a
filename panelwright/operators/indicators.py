"""Technical indicators and forward-return labels over panels (ticker, date, close, volume).

All windows count rows, not days, and run over ``ticker`` ordered by ``date``: one exchange and one
sort serve them all. Undefined values are null. With ``block``, a number of rows, a ticker is cut into blocks with a halo
(:mod:`.blocks`), so that a series of any length runs in many tasks; the results are the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from . import blocks

FEATURES = ("close_price", "daily_return", "ma_5", "ma_20", "ma_50", "volatility", "volume", "rsi", "macd")
MIN_ROWS = 80
BLOCK = 1024
LOOK_BACK = 50  #: rows that the windows of the features look back at most
BLOCKED = ("ticker", "__block")
Entity = str | tuple[str, ...]


def by(entity: Entity = "ticker", order: str = "date"):
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(order)


def last_rows(k: int, entity: Entity = "ticker", order: str = "date"):
    return by(entity, order).rowsBetween(-(k - 1), 0)


def daily_return(close: Column, entity: Entity = "ticker", order: str = "date") -> Column:
    before = F.lag(close).over(by(entity, order))
    return ratio(close - before, before)


def gain_loss(close: Column, entity: Entity = "ticker", order: str = "date") -> dict[str, Column]:
    """The rise and the fall since the row before, each 0 where there is none, and on the first row."""
    delta = close - F.lag(close).over(by(entity, order))
    return {"gain": F.coalesce(F.greatest(delta, F.lit(0.0)), F.lit(0.0)), "loss": F.coalesce(F.greatest(-delta, F.lit(0.0)), F.lit(0.0))}


def moving_average(x: Column, k: int, entity: Entity = "ticker", order: str = "date") -> Column:
    """Mean of the last k rows, null until there are k."""
    w = last_rows(k, entity, order)
    return F.when(F.count(x).over(w) == k, F.avg(x).over(w))


def moving_sd(x: Column, k: int, entity: Entity = "ticker", order: str = "date") -> Column:
    """Sample deviation of the last k values, null until there are k."""
    w = last_rows(k, entity, order)
    return F.when(F.count(x).over(w) == k, F.stddev_samp(x).over(w))


def with_row_number(df: DataFrame, entity: str = "ticker", order: str = "date") -> DataFrame:
    return df.withColumn("rn", F.row_number().over(by(entity, order)) - 1)


def _ema_length(alphas: list[float]) -> int:
    """Rows of a block in which no power of 1 - alpha overflows."""
    return min([BLOCK, *(max(1, int(230 / -math.log(1 - a))) for a in alphas)])


def with_ema(df: DataFrame, columns: dict[str, tuple[str, float]], entity: str = "ticker", order: str = "date", block: int | None = None) -> DataFrame:
    """Add exponential averages {name: (input, alpha)}: y0 = x0, y = (1 - alpha) * y_before + alpha * x. Needs ``rn``, and with ``block`` the rows' ``__block``.

    Within a block of at most BLOCK rows an average is a running sum with powers of 1 - alpha, which cannot
    overflow there; the value at a block's end is carried on. Where a whole block weighs less than a
    double can tell, which holds for alpha from 0.04 on, the last block's end is all that is carried, in the same window.
    Else a block is a map y -> p * y + q of what the average was before it; the maps are composed over a table with a row a block
    (:func:`.blocks.carries`) and joined back, so that no row holds more than its own numbers, whatever alpha and the length.
    """
    for n, (_, a) in columns.items():
        if not 0 < a <= 1:
            raise ValueError(f"alpha of {n} must lie above 0 and not above 1")
    df = df.withColumns({n: F.col(x) for n, (x, a) in columns.items() if a == 1})
    columns = {n: (x, a) for n, (x, a) in columns.items() if a < 1}
    if not columns:
        return df
    length = _ema_length([a for _, a in columns.values()])
    if block is None and all((1 - a) ** length < 2.0**-60 for _, a in columns.values()):
        return _ema_in_windows(df, columns, entity, order, length)
    return _ema_by_maps(df, columns, entity, order, length, block)


def _local_ema(columns: dict[str, tuple[str, float]], run) -> dict[str, Column]:
    return {f"__l_{n}": F.sum(F.col(x) * F.pow(F.lit(1 - a), -F.col("__place"))).over(run) * a * F.pow(F.lit(1 - a), F.col("__place")) for n, (x, a) in columns.items()}


def _ema_in_windows(df: DataFrame, columns: dict[str, tuple[str, float]], entity: str, order: str, length: int) -> DataFrame:
    whole = by(entity, order)
    df = df.withColumns({"__ema": F.expr(f"rn div {length}"), "__place": F.col("rn") % length})
    local = _local_ema(columns, Window.partitionBy(entity, "__ema").orderBy(order))
    df = df.withColumns(local)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    ends = {f"__c_{n}": F.last(F.when(F.col("__place") == length - 1, F.col(f"__l_{n}")), True).over(before) for n in columns}
    firsts = {f"__f_{n}": F.first(x).over(whole.rowsBetween(Window.unboundedPreceding, 0)) for n, (x, _) in columns.items()}
    df = df.withColumns(ends | firsts)
    out = {n: F.col(f"__l_{n}") + F.pow(F.lit(1 - a), F.col("__place") + 1) * F.coalesce(f"__c_{n}", f"__f_{n}") for n, (_, a) in columns.items()}
    return df.withColumns(out).drop("__ema", "__place", *local, *ends, *firsts)


def _ema_by_maps(df: DataFrame, columns: dict[str, tuple[str, float]], entity: str, order: str, length: int, block: int | None) -> DataFrame:
    names, alphas = list(columns), [a for _, a in columns.values()]
    per = -(-block // length) if block else 0
    seq, place = (f"(rn div {block}) * {per} + (rn % {block}) div {length}", f"(rn % {block}) % {length}") if block else (f"rn div {length}", f"rn % {length}")
    keys = [entity, *(["__block"] if block else []), "__ema"]  # what is dealt by block stays where it is
    df = df.withColumns({"__ema": F.expr(seq), "__place": F.expr(place)})
    local = _local_ema(columns, Window.partitionBy(*keys).orderBy(order))
    df = df.withColumns(local)
    ends = df.groupBy(*keys).agg(F.count("*").alias("n"), F.max_by(F.array(*local), "__place").alias("end"), F.min_by(F.array(*[F.col(x).cast("double") for x, _ in columns.values()]), "__place").alias("first"))
    p = F.array(*[F.pow(F.lit(1 - a), F.col("n")) for a in alphas])
    q = F.when(F.col("__ema") == 0, F.zip_with("end", F.zip_with(p, F.col("first"), lambda a, x: a * x), lambda e, c: e + c)).otherwise(F.col("end"))
    longest = df.groupBy(entity).agg(F.max("__ema").alias("m")).agg(F.max("m")).first()[0]
    past = blocks.carries(ends.select(F.col(entity).alias("e"), F.col("__ema").alias("seq"), p.alias("p"), q.alias("q")), len(names), (longest or 0) + 1)
    first = ends.where("__ema = 0").select(F.col(entity).alias("e"), F.lit(0).cast("long").alias("seq"), F.col("first").alias("carry"))
    carry = past.where("seq > 0").select("e", "seq", F.col("m.q").alias("carry")).union(first).select(F.col("e").alias("__e"), F.col("seq").alias("__seq"), F.col("carry").alias("__carry"))
    df = df.join(carry, F.col(entity).eqNullSafe(F.col("__e")) & (F.col("__ema") == F.col("__seq")))
    out = {n: F.col(f"__l_{n}") + F.pow(F.lit(1 - a), F.col("__place") + 1) * F.col("__carry")[i] for i, (n, a) in enumerate(zip(names, alphas))}
    return df.withColumns(out).drop("__e", "__seq", "__carry", "__ema", "__place", *local)


def indicators(prices: DataFrame, block: int | None = None, ahead: int = 0) -> DataFrame:
    """All rows with the nine FEATURES (null in the warm-up), ``rn`` and ``n_rows``; keeps ``close`` and ``date``. ``ahead``: also ``close_ahead``, the close so many rows on."""
    df = prices.withColumn("close_price", F.col("close"))
    if block:
        df, entity = blocks.cut(df, LOOK_BACK, ahead, rows=block), BLOCKED
    else:
        df, entity = with_row_number(df).withColumn("n_rows", F.count("*").over(Window.partitionBy("ticker"))), "ticker"
    close = F.col("close_price")
    moves = gain_loss(close, entity)
    df = df.withColumns(
        {
            "daily_return": daily_return(close, entity),
            "ma_5": moving_average(close, 5, entity),
            "ma_20": moving_average(close, 20, entity),
            "ma_50": moving_average(close, 50, entity),
            "__gain": moves["gain"],
            "__loss": moves["loss"],
        }
        | ({"close_ahead": F.lead("close", ahead).over(by(entity))} if ahead else {})
    )
    df = df.withColumn("volatility", moving_sd(F.col("daily_return"), 20, entity))
    if block:
        df = blocks.own(df)
    df = with_ema(df, {"__g": ("__gain", 1 / 14), "__l": ("__loss", 1 / 14), "__fast": ("close_price", 2 / 13), "__slow": ("close_price", 2 / 27)}, block=block)
    rs = ratio(F.col("__g"), F.col("__l"))
    rsi = F.when(F.col("__l") > 0, 100 - 100 / (1 + rs)).when(F.col("__g") > 0, F.lit(100.0))
    df = df.withColumns({"rsi": F.when(F.col("rn") >= 13, rsi), "macd": F.col("__fast") - F.col("__slow")})
    return df.drop("__gain", "__loss", "__g", "__l", "__fast", "__slow", "__block")


def features(prices: DataFrame, min_rows: int = MIN_ROWS, block: int | None = None) -> DataFrame:
    """:func:`indicators` of tickers with at least ``min_rows`` rows, without rows that have an undefined feature."""
    return indicators(prices, block).where(F.col("n_rows") >= min_rows).na.drop(subset=list(FEATURES))


def label(forward: Column, threshold: Column | float = 0.10) -> Column:
    """Above the threshold Buy, from 0 up to it Hold, below 0 Avoid, null without a forward return."""
    if isinstance(threshold, (int, float)):
        if threshold <= 0:
            raise ValueError("threshold must be positive")
        threshold = F.lit(float(threshold))
    return F.when(forward > threshold, "Buy").when(forward >= 0, "Hold").when(forward < 0, "Avoid")


def labelled(prices: DataFrame, horizon: int = 30, threshold: float = 0.10, min_rows: int = MIN_ROWS, block: int | None = None) -> DataFrame:
    """Features plus ``fwd_return`` (over ``horizon`` rows) and ``target``, in the same pass; rows without a future are dropped."""
    df = indicators(prices, block, horizon).withColumn("fwd_return", ratio(F.col("close_ahead") - F.col("close"), F.col("close"))).drop("close_ahead")
    df = df.where(F.col("n_rows") >= min_rows).na.drop(subset=[*FEATURES, "fwd_return"])
    return df.withColumn("target", label(F.col("fwd_return"), threshold))


def sequences(panel: DataFrame, length: int = 20, columns: tuple[str, ...] = FEATURES, block: int | None = None) -> DataFrame:
    """Each row with ``window``: the ``length`` rows of its ticker that end at it, as an array of structs; shorter ones are left out."""
    rows = blocks.cut(panel.withColumnsRenamed({"rn": "__rn", "n_rows": "__n"}), length - 1, rows=block) if block else panel
    out = rows.withColumn("window", F.collect_list(F.struct(*columns)).over(last_rows(length, BLOCKED if block else "ticker")))
    if block:
        out = blocks.own(out).drop("__block", "rn", "n_rows").withColumnsRenamed({"__rn": "rn", "__n": "n_rows"})
    return out.where(F.size("window") == length)


def latest(panel: DataFrame) -> DataFrame:
    """The last row of each ticker."""
    order = Window.partitionBy("ticker").orderBy(F.desc("date"))
    return panel.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def history(prices: DataFrame, rows: int = 90, change_rows: int = 21) -> DataFrame:
    """Per ticker: last close, ``price_change_30d`` (percent against ``change_rows`` rows earlier, 0 for short series), and arrays of the last ``rows`` dates and closes."""
    valid = prices.where(F.col("close").isNotNull() & ~F.isnan("close"))
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    tail = valid.withColumns({"__r": F.row_number().over(back), "__n": F.count("*").over(Window.partitionBy("ticker"))}).where(F.col("__r") <= max(rows, change_rows + 1))
    pair = F.array_sort(F.collect_list(F.when(F.col("__r") <= rows, F.struct("date", "close"))))
    got = tail.groupBy("ticker").agg(
        F.max(F.when(F.col("__r") == 1, F.col("close"))).alias("current_price"), F.max(F.when(F.col("__r") == change_rows + 1, F.col("close"))).alias("__then"), F.max("__n").alias("__n"), pair.alias("__p")
    )
    change = F.when(F.col("__n") > change_rows + 1, ratio(F.col("current_price") - F.col("__then"), F.col("__then")) * 100)
    return got.select("ticker", "current_price", F.coalesce(change, F.lit(0.0)).alias("price_change_30d"), F.transform("__p", lambda x: F.date_format(x["date"], "yyyy-MM-dd")).alias("dates"), F.col("__p.close").alias("prices"))


def rebased(df: DataFrame, value: str = "close", entity: str = "ticker", order: str = "date", base: float = 100.0) -> DataFrame:
    """``rebased``: the value as a multiple of the entity's first one, times ``base``."""
    first = F.first(value).over(by(entity, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("rebased", ratio(F.col(value), first) * base)


def drawdown(df: DataFrame, value: str = "close", entity: str = "ticker", order: str = "date", points: bool = False, block: int | None = None) -> DataFrame:
    """``peak`` so far and ``drawdown`` from it: relative, or with ``points`` the plain difference."""
    if block:
        held = blocks.cut(df.withColumnsRenamed({"rn": "__rn", "n_rows": "__n"}), 0, 0, entity, order, block).drop("__own")
        df = blocks.running_max(held, value, "peak", entity, order).drop("__block", "rn", "n_rows").withColumnsRenamed({"__rn": "rn", "__n": "n_rows"})
    else:
        df = df.withColumn("peak", F.max(value).over(by(entity, order).rowsBetween(Window.unboundedPreceding, 0)))
    fall = F.col(value) - F.col("peak")
    return df.withColumn("drawdown", fall if points else ratio(fall, F.col("peak")))


def history_gate(df: DataFrame, rows: int, warn_rows: int = 1000) -> DataFrame:
    """Per ticker: n_rows, whether it has the ``rows`` asked for, and the reason if not; short of ``warn_rows`` only warns."""
    n = df.groupBy("ticker").agg(F.count("*").alias("n_rows"))
    reason = F.when(F.col("n_rows") < rows, F.format_string(f"%d rows, needs {rows}", "n_rows"))
    return n.withColumns({"kept": F.col("n_rows") >= rows, "reason": reason, "short_history": F.col("n_rows") < warn_rows})


def enough_history(df: DataFrame, rows: int) -> DataFrame:
    """Rows of tickers that have at least ``rows`` of them."""
    return df.withColumn("__n", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("__n") >= rows).drop("__n")
