"""Registered queries over the driver's tables. Doubles are rounded to six decimals, so that sums may run in any order; dates are texts."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..operators import blocks, indicators, ledger, metrics, models, rules, splits, stationarity, stats, text
from ..sources import dims, folders, prices, tables

QUERIES = {}
TRAIN, TEST, STEP = 500, 60, 60
COST = 0.001
SEEDS = (1, 2, 3, 4, 5)


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c, kind in df.dtypes if kind == "double"} | {c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def panel(spark: SparkSession, d: str) -> DataFrame:
    return prices.bars_from_lines(spark, d)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return indicators.labelled(panel(spark, d))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three rule models on the labelled panel."""
    rows = labelled(spark, d)
    rsi = F.when(F.col("rsi") < 30, "Buy").when(F.col("rsi") > 70, "Avoid").otherwise("Hold")
    macd = F.when(F.col("macd") > 0, "Buy").otherwise("Avoid")
    picks = [("rsi", rsi), ("macd", macd), ("always_avoid", F.lit("Avoid"))]
    m = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), p.alias("y_pred")) for n, p in picks])).alias("m")
    return rows.select("ticker", "date", F.concat_ws("|", "ticker", F.date_format("date", "yyyy-MM-dd")).alias("row_id"), F.col("target").alias("y_true"), m).select("ticker", "date", "row_id", "y_true", "m.*")


def rule(rsi: str = "rsi"):
    return F.when(F.col(rsi) < 45, "Buy").when(F.col(rsi) > 60, "Avoid").otherwise("Hold")


def signals(spark: SparkSession, d: str) -> DataFrame:
    """The test sides of all walk-forward windows, with a signal by RSI bands."""
    rows = splits.walk_forward(labelled(spark, d), TRAIN, TEST, STEP).where("side = 'test'")
    return rows.select("ticker", "window_id", "i", "date", "close", rule().alias("pred"), "target", "panel_rows")


def stocks(spark: SparkSession, d: str) -> DataFrame:
    """The stock dimension: brands, numbered."""
    brand = read(spark, d, "part").select(F.col("p_brand").alias("ticker")).distinct()
    number = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    return brand.withColumns({"position": number, "sector": F.concat(F.lit("Sector "), (number % 5).cast("string")), "name": F.concat(F.lit("Maker "), F.element_at(F.array(*[F.lit(x) for x in ("Amber", "Basalt", "Cobalt", "Dolomite", "Energy")]), number % 5 + 1))})


def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Latest features of each stock with signal, change in percent, volatility in percent."""
    p = panel(spark, d)
    last = indicators.latest(indicators.features(p)).select("ticker", "rsi", "macd", (F.col("volatility") * 100).alias("volatility"), rule().alias("signal"))
    return last.join(indicators.history(p).select("ticker", "current_price", "price_change_30d"), "ticker").join(stocks(spark, d).select("ticker", "position", "sector"), "ticker")


def profiles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(
        k.cast("bigint").alias("investor_id"), (18 + k % 70).cast("int").alias("age"), F.col("c_acctbal").cast("double").alias("income"), (1 + k % 30).cast("int").alias("horizon"), (k % 31).cast("int").alias("experience"), (1 + k % 10).cast("int").alias("risk_score")
    )


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Five answers a customer, driven by a shared trait and a hash. Customers are spread first: a small file is one task, and what is grouped by respondent then stays in its partition."""
    item = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")
    people = blocks.spread(read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("respondent_id")), "respondent_id")
    rows = people.select("respondent_id", item)
    h = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("respondent_id").cast("string"), F.col("j").cast("string")).cast("binary")), 1, 6), 16, 10).cast("bigint")
    score = F.greatest(F.lit(1), F.least(F.lit(4), F.col("respondent_id") % 4 + h % 3)).cast("int")
    return rows.select("respondent_id", F.concat(F.lit("q"), F.col("j").cast("string")).alias("item_id"), score.alias("score"))


ITEMS = ("q0", "q1", "q2", "q3", "q4")


def wide_responses(spark: SparkSession, d: str) -> DataFrame:
    """A row a respondent, a column an item: plain maxima of the one answer there is, which are added up as rows come, where a pivot first groups by respondent and item."""
    return responses(spark, d).groupBy("respondent_id").agg(*[F.max(F.when(F.col("item_id") == q, F.col("score"))).alias(q) for q in ITEMS])


def investors(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with the risk category of the questionnaire."""
    return rules.questionnaire(responses(spark, d)).select(F.col("respondent_id").alias("investor_id"), F.col("category").alias("risk_category"))


def rated(spark: SparkSession, d: str) -> DataFrame:
    return rules.recommendations(investors(spark, d), snapshot(spark, d), rules.suitability_matrix(spark))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """User turns, every third one with a stock and a question put before it."""
    rows = read(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("message_id"), "text")
    k = (F.col("message_id") % 25 + 1).cast("string")
    ask = F.element_at(F.array(*[F.lit(x) for x in ("Why is it risky? ", "Compare with the rest: ", "Should I buy? ", "Tell me about ", "How is my portfolio? ")]), (F.col("message_id") % 5 + 1).cast("int"))
    return rows.select("message_id", F.when(F.col("message_id") % 3 == 0, F.concat(ask, F.lit("brand#"), k, F.lit(", "), F.col("text"))).otherwise(F.col("text")).alias("text"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Signal and rating of each stock for a balanced investor."""
    return rules.recommend(snapshot(spark, d).withColumn("risk_category", F.lit("Balanced")), rules.suitability_matrix(spark)).select("ticker", "rating", "signal")


REGIMES = (("first", "1995-01-01", "1996-12-31"), ("second", "1997-01-01", "1998-06-30"), ("third", "1998-07-01", "1999-12-31"), ("fourth", "2000-01-01", "2001-12-31"))


def regimes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGIMES), "regime string, a string, b string").select("regime", F.to_date("a").alias("start"), F.to_date("b").alias("end"))


# ---- labels first: the flagship


@query
def label_counts(spark, d):
    """Labels per stock."""
    return rounded(metrics.class_balance(labelled(spark, d), ("ticker",)))


# ---- A, B: sources and checks


@query
def price_panel(spark, d):
    return rounded(panel(spark, d))


@query
def price_scan(spark, d):
    """A1, A3: the panel stored by ticker and period, then a half-open date range and a ticker list of it, read by the filters."""
    path = folders.scratch(spark, "prices")
    prices.write(bars(spark, d), path, dt.date(1990, 1, 1), dt.date(2010, 1, 1))
    got = prices.read(spark, path, dt.date(1996, 1, 1), dt.date(1997, 1, 1), ["Brand#1", "Brand#2", "Brand#13"])
    return rounded(got.select("ticker", "date", "close", "volume"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    """The panel with all columns of a snapshot; those that it lacks are null."""
    p = panel(spark, d)
    return p.select(*[F.col(f.name) if f.name in p.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in prices.SCHEMA])


@query
def stored_periods(spark, d):
    """A2, A3: 1996 stored, then 1997 for some tickers, 1996 again (kept), the first half of 1997 of two tickers at twice the price, 1996 of one ticker refreshed; all read as one."""
    path, all_bars = folders.scratch(spark, "prices"), bars(spark, d)
    some = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
    dear = lambda k: all_bars.withColumn("close", F.col("close") * k)
    first, second, third = dt.date(1996, 1, 1), dt.date(1997, 1, 1), dt.date(1998, 1, 1)
    prices.write(all_bars, path, first, second)
    prices.write(all_bars.where(some % 2 == 0), path, second, third)
    prices.write(dear(5), path, first, second)
    prices.write(dear(2).where(some.isin(4, 7)), path, second, dt.date(1997, 7, 1))
    prices.write(dear(3).where(some == 5), path, first, second, refresh=True)
    return rounded(prices.read(spark, path, dt.date(1996, 6, 1), dt.date(1997, 10, 1)).select("ticker", "date", "close", "volume"))


@query
def required_columns(spark, d):
    """A5: a snapshot's bars, projected to the columns that every price table must have."""
    return rounded(prices.require(bars(spark, d)))


@query
def result_sink(spark, d):
    """Labels per stock, written as CSV and read back."""
    path, rows = folders.scratch(spark, "result"), rounded(metrics.class_balance(labelled(spark, d), ("ticker",)))
    tables.write_result(rows, path, "csv")
    return spark.read.schema(rows.schema).option("header", "true").csv(path)


@query
def profile_table(spark, d):
    """Profiles written as CSV and read back."""
    path = folders.scratch(spark, "profiles")
    tables.write_profiles(profiles(spark, d), path)
    return tables.read_profiles(spark, path)


@query
def price_normalised(spark, d):
    """A4: the adjusted close where there is one."""
    adj = F.when(F.dayofmonth("date") % 7 != 0, F.col("close") * 0.5)
    return rounded(prices.normalised(panel(spark, d).withColumn("Adj Close", adj)))


@query
def null_report(spark, d):
    """B1: rows lost to missing prices."""
    return prices.null_report(panel(spark, d).withColumn("close", F.when(F.dayofmonth("date") != 13, F.col("close"))))


@query
def history_gate(spark, d):
    """Which stocks have enough rows, and why not."""
    return indicators.history_gate(panel(spark, d), 1400)


@query
def sanitised(spark, d):
    """Undefined numbers as 0."""
    return rounded(indicators.indicators(panel(spark, d)).select("ticker", "date", finite("ma_50").alias("ma_50"), finite("rsi").alias("rsi"), finite("volatility").alias("volatility")), 4)


@query
def profile_validation(spark, d):
    """Every error of every profile."""
    p = profiles(spark, d).withColumns({"age": F.when(F.col("investor_id") % 11 != 0, F.col("age") + F.when(F.col("investor_id") % 13 == 0, 100).otherwise(0)), "income": F.round("income", 2)})
    e = rules.profile_errors(p)
    return e.select("investor_id", F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors"))


@query
def domain_checks(spark, d):
    """Risk categories and signals outside their domains."""
    rows = read(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("investor_id"), F.element_at(F.array(*[F.lit(x) for x in ("Balanced", "balanced", "Growth", "Unknown")]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("risk_category"))
    return rows.select("investor_id", rules.domain_error(F.col("risk_category"), "Risk_Category", rules.RISK_CATEGORIES).alias("error"))


@query
def lookups(spark, d):
    """Symbols in any case; unknown ones found out."""
    asked = read(spark, d, "part").select(F.when(F.col("p_partkey") % 10 == 0, F.lit("Nobody")).otherwise(F.lower("p_brand")).alias("asked"))
    got = tables.lookup(asked, stocks(spark, d), "asked")
    return got.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector"), "found").agg(F.count("*").alias("n"))


# ---- C: windows


@query
def daily_returns(spark, d):
    """C2."""
    return rounded(panel(spark, d).select("ticker", "date", indicators.daily_return(F.col("close")).alias("daily_return")))


@query
def moving_averages(spark, d):
    """C3."""
    c = F.col("close")
    return rounded(panel(spark, d).select("ticker", "date", *[indicators.moving_average(c, k).alias(f"ma_{k}") for k in (5, 20, 50)]))


@query
def gains_losses(spark, d):
    """C6."""
    return rounded(panel(spark, d).select("ticker", "date", *[c.alias(name) for name, c in indicators.gain_loss(F.col("close")).items()]))


@query
def ema(spark, d):
    """C7."""
    df = indicators.with_ema(indicators.with_row_number(panel(spark, d)), {"ema_12": ("close", 2 / 13), "ema_26": ("close", 2 / 27), "ema_wilder": ("close", 1 / 14)})
    return rounded(df.select("ticker", "date", "ema_12", "ema_26", "ema_wilder"))


@query
def rsi_macd(spark, d):
    """C8, C9, C4."""
    return rounded(indicators.indicators(panel(spark, d)).select("ticker", "date", "rsi", "macd", "volatility"), 4)


@query
def features(spark, d):
    """C10."""
    return rounded(indicators.features(panel(spark, d)).select("ticker", "date", "rn", *indicators.FEATURES), 4)


@query
def labelled_panel(spark, d):
    """C11 to C13, D1."""
    return rounded(labelled(spark, d).select("ticker", "date", "close_price", "rsi", "macd", "fwd_return", "target"), 4)


@query
def sequence_windows(spark, d):
    """C14: of each 20-row window its size, first and last close, sum of returns."""
    s = indicators.sequences(labelled(spark, d), 20)
    total = F.aggregate("window", F.lit(0.0), lambda a, w: a + w["daily_return"])
    return rounded(s.select("ticker", "date", F.size("window").alias("n"), F.col("window")[0]["close_price"].alias("first_close"), F.col("window")[19]["close_price"].alias("last_close"), total.alias("sum_return"), "target"))


@query
def latest_features(spark, d):
    """C15."""
    return rounded(indicators.latest(indicators.features(panel(spark, d))).select("ticker", "date", "close_price", "rsi", "macd", "volatility"))


@query
def price_history(spark, d):
    """C16, C17."""
    h = indicators.history(panel(spark, d))
    return rounded(h.select("ticker", "current_price", "price_change_30d", F.array_join("dates", ",").alias("dates"), F.aggregate("prices", F.lit(0.0), lambda a, x: a + x).alias("sum_prices"), F.size("prices").alias("n")))


@query
def rebased_prices(spark, d):
    """C18."""
    return rounded(indicators.rebased(panel(spark, d)).select("ticker", "date", "rebased"))


@query
def drawdowns(spark, d):
    """C20."""
    return rounded(indicators.drawdown(panel(spark, d)).select("ticker", "date", "peak", "drawdown"))


@query
def worst_drawdowns(spark, d):
    """Relative and in points of a percent curve."""
    r = indicators.rebased(panel(spark, d))
    a = indicators.drawdown(r).groupBy("ticker").agg((F.min("drawdown") * 100).alias("relative"))
    b = indicators.drawdown(r, "rebased", points=True).groupBy("ticker").agg(F.min("drawdown").alias("points"))
    return rounded(a.join(b, "ticker"))


@query
def blocked_panel(spark, d):
    """C2 to C13 in blocks of 256 rows with a halo, as one long series would be."""
    return rounded(indicators.labelled(panel(spark, d), block=256).select("ticker", "date", "ma_5", "ma_20", "ma_50", "volatility", "rsi", "macd", "fwd_return", "target"), 4)


@query
def blocked_sequences(spark, d):
    """C14 in blocks: of each 20-row window its size, first close and sum of returns."""
    s = indicators.sequences(indicators.labelled(panel(spark, d), block=300), 20, block=200)
    total = F.aggregate("window", F.lit(0.0), lambda a, w: a + w["daily_return"])
    return rounded(s.select("ticker", "date", F.size("window").alias("n"), F.col("window")[0]["close_price"].alias("first_close"), total.alias("sum_return")))


@query
def long_series(spark, d):
    """C3, C7, C20 on one series with a row an event, in blocks of 1,024 rows: an average of alpha 0.001 among others."""
    line = read(spark, d, "events").select(F.lit("all").alias("ticker"), F.col("event_id").alias("pos"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("x"))
    block = 1024
    df = blocks.cut(line, 19, order="pos", rows=block)
    df = blocks.own(df.withColumn("ma_20", indicators.moving_average(F.col("x"), 20, indicators.BLOCKED, "pos")))
    df = indicators.with_ema(df, {"slow": ("x", 0.001), "quick": ("x", 0.6)}, order="pos", block=block)
    df = indicators.drawdown(df, "slow", order="pos", points=True, block=block)
    return rounded(df.select("pos", "rn", "ma_20", "slow", "quick", "peak", "drawdown"), 4)


@query
def date_positions(spark, d):
    """C22."""
    return rounded(splits.date_index(panel(spark, d)).select("date", F.col("pos").cast("int").alias("pos")))


@query
def matrix_monotone(spark, d):
    """Violations of the ratings that all investors have of all stocks, one pair left out and one rated too low."""
    m = rated(spark, d).select("risk_category", "signal", "rating", "explanation").distinct()
    worse = m.withColumn("rating", F.when((F.col("risk_category") == "Growth") & (F.col("signal") == "Hold"), "Not Suitable").otherwise(F.col("rating"))).where("not (risk_category = 'Balanced' and signal = 'Avoid')")
    return rules.matrix_violations(worse)


@query
def purged_split(spark, d):
    """C30."""
    out, _ = splits.purged_split(labelled(spark, d), 0.2, 30)
    return rounded(out.groupBy("side").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")))


@query
def row_cut_split(spark, d):
    """C31."""
    return rounded(splits.row_cut_split(labelled(spark, d), 0.8, 60).groupBy("side").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")))


@query
def stratified_split(spark, d):
    """The side of every row."""
    return rounded(splits.stratified_split(labelled(spark, d)).select("ticker", "date", "target", "side"))


@query
def walk_forward(spark, d):
    """C33, D6."""
    w = splits.walk_forward(panel(spark, d), TRAIN, TEST, STEP)
    return rounded(w.groupBy("ticker", "window_id", "side").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")))


@query
def regime_split(spark, d):
    """C34, D5."""
    return rounded(splits.regime_split(labelled(spark, d), regimes(spark)).groupBy("regime", "side").agg(F.count("*").alias("n"), F.max("date").alias("last")))


@query
def trailing_validation(spark, d):
    """C35."""
    return rounded(splits.trailing_validation(labelled(spark, d)).groupBy("ticker", "side").agg(F.count("*").alias("n"), F.min("date").alias("first")))


# ---- E: metrics


@query
def profile_columns(spark, d):
    """E2."""
    return rounded(metrics.profile(indicators.indicators(panel(spark, d)), ("close_price", "daily_return", "ma_50", "rsi", "macd")))


@query
def correlations(spark, d):
    """E2."""
    return rounded(metrics.correlations(labelled(spark, d), ("daily_return", "volatility", "rsi", "macd", "fwd_return")))


@query
def sectors(spark, d):
    """E3."""
    return tables.sectors(stocks(spark, d)).select("sector", F.array_join("tickers", ",").alias("tickers"))


@query
def model_scores(spark, d):
    """E4, E7."""
    return rounded(metrics.scores(predictions(spark, d)))


@query
def confusion(spark, d):
    """E5."""
    return metrics.confusion_matrix(predictions(spark, d))


@query
def class_report(spark, d):
    """E6."""
    return rounded(metrics.class_report(predictions(spark, d)))


@query
def best_model(spark, d):
    """E8, K3."""
    return rounded(metrics.best_model(metrics.scores(predictions(spark, d)), ("always_avoid",)))


@query
def buy_recall(spark, d):
    """E9."""
    return rounded(metrics.class_recall(predictions(spark, d)))


@query
def score_stability(spark, d):
    """Over stocks in the place of seeds."""
    return rounded(metrics.seed_stability(metrics.scores(predictions(spark, d), ("model", "ticker")).select("model", "accuracy", "f1_macro")))


@query
def seed_stability(spark, d):
    """The drawn baselines over five seeds."""
    split, _ = splits.purged_split(labelled(spark, d))
    runs = [metrics.baselines(split, seed).withColumn("seed", F.lit(seed)).where("model <> 'majority'") for seed in SEEDS]
    rows = metrics.scores(functools.reduce(DataFrame.unionByName, runs), ("model", "seed"))
    return rounded(metrics.seed_stability(rows))


@query
def comparable_scores(spark, d):
    """Only rows that a 20-row window ends at."""
    rows = indicators.sequences(labelled(spark, d), 20).select(F.concat_ws("|", "ticker", F.date_format("date", "yyyy-MM-dd")).alias("row_id"))
    return rounded(metrics.scores(metrics.comparable(predictions(spark, d), rows)).select("model", "n_test", "accuracy"))


# ---- F: rules


@query
def risk_classes(spark, d):
    """F1, F12."""
    p = profiles(spark, d)
    return p.select("investor_id", rules.risk_class(*[F.col(c) for c in ("age", "horizon", "experience", "risk_score")]).alias("risk_class"))


@query
def questionnaire(spark, d):
    """F2, D7, B9."""
    q = rules.questionnaire(responses(spark, d).where("respondent_id % 17 <> 0 or item_id <> 'q3'"))
    return q.select("respondent_id", "total", "complete", "category", F.col("breakdown")["q1"].alias("q1"))


@query
def questionnaire_report(spark, d):
    """what a respondent is told: the category, its text, and every answer by item."""
    q = rules.questionnaire(responses(spark, d).where("respondent_id % 17 <> 0 or item_id <> 'q3'"))
    parts = F.array_join(F.transform(F.array_sort(F.map_keys("breakdown")), lambda k: F.concat(k, F.lit("="), F.col("breakdown")[k].cast("string"))), ",")
    return q.select("respondent_id", "total", "category", rules.category_text(F.col("category")).alias("description"), parts.alias("breakdown"))


@query
def band_sensitivity(spark, d):
    """F11."""
    totals = responses(spark, d).groupBy("respondent_id").agg(F.sum("score").cast("int").alias("total")).groupBy("total").agg(F.count("*").alias("n"))
    return rounded(rules.band_sensitivity(totals))


@query
def suitability(spark, d):
    """Errors as values."""
    k = F.col("c_custkey")
    rows = read(spark, d, "customer").select(
        k.cast("bigint").alias("investor_id"), F.element_at(F.array(*[F.lit(x) for x in ("Balanced", "", "Growth", "growth", "Conservative", "Aggressive")]), (k % 6 + 1).cast("int")).alias("risk_category"), F.element_at(F.array(*[F.lit(x) for x in ("Buy", "Hold", "Avoid", "", "Sell")]), (k % 5 + 1).cast("int")).alias("signal")
    )
    return rules.recommend(rows, rules.suitability_matrix(spark)).select("investor_id", "rating", F.substring("error", 1, 24).alias("error"))


@query
def recommendations(spark, d):
    """Every investor with every stock."""
    return rounded(rated(spark, d).select("investor_id", "ticker", "rating", "rank", "signal", "volatility"))


@query
def recommendation_records(spark, d):
    """the whole record of each stock for a balanced investor, with its last dates and prices."""
    past = indicators.history(panel(spark, d)).select("ticker", "dates", "prices")
    rows = rules.recommend(snapshot(spark, d).join(past, "ticker").withColumn("risk_category", F.lit("Balanced")), rules.suitability_matrix(spark))
    digits = {"current_price": 2, "price_change_30d": 2, "rsi": 1, "macd": 2, "volatility": 2}
    total = F.aggregate("prices", F.lit(0.0), lambda a, x: a + x)
    return rows.select("ticker", "signal", "rating", "explanation", *[F.round(c, k).alias(c) for c, k in digits.items()], F.array_join("dates", ",").alias("dates"), F.size("prices").alias("n_prices"), F.round(total, 6).alias("sum_prices"))


@query
def recommendation_json(spark, d):
    """L json: each stock's record for a balanced investor as one JSON text."""
    r = facts(spark, d)
    return r.select("ticker", F.to_json(F.struct("ticker", "signal", F.struct("rating").alias("suitability"))).alias("record"))


@query
def best_picks(spark, d):
    """F8."""
    return rules.best_picks(investors(spark, d), snapshot(spark, d), rules.suitability_matrix(spark)).select("investor_id", "ticker", "signal")


@query
def best_compared(spark, d):
    """F9."""
    return rules.best_in_comparison(rated(spark, d), ["Brand#1", "Brand#7", "Brand#12"])


@query
def overview(spark, d):
    """E13."""
    o = rules.overview(rated(spark, d))
    return rounded(o.select("investor_id", "n_buy", "n_hold", "n_avoid", F.array_join("suitable", ",").alias("suitable"), F.array_join("caution", ",").alias("caution"), "mean_volatility", "sentiment"))


@query
def comparison(spark, d):
    """F5."""
    return rules.compare(snapshot(spark, d), ["Brand#1", "Brand#7", "Brand#12"])


@query
def comparison_table(spark, d):
    """metrics by stock."""
    got = rules.comparison_table(snapshot(spark, d), ["Brand#1", "Brand#7"], ("current_price", "price_change_30d", "rsi", "macd", "volatility"))
    return rounded(got.select("metric", F.col("`Brand#1`").alias("brand_1"), F.col("`Brand#7`").alias("brand_7")))


@query
def risk_bands(spark, d):
    """F6."""
    return rules.bands(snapshot(spark, d)).select("ticker", "risk_level", "rsi_zone", "trend_explained", "trend_assessed")


@query
def pros_cons(spark, d):
    """F7."""
    r = rules.pros_cons(rules.recommend(snapshot(spark, d).withColumn("risk_category", F.lit("Balanced")), rules.suitability_matrix(spark)))
    return r.select("ticker", F.array_join("pros", ", ").alias("pros"), F.array_join("cons", ", ").alias("cons"))


@query
def info_cards(spark, d):
    """F13."""
    r = rules.recommend(snapshot(spark, d).where("position % 3 <> 0").withColumn("risk_category", F.lit("Growth")), rules.suitability_matrix(spark))
    return rounded(rules.info_card(stocks(spark, d), r).select("ticker", "sector", "analysed", "current_price", "signal", "rating"))


# ---- H: ledger


@query
def ledger_trades(spark, d):
    """H1 to H3."""
    return rounded(ledger.trades(signals(spark, d), COST).select("ticker", "window_id", "entry_date", "exit_date", "net_return", "holding_days"))


@query
def ledger_points(spark, d):
    """H5."""
    return rounded(ledger.points(signals(spark, d), COST))


@query
def ledger_points_per_day(spark, d):
    """H5 with costs a day."""
    return rounded(ledger.points(signals(spark, d), COST, "per_day"))


@query
def equity_curve(spark, d):
    """H6."""
    return rounded(ledger.equity(ledger.points(signals(spark, d), COST)).select("ticker", "window_id", "i", "seq", "value"), 4)


@query
def benchmark_curve(spark, d):
    """H7."""
    return rounded(ledger.benchmark(signals(spark, d)), 4)


@query
def window_results(spark, d):
    """H8."""
    return rounded(ledger.window_results(signals(spark, d), COST))


@query
def backtest_metrics(spark, d):
    """H9 to H13."""
    return rounded(ledger.metrics(signals(spark, d), COST))


@query
def backtest_summary(spark, d):
    """E10 to E12."""
    return rounded(ledger.summary(ledger.metrics(signals(spark, d), COST)))


@query
def random_entry_odds(spark, d):
    """H4, D12."""
    s = signals(spark, d)
    return rounded(ledger.random_entry_odds(s, ledger.trades(s, COST), COST).select("ticker", "window_id", "entry_date", "holding_days", "win_odds"))


@query
def mean_curve(spark, d):
    """E14, H14."""
    return rounded(ledger.mean_curve(ledger.equity(ledger.points(signals(spark, d), COST))))


@query
def benchmark_mean_curve(spark, d):
    """The curves of buy and hold, averaged."""
    return rounded(ledger.mean_curve(ledger.benchmark_points(signals(spark, d))))


@query
def holding_days(spark, d):
    """E16."""
    return rounded(ledger.trades(signals(spark, d), COST).groupBy("ticker").agg(F.percentile("holding_days", F.lit(0.5)).alias("median_days"), F.avg("holding_days").alias("mean_days"), F.count("*").alias("n_trades")))


@query
def combined_report(spark, d):
    """All stocks as one."""
    return rounded(ledger.combined_report(signals(spark, d), COST), 4)


@query
def interval_signs(spark, d):
    """Sharpe intervals of the stocks' curves by sign."""
    curve = ledger.equity(ledger.points(signals(spark, d), COST))
    return ledger.interval_signs(stats.sharpe_interval(ledger.curve_returns(curve), ("ticker",)))


# ---- I: statistics


@query
def win_intervals(spark, d):
    """I1, I0."""
    got = ledger.trades(signals(spark, d), COST).groupBy("ticker").agg(F.count_if(F.col("net_return") > 0).alias("k"), F.count("*").alias("n"))
    got = got.withColumn("ci", stats.wilson(F.col("k"), F.col("n")))
    return rounded(got.select("ticker", "k", "n", F.col("ci.estimate").alias("estimate"), F.col("ci.lower").alias("lower"), F.col("ci.upper").alias("upper"), F.col("ci.width").alias("width"), stats.excludes(F.col("ci"), 0.5).alias("excludes_half")))


@query
def chance_matched(spark, d):
    """I3."""
    s = signals(spark, d)
    t = ledger.random_entry_odds(s, ledger.trades(s, COST), COST).withColumn("won", F.col("net_return") > 0)
    return rounded(stats.chance_matched(t, ("ticker",)).select("ticker", "k", "n", "expected", "z"))


@query
def mcnemar(spark, d):
    """I4, D10."""
    return rounded(stats.mcnemar(predictions(spark, d)).select("a", "b", "only_a", "only_b", "statistic", "leader"))


@query
def anova(spark, d):
    """Returns by sector, within each label."""
    rows = labelled(spark, d).join(stocks(spark, d).select("ticker", "sector"), "ticker")
    return rounded(stats.anova(rows, "sector", "daily_return", ("target",)).select("target", "k", "n", "f"))


@query
def kruskal(spark, d):
    """Event values by type."""
    rows = read(spark, d, "events").select("event_type", F.round(F.col("value").cast("double"), 1).alias("v"))
    return rounded(stats.kruskal(rows, "event_type", "v").select("k", "n", "h"))


@query
def tukey(spark, d):
    """I7."""
    rows = labelled(spark, d).join(stocks(spark, d).select("ticker", "sector"), "ticker")
    return rounded(stats.tukey(rows, "sector", "fwd_return").select("a", "b", "difference", "q"))


@query
def sharpe_intervals(spark, d):
    """I8."""
    r = panel(spark, d).select("ticker", indicators.daily_return(F.col("close")).alias("r"))
    return rounded(stats.sharpe_interval(r, ("ticker",)))


@query
def mean_return_tests(spark, d):
    """I9."""
    r = panel(spark, d).select("ticker", indicators.daily_return(F.col("close")).alias("r"))
    return rounded(stats.one_sample_t(r, ("ticker",), "r").select("ticker", "n", "mean", "sd", "t"))


@query
def paired_return_tests(spark, d):
    """Each stock against Brand#1 on common dates."""
    r = panel(spark, d).select("ticker", "date", indicators.daily_return(F.col("close")).alias("r"))
    one, rest = r.where("ticker = 'Brand#1'").select("date", "r"), r.where("ticker <> 'Brand#1'")
    return rounded(stats.paired_t(rest, one, ("date",), "r", ("ticker",)).select("ticker", "n", "mean", "t"))


@query
def sample_sizes(spark, d):
    """Observations for each stock's win rate against a half."""
    got = ledger.trades(signals(spark, d), COST).groupBy("ticker").agg(F.avg((F.col("net_return") > 0).cast("double")).alias("p"))
    p = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("p")))
    return rounded(got.select("ticker", "p", stats.sample_size(p, p - 0.5001).alias("needed")))


@query
def cronbach(spark, d):
    """I15 by cohort."""
    w = wide_responses(spark, d).withColumn("cohort", F.col("respondent_id") % 5)
    return rounded(stats.cronbach(w, ITEMS, ("cohort",)))


@query
def item_analysis(spark, d):
    """I16, B7."""
    return rounded(stats.item_analysis(wide_responses(spark, d), ITEMS))


@query
def response_matrices(spark, d):
    """Answers by cohort, some out of range, one cohort of one, one without variance."""
    w = wide_responses(spark, d).withColumn("cohort", F.when(F.col("respondent_id") == 7, 9).otherwise(F.col("respondent_id") % 5))
    w = w.withColumn("q2", F.when(F.col("respondent_id") % 20 == 0, 5).otherwise(F.col("q2")))
    w = w.withColumns({q: F.when(F.col("cohort") == 3, F.lit(2)).otherwise(F.col(q)) for q in ITEMS})
    return rules.response_matrix_errors(w, ITEMS, ("cohort",)).select("cohort", "n", "n_bad", F.array_join("errors", "; ").alias("errors"))


@query
def p_values(spark, d):
    """The tails, rows only."""
    rows = labelled(spark, d).join(stocks(spark, d).select("ticker", "sector"), "ticker")
    a = stats.anova(rows, "sector", "daily_return").select(F.lit("anova").alias("test"), "p_value")
    k = stats.kruskal(rows, "sector", "rsi").select(F.lit("kruskal").alias("test"), "p_value")
    m = stats.mcnemar(predictions(spark, d)).select(F.concat_ws(" ", F.lit("mcnemar"), "a", "b").alias("test"), "p_value")
    t = stats.tukey(rows, "sector", "fwd_return").select(F.concat_ws(" ", F.lit("tukey"), "a", "b").alias("test"), "p_value")
    won = ledger.trades(signals(spark, d), COST).groupBy("ticker").agg(F.count_if(F.col("net_return") > 0).alias("k"), F.count("*").alias("n"))
    b = won.select(F.concat_ws(" ", F.lit("binomial"), "ticker").alias("test"), stats.binomial_two_sided("k", "n", F.lit(0.5)).alias("p_value"))
    ends = F.explode(F.array(*[F.struct(F.lit(f"feldt {x}").alias("test"), F.col(x).alias("p_value")) for x in ("lower", "upper")])).alias("x")
    f = stats.feldt(stats.cronbach(wide_responses(spark, d), ITEMS).select("alpha", "n"), 5).select(ends).select("x.*")
    c = stats.chance_matched(ledger.random_entry_odds(signals(spark, d), ledger.trades(signals(spark, d), COST), COST).withColumn("won", F.col("net_return") > 0), ("ticker",)).select(F.concat_ws(" ", F.lit("chance matched"), "ticker").alias("test"), "p_value")
    r = stats.one_sample_t(panel(spark, d).select("ticker", indicators.daily_return(F.col("close")).alias("r")), ("ticker",), "r").select(F.concat_ws(" ", F.lit("mean return"), "ticker").alias("test"), "p_value")
    return a.union(k).union(m).union(t).union(b).union(f).union(c).union(r)


@query
def bootstrap_mean(spark, d):
    """10,000 resamples of the mean forward return."""
    sums = {"s": F.col("fwd_return"), "n": F.lit(1)}
    return rounded(stats.bootstrap(labelled(spark, d), sums, F.col("s") / F.col("n"), ("ticker", "date"), 10_000))


@query
def bootstrap_median(spark, d):
    """I11, rows only: the median forward return, by a bag of little bootstraps."""
    return stats.little_bootstrap(labelled(spark, d), "fwd_return", stats.weighted_median, ("ticker", "date"))


@query
def stationarity_panel(spark, d):
    """I18 to I20, rows only."""
    return stationarity.panel(indicators.features(panel(spark, d)), ("close_price", "daily_return", "rsi"))


@query
def kpss_tests(spark, d):
    """KPSS of whole series, none thinned."""
    return rounded(stationarity.kpss_panel(indicators.features(panel(spark, d)), ("close_price", "daily_return", "rsi"), most=None))


# ---- J: texts


@query
def message_intents(spark, d):
    """J1, J2, D9."""
    return text.classified(messages(spark, d), stocks(spark, d)).select("message_id", F.array_join("tickers", ",").alias("tickers"), "intent")


def listed_messages(spark: SparkSession, d: str) -> DataFrame:
    """User turns, every second one with a listed ticker, some as a hash tag, and a question put before it."""
    rows = read(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("message_id"), "text")
    asked = rows.withColumn("position", (F.col("message_id") % 100 + 1).cast("int")).join(dims.extended(spark).select("ticker", "position"), "position")
    ask = F.element_at(F.array(*[F.lit(x) for x in ("Is it risky, ", "Compare with ", "Why is it suitable? ", "Tell me about ", "")]), (F.col("message_id") % 5 + 1).cast("int"))
    tag = F.when(F.col("message_id") % 6 == 0, "#").otherwise("")
    return asked.select("message_id", F.when(F.col("message_id") % 2 == 0, F.concat(ask, tag, F.lower("ticker"), F.lit("? "), F.col("text"))).otherwise(F.col("text")).alias("text"))


@query
def listed_intents(spark, d):
    """The extended universe, tickers with punctuation among them."""
    return text.classified(listed_messages(spark, d), dims.extended(spark)).select("message_id", F.array_join("tickers", ",").alias("tickers"), "intent")


@query
def message_gate(spark, d):
    """J3."""
    rows = text.classified(messages(spark, d), stocks(spark, d))
    category = F.when(F.col("message_id") % 2 == 0, "Balanced").when(F.col("message_id") % 7 == 0, "Wild")
    return text.gated(rows.withColumn("risk_category", category), rules.RISK_CATEGORIES).select("message_id", "intent", "risk_category", "answerable")


@query
def guard_verdicts(spark, d):
    """Templated summaries of all stock pairs."""
    f = facts(spark, d)
    cases = text.guard_cases(f)
    return text.guard(cases, f).select("summary_id", "contradicts", "accepted")


@query
def guard_performance(spark, d):
    """J6."""
    f = facts(spark, d)
    cases = text.guard_cases(f)
    got = text.guard_performance(text.guard(cases, f))
    ci = stats.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return rounded(got.withColumns({"recall_lower": ci["lower"], "recall_upper": ci["upper"]}))


# ---- G: models, rows only


@query
def naive_baselines(spark, d):
    """G6."""
    split, _ = splits.purged_split(labelled(spark, d))
    return rounded(metrics.scores(metrics.baselines(split)))


@query
def trained_models(spark, d):
    """G1 to G5, G7."""
    out, _ = models.train_and_compare(labelled(spark, d))
    return metrics.comparison(metrics.scores(out))


@query
def model_round_trip(spark, d):
    """A model fitted, saved and loaded again: test rows, and whether both predict the same for all."""
    split, _ = splits.purged_split(labelled(spark, d))
    path, test = folders.scratch(spark, "model"), split.where("side = 'test'")
    model, scale = models.fit(split.where("side = 'train'"), "lr")
    models.save(model, scale, spark, path)
    before, after = (models.predict(test, *m).select("ticker", "date", "y_pred") for m in ((model, scale), models.load(spark, path)))
    return test.agg(F.count("*").alias("n_test")).withColumn("same", F.lit(models.same_predictions(before, after)))


@query
def leakage_diagnostic(spark, d):
    """G9."""
    return models.leakage_diagnostic(labelled(spark, d), "rf")


@query
def threshold_sweep(spark, d):
    """Class shares by label threshold."""
    return rounded(metrics.class_balance(models.threshold_sweep(labelled(spark, d)), ("threshold",)))


def listed_brands(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, listed): every brand with a stock of the extended universe, spread over its sectors."""
    return stocks(spark, d).select("ticker", (F.col("position") * 4 % 100 + 1).cast("int").alias("at")).join(dims.extended(spark).select(F.col("ticker").alias("listed"), F.col("position").alias("at")), "at").select("ticker", "listed")


@query
def threshold_study(spark, d):
    """G10, rows only: a model against baselines and the backtest, for each label threshold."""
    return models.threshold_study(labelled(spark, d), train=TRAIN, test=TEST, step=STEP, cost=COST)


@query
def universe_study(spark, d):
    """G11, rows only: models of the default and of the extended universe side by side."""
    both = listed_brands(spark, d)
    some = both.join(dims.universe(spark).select(F.col("ticker").alias("listed")), "listed", "left_semi")
    sets = some.select(F.lit("default").alias("universe"), "ticker").unionByName(both.select(F.lit("extended").alias("universe"), "ticker"))
    return models.universe_study(labelled(spark, d), sets, train=TRAIN, test=TEST, step=STEP, cost=COST)


@query
def risk_models(spark, d):
    """G13, rows only: three models of the risk class from the five fields of a profile."""
    p = profiles(spark, d)
    out, _ = models.risk_classifier(p.withColumn("category", rules.risk_class(*[F.col(c) for c in ("age", "horizon", "experience", "risk_score")])))
    rows = metrics.scores(out)
    best = metrics.best_model(rows, ("majority",)).select(F.col("model").alias("best"))
    return rows.crossJoin(best)  # one row


@query
def regime_study(spark, d):
    """I13, rows only: a model fitted before each regime, its accuracy in it, and tests over regimes."""
    got = models.regime_study(labelled(spark, d), regimes(spark))
    a = got["accuracy"].select(F.concat_ws(" ", F.lit("accuracy"), "regime").alias("what"), F.col("accuracy").alias("value"), "lower", "upper")
    none = F.lit(None).cast("double")
    for name, value in (("anova", "f"), ("kruskal", "h")):
        a = a.union(got[name].select(F.lit(name).alias("what"), F.col(value).cast("double").alias("value"), F.col("p_value").alias("lower"), none.alias("upper")))
    return a.union(got["tukey"].select(F.concat_ws(" ", F.lit("tukey"), "a", "b").alias("what"), F.col("q").alias("value"), F.col("p_value").alias("lower"), none.alias("upper")))


@query
def walk_forward_trees(spark, d):
    """G8 with decision trees, into H."""
    return ledger.metrics(models.sliding_signals(labelled(spark, d), TRAIN, TEST, STEP, "dt"), COST, train=TRAIN, test=TEST, step=STEP)


@query
def walk_forward_forests(spark, d):
    """G8 with a forest of 100 trees for every stock and window, into H."""
    return ledger.metrics(models.sliding_signals(labelled(spark, d), TRAIN, TEST, STEP, "rf"), COST, train=TRAIN, test=TEST, step=STEP)


@query
def universe_comparison(spark, d):
    """Two universes side by side."""
    p = predictions(spark, d).join(stocks(spark, d).select("ticker", "position"), "ticker")
    both = p.where("position <= 5").withColumn("universe", F.lit("five")).unionByName(p.withColumn("universe", F.lit("all")))
    return rounded(metrics.scores(both, ("universe", "model")).select("universe", "model", "n_test", "accuracy", "f1_weighted"))


@query
def walk_forward_models(spark, d):
    """G8 into H: a model for every stock and window, then the ledger."""
    return ledger.metrics(models.sliding_signals(labelled(spark, d), TRAIN, TEST, STEP), COST, train=TRAIN, test=TEST, step=STEP)


@query
def sequence_model(spark, d):
    """The validation side of every stock."""
    _, rows = models.sequence_validation(labelled(spark, d))
    return metrics.scores(rows.select(F.lit("sequence").alias("model"), F.col("target").alias("y_true"), "y_pred"))


@query
def regime_accuracy(spark, d):
    """Rule accuracy by regime with intervals."""
    p = predictions(spark, d).join(F.broadcast(regimes(spark)), F.col("date").between(F.col("start"), F.col("end")))
    got = p.groupBy("model", "regime").agg(F.count_if(F.col("y_true") == F.col("y_pred")).alias("k"), F.count("*").alias("n"))
    ci = stats.wilson(F.col("k"), F.col("n"))
    return rounded(got.withColumns({"accuracy": ci["estimate"], "lower": ci["lower"], "upper": ci["upper"]}))


@query
def inference_table(spark, d):
    """Per stock wins, returns, Sharpe interval of its curve."""
    s = signals(spark, d)
    m = ledger.metrics(s, COST).select("ticker", "n_trades", "n_wins", "win_rate", "total_return", "benchmark_return", "excess_return")
    curve = ledger.equity(ledger.points(s, COST))
    before = F.lag("value").over(Window.partitionBy("ticker").orderBy("seq"))
    r = curve.select("ticker", (F.col("value") / before - 1).alias("r"))
    return rounded(m.join(stats.sharpe_interval(r, ("ticker",)).drop("n"), "ticker"))
