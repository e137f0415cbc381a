"""Risk classes, questionnaire scores, suitability ratings, and the rules that present them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import present, ratio

# Risk categories, signals, score bands, and the rating of each pair.
RISK_CATEGORIES = ("Aggressive", "Balanced", "Conservative", "Growth", "Moderate", "Moderately Conservative")
RISK_ORDER = ("Conservative", "Moderately Conservative", "Balanced", "Growth", "Aggressive")
SIGNALS = ("Avoid", "Buy", "Hold")
SIGNAL_ORDER = ("Avoid", "Hold", "Buy")
RATING_ORDER = ("Not Suitable", "Use Caution", "Suitable")
BANDS = ((5, 8, "Conservative"), (9, 11, "Moderately Conservative"), (12, 14, "Balanced"), (15, 17, "Growth"), (18, 20, "Aggressive"))
CATEGORY_TEXTS = {
    "Conservative": "Keeping the capital comes first; swings of the market are unwelcome. Fits bonds, steady dividend payers and money market funds.",
    "Moderately Conservative": "Stability comes first, small swings are accepted for modest growth. Fits balanced funds, dividend stocks and sound bonds.",
    "Balanced": "Medium risk for medium returns, over a medium span of years. Fits broad index funds and a mix of stocks and bonds.",
    "Growth": "Growth comes first; large swings and long drawdowns can be borne. Fits growth stocks, sector funds and small companies.",
    "Aggressive": "The highest returns are sought, whatever the swings, over many years. Fits fast growing technology stocks and emerging markets.",
}
RATINGS = {
    "Conservative": {"Buy": "Use Caution", "Hold": "Not Suitable", "Avoid": "Not Suitable"},
    "Moderately Conservative": {"Buy": "Use Caution", "Hold": "Not Suitable", "Avoid": "Not Suitable"},
    "Balanced": {"Buy": "Suitable", "Hold": "Use Caution", "Avoid": "Not Suitable"},
    "Moderate": {"Buy": "Suitable", "Hold": "Use Caution", "Avoid": "Not Suitable"},
    "Growth": {"Buy": "Suitable", "Hold": "Suitable", "Avoid": "Use Caution"},
    "Aggressive": {"Buy": "Suitable", "Hold": "Suitable", "Avoid": "Use Caution"},
}
PROFILE_RANGES = {"age": ("int", 18, 120), "income": ("float", 0.0, 999999999.99), "horizon": ("int", 1, 50), "experience": ("int", 0, 50), "risk_score": ("int", 1, 10)}
QUESTIONS = ("loss_reaction", "investment_goal", "time_horizon", "emotional_comfort", "risk_return_preference")


def suitability_matrix(spark: SparkSession) -> DataFrame:
    """The 18 rows (risk_category, signal, rating, explanation)."""
    rows = [(r, s, x, f"A {s} signal is rated {x} for the {r} profile.") for r, of in RATINGS.items() for s, x in of.items()]
    return spark.createDataFrame(rows, "risk_category string, signal string, rating string, explanation string")


def profile_errors(profiles: DataFrame) -> DataFrame:
    """``errors``: every complaint about a profile, as an array of texts; typed columns or raw strings."""
    kinds = dict(profiles.dtypes)
    checks = []
    for name, (kind, lo, hi) in PROFILE_RANGES.items():
        c = F.col(name)
        must = f"must be {kind} in range [{lo}, {hi}]"
        raw = kinds[name] == "string"
        number = F.expr(f"try_cast({name} as {'bigint' if kind == 'int' else 'double'})") if raw else c
        wrong = (number.isNull() if raw else F.lit(False)) | (F.lit(kind == "int" and kinds[name] in ("double", "float", "boolean"))) | ~number.between(lo, hi)
        if raw and kind == "int":
            wrong = wrong | ~c.rlike(r"^\s*[+-]?\d+\s*$")
        checks += [(c.isNull(), F.lit(f"Missing field '{name}': {must}")), (c.isNotNull() & wrong, F.concat(F.lit(f"Invalid field '{name}': {must}, got "), c.cast("string")))]
    return profiles.withColumn("errors", present(*checks))


def domain_error(value: Column, name: str, domain: tuple[str, ...]) -> Column:
    """A text that names the value and the sorted domain, null if the value belongs to it; case matters."""
    listed = "[" + ", ".join(f"'{x}'" for x in sorted(domain)) + "]"
    return F.when(~F.coalesce(value.isin(*domain), F.lit(False)), F.concat(F.lit(f"Invalid {name}: must be one of {listed}, got '"), F.coalesce(value, F.lit("None")), F.lit("'")))


def risk_class(age: Column, horizon: Column, experience: Column, risk_score: Column) -> Column:
    """Base level by score, one level toward Conservative for each of age over 60, horizon under 3, experience under 2."""
    base = F.when(risk_score <= 3, 2).when(risk_score <= 6, 1).otherwise(0)
    shift = (age > 60).cast("int") + (horizon < 3).cast("int") + (experience < 2).cast("int")
    return F.element_at(F.array(F.lit("Aggressive"), F.lit("Moderate"), F.lit("Conservative")), F.least(base + shift, F.lit(2)) + 1)


def score_category(score: Column, shift: int = 0) -> Column:
    """The band of a questionnaire total; null outside 5 to 20. ``shift`` moves all inner bounds, end bands take what falls out."""
    out = F.lit(None).cast("string")
    for i, (lo, hi, name) in reversed(list(enumerate(BANDS))):
        low = 5 if i == 0 else lo + shift
        high = 20 if i == len(BANDS) - 1 else hi + shift
        out = F.when(score.between(low, high), name).otherwise(out)
    return F.when(score.between(5, 20), out)


def questionnaire(responses: DataFrame, items: int = 5) -> DataFrame:
    """``responses(respondent_id, item_id, score)`` -> total, category (null if incomplete or out of range), breakdown by item, complete."""
    got = responses.groupBy("respondent_id").agg(
        F.sum("score").cast("int").alias("total"), F.count_distinct("item_id").alias("answered"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("item_id", "score")))).alias("breakdown")
    )
    got = got.withColumn("complete", F.col("answered") == items)
    return got.withColumn("category", F.when(F.col("complete"), score_category(F.col("total"))))


def category_text(category: Column) -> Column:
    """What a questionnaire category means, for its investor; null for null and for names that are no category."""
    out = F.lit(None).cast("string")
    for name, text in CATEGORY_TEXTS.items():
        out = F.when(category == name, text).otherwise(out)
    return out


def response_errors(wide: DataFrame, items: tuple[str, ...]) -> DataFrame:
    """``errors`` for a respondent's row of item scores: each must be an integer from 1 to 4."""
    checks = [(F.col(i).isNull(), F.lit(f"{i} is missing")) for i in items] + [(F.col(i).isNotNull() & ~(F.col(i).between(1, 4) & (F.col(i) == F.floor(i))), F.format_string(f"{i} must be an integer from 1 to 4, got %s", F.col(i).cast("string"))) for i in items]
    return wide.withColumn("errors", present(*checks))


def response_matrix_errors(wide: DataFrame, items: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``errors`` of a whole matrix of answers, a row a cohort: rows that are wrong by themselves, fewer than two respondents, totals without variance."""
    total = sum((F.col(i) for i in items), F.lit(0)).cast("double")
    rows = response_errors(wide, items).withColumn("__total", total)
    got = rows.groupBy(*by).agg(F.count_if(F.size("errors") > 0).alias("n_bad"), F.count("*").alias("n"), F.var_samp("__total").alias("__v"))
    checks = present((F.col("n_bad") > 0, F.format_string("%d respondents with invalid answers", "n_bad")), (F.col("n") < 2, F.lit("needs at least two respondents")), (F.coalesce(F.col("__v"), F.lit(0.0)) <= 0, F.lit("totals have no variance")))
    return got.select(*by, "n", "n_bad", checks.alias("errors"))


def band_sensitivity(totals: DataFrame, shifts: tuple[int, ...] = (-2, -1, 1, 2)) -> DataFrame:
    """How many of ``totals(total, n)`` change category when the band bounds move by each shift."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("shift"), score_category(F.col("total"), s).alias("moved")) for s in shifts])).alias("s")
    both = totals.where(F.col("total").between(5, 20)).select("n", score_category(F.col("total")).alias("category"), rows).select("n", "category", "s.*")
    changed = F.sum(F.when(F.col("moved") != F.col("category"), F.col("n")).otherwise(0))
    return both.groupBy("shift").agg(changed.alias("changed"), F.sum("n").alias("n")).withColumn("share", ratio(F.col("changed"), F.col("n")))


def recommend(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """``rows(risk_category, signal)`` with rating and explanation, or the first ``error`` as a value."""
    risk, signal = F.col("risk_category"), F.col("signal")
    error = F.coalesce(
        F.when(risk.isNull() | (risk == ""), "Missing Risk_Category"), F.when(signal.isNull() | (signal == ""), "Missing Stock_Signal"), domain_error(risk, "Risk_Category", RISK_CATEGORIES), domain_error(signal, "Stock_Signal", SIGNALS)
    )
    return rows.join(matrix, ["risk_category", "signal"], "left").withColumn("error", error)  # Spark broadcasts a small matrix by its size


def recommendations(investors: DataFrame, stocks: DataFrame, matrix: DataFrame) -> DataFrame:
    """Every investor (investor_id, risk_category) with every stock's latest row, rated and ranked.

    Investors meet the few categories there are, not the matrix row by row: stocks are rated once per
    category, and the investors of a category join that. Rank: Suitable, Use Caution, Not Suitable,
    errors, then the stocks' position.
    """
    kinds = investors.select("risk_category").distinct()
    rated = recommend(kinds.crossJoin(stocks), matrix)  # a row a category and stock
    order = F.coalesce(F.when(F.col("rating") == "Suitable", 0).when(F.col("rating") == "Use Caution", 1).when(F.col("rating") == "Not Suitable", 2), F.lit(3))
    rank = F.row_number().over(Window.partitionBy("risk_category").orderBy(order, "position"))
    rated = rated.withColumn("rank", rank).withColumnRenamed("risk_category", "__kind")
    return investors.join(rated, F.col("risk_category").eqNullSafe(F.col("__kind"))).drop("__kind")


def best_pick(rated: DataFrame, by: str = "investor_id") -> DataFrame:
    """The Suitable stock of least volatility for each profile, those with a Buy signal first, the first in position on a tie."""
    order = Window.partitionBy(by).orderBy((F.col("signal") != "Buy"), "volatility", "position")
    return rated.where("rating = 'Suitable'").withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def best_picks(investors: DataFrame, stocks: DataFrame, matrix: DataFrame) -> DataFrame:
    """:func:`best_pick` of :func:`recommendations`, for investors (investor_id, risk_category): stocks are rated and picked once per
    category, so that an investor meets one row and not every stock."""
    kinds = recommend(investors.select("risk_category").distinct().crossJoin(stocks), matrix)
    picks = best_pick(kinds, "risk_category").withColumnRenamed("risk_category", "__kind")
    return investors.join(F.broadcast(picks), F.col("risk_category") == F.col("__kind")).drop("__kind")


def compare(stocks: DataFrame, tickers: list[str]) -> DataFrame:
    """Two or three stocks: one row with the better momentum, the lower volatility, and the stronger outlook (the only Buy)."""
    if not 2 <= len(tickers) <= 3:
        raise ValueError("compare two or three tickers")
    some = stocks.where(F.col("ticker").isin(*tickers))
    buys = F.collect_list(F.when(F.col("signal") == "Buy", F.col("ticker")))
    return some.agg(F.max_by("ticker", "price_change_30d").alias("better_momentum"), F.min_by("ticker", "volatility").alias("lower_volatility"), buys.alias("b")).select("better_momentum", "lower_volatility", F.when(F.size("b") == 1, F.col("b")[0]).alias("stronger_outlook"))


def comparison_table(stocks: DataFrame, tickers: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """A row a metric, a column a ticker."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("c")
    return stocks.where(F.col("ticker").isin(*tickers)).select("ticker", cells).select("ticker", "c.*").groupBy("metric").pivot("ticker", tickers).agg(F.first("value"))


def best_in_comparison(rated: DataFrame, tickers: list[str]) -> DataFrame:
    """The least volatile Suitable one of the compared stocks, per investor."""
    return rated.where(F.col("ticker").isin(*tickers) & (F.col("rating") == "Suitable")).groupBy("investor_id").agg(F.min_by("ticker", F.struct("volatility", "position")).alias("best"))


def bands(stocks: DataFrame) -> DataFrame:
    """risk_level (volatility in percent), rsi_zone, and two readings of the 30-day trend; exactly -5 reads as flat in one and up in the other."""
    v, r, c = F.col("volatility"), F.col("rsi"), F.col("price_change_30d")
    return stocks.withColumns(
        {
            "risk_level": F.when(v < 1.5, "LOW").when(v < 3, "MODERATE").otherwise("HIGH"),
            "rsi_zone": F.when(r > 70, "overbought").when(r < 30, "oversold").otherwise("neutral"),
            "trend_explained": F.when(c <= -5, "down").when(c >= 10, "up").otherwise("flat"),
            "trend_assessed": F.when(c < -5, "declining").when(F.abs(c) < 5, "flat").otherwise("uptrend"),
        }
    )


def pros_cons(stocks: DataFrame) -> DataFrame:
    """Arrays ``pros`` and ``cons`` from signal, RSI, MACD, 30-day change, volatility and rating."""
    s, r, m, c, v, x = (F.col(k) for k in ("signal", "rsi", "macd", "price_change_30d", "volatility", "rating"))
    pros = present((s == "Buy", F.lit("buy signal")), (r < 30, F.lit("oversold")), (m > 0, F.lit("upward momentum")), (c > 5, F.lit("rising")), (v < 2, F.lit("stable")), (x == "Suitable", F.lit("fits the profile")))
    cons = present((s == "Avoid", F.lit("avoid signal")), (r > 70, F.lit("overbought")), (m <= 0, F.lit("downward momentum")), (c < -5, F.lit("falling")), (v > 4, F.lit("volatile")), (x == "Not Suitable", F.lit("does not fit the profile")))
    return stocks.withColumns({"pros": pros, "cons": cons})


def overview(rated: DataFrame, by: str = "investor_id") -> DataFrame:
    """Per profile: counts by signal and rating, tickers per rating in position order, mean volatility, sentiment."""
    buy, avoid = F.count_if(F.col("signal") == "Buy"), F.count_if(F.col("signal") == "Avoid")

    def listed(rating: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("rating") == rating, F.struct("position", "ticker"))))
        return F.transform(rows, lambda r: r["ticker"])

    return rated.groupBy(by).agg(
        buy.alias("n_buy"), F.count_if(F.col("signal") == "Hold").alias("n_hold"), avoid.alias("n_avoid"), listed("Suitable").alias("suitable"), listed("Use Caution").alias("caution"), listed("Not Suitable").alias("not_suitable"),
        F.avg("volatility").alias("mean_volatility"), F.when(buy > avoid, "Bullish").when(avoid > buy, "Bearish").otherwise("Mixed").alias("sentiment"),
    )


def info_card(stocks: DataFrame, analysed: DataFrame) -> DataFrame:
    """Every stock of the dimension with its analysis where there is one; sector ``Unknown`` where absent."""
    got = analysed.select("ticker", "current_price", "price_change_30d", "signal", "rating")
    return stocks.join(got, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown"))).withColumn("analysed", F.col("current_price").isNotNull())


def matrix_violations(matrix: DataFrame) -> DataFrame:
    """(kind, where): missing pairs, missing explanations, ratings that fall as risk tolerance or the signal rises."""
    spark = matrix.sparkSession
    risks = spark.createDataFrame([(r, i) for i, r in enumerate(RISK_ORDER)], "risk_category string, risk_pos int")
    signals = spark.createDataFrame([(s, i) for i, s in enumerate(SIGNAL_ORDER)], "signal string, signal_pos int")
    ratings = spark.createDataFrame([(s, i) for i, s in enumerate(RATING_ORDER)], "rating string, level int")
    grid = risks.crossJoin(signals)
    name = F.concat_ws("/", "risk_category", "signal")
    missing = grid.join(matrix, ["risk_category", "signal"], "left_anti").select(F.lit("missing").alias("kind"), name.alias("where"))
    mute = matrix.where(F.coalesce(F.trim("explanation"), F.lit("")) == "").select(F.lit("unexplained").alias("kind"), name.alias("where"))
    full = grid.join(matrix, ["risk_category", "signal"]).join(ratings, "rating")
    along = F.lag("level").over(Window.partitionBy("signal").orderBy("risk_pos"))
    across = F.lag("level").over(Window.partitionBy("risk_category").orderBy("signal_pos"))
    falls = full.withColumns({"a": along, "b": across})
    risk = falls.where("level < a").select(F.lit("risk order").alias("kind"), name.alias("where"))
    signal = falls.where("level < b").select(F.lit("signal order").alias("kind"), name.alias("where"))
    return missing.union(mute).union(risk).union(signal)
