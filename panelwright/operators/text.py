"""Tickers, intents and contradictions in messages and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import any_of, has_word, plain_words, ratio

# Words of company names that single none out, and the phrases that tell an intent.
COMMON_NAME_WORDS = ("INC", "CORP", "CO", "GROUP", "PLATFORMS", "TECHNOLOGY", "TECHNOLOGIES", "COMPANY", "HOLDINGS", "THE", "AND", "ENERGY", "MICRO", "DEVICES", "ADVANCED", "SERVICES", "SYSTEMS", "INTERNATIONAL")
COMPARE = ("compare", " vs ", "versus", "difference between", "which is better")
WHY = ("why", "reason", "explain", "how come", "based on", "what makes", "how is")
RECOMMEND = ("recommend", "suitable", "suggest", "pick")
RATED = ("risk", "risky", "high risk", "low risk", "rating")
RISK = ("risk", "risky", "dangerous", "volatile", "safe")
INFO = ("industry", "sector", "what does", "what is", "tell me about", "info")
BEST = ("best", "should i buy", "what should", "recommend me", "top pick", "suggestion")
PORTFOLIO = ("portfolio", "diversif", "all stocks", "overall")
PERSONAL = ("best_pick", "portfolio_overview", "explain_recommendation")


def _meets(rows: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """``rows`` joined with the ``terms(word, ..)`` that stand in ``column`` by themselves, each row once a term.

    Both sides are cut into plain words. A term has one key, the longest of its words (the first of equal ones), which every text that holds
    it must hold; texts give their distinct words, and Spark broadcasts the terms or sorts both, by size. Only where
    a term is more than its key is it then looked for as it is written, punctuation included. Terms may have any number of words.
    """
    words = plain_words(F.col("word"))
    longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    keyed = terms.withColumn("__key", longest).withColumn("__plain", F.upper("word") == F.col("__key")).where("__key is not null")
    met = rows.withColumn("__key", F.explode(F.array_distinct(plain_words(F.col(column))))).join(keyed, "__key")
    return met.where(F.col("__plain") | has_word(F.col(column), F.col("word"))).drop("__key", "__plain")


def aliases(stocks: DataFrame) -> DataFrame:
    """``stocks(ticker, name, position)`` -> (word, ticker, position, kind): the ticker (kind 0) and its name's telling words (kind 1)."""
    own = stocks.select(F.upper("ticker").alias("word"), "ticker", "position", F.lit(0).alias("kind"))
    words = F.explode(F.regexp_extract_all(F.upper("name"), F.lit("([A-Z]+)"))).alias("word")
    named = stocks.select(words, "ticker", "position", F.lit(1).alias("kind"))
    return own.union(named.where((F.length("word") > 3) & ~F.col("word").isin(*COMMON_NAME_WORDS))).distinct()


def _named(messages: DataFrame, stocks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``messages`` with ``tickers``: one exchange by id gathers the few hits of a message."""
    hits = _meets(messages.select(id_col, text_col), text_col, aliases(stocks))
    sets = hits.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("kind", "position", "ticker"))).alias("__hits"))
    own = F.transform(F.filter("__hits", lambda h: h["kind"] == 0), lambda h: h["ticker"])
    listed = sets.withColumn("__own", own).select(id_col, F.transform(F.filter("__hits", lambda h: (h["kind"] == 0) | ~F.array_contains(F.col("__own"), h["ticker"])), lambda h: h["ticker"]).alias("tickers"))
    return messages.join(listed, id_col, "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))


def mentions(messages: DataFrame, stocks: DataFrame, id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    """``(id, tickers)`` for all messages: tickers named as whole words in position order, then those named by a telling word."""
    return _named(messages.select(id_col, text_col), stocks, id_col, text_col).select(id_col, "tickers")


def intent(text: Column, has_ticker: Column) -> Column:
    """The first rule that matches; a why-question without its second part goes on to the next rules."""
    t = F.lower(text)
    why = any_of(t, WHY)
    rules = [
        (any_of(t, COMPARE), "compare"),
        (why & any_of(t, RECOMMEND), "explain_recommendation"),
        (why & (has_ticker | any_of(t, RATED)), "explain_risk"),
        (any_of(t, RISK), "risk_analysis"),
        (any_of(t, INFO), "stock_info"),
        (any_of(t, BEST), "best_pick"),
        (any_of(t, PORTFOLIO), "portfolio_overview"),
        (has_ticker, "stock_info"),
    ]
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in rules], F.lit("general_help"))


def classified(messages: DataFrame, stocks: DataFrame, id_col: str = "message_id", text_col: str = "text") -> DataFrame:
    """``messages`` with tickers and intent."""
    return _named(messages, stocks, id_col, text_col).withColumn("intent", intent(F.col(text_col), F.size("tickers") > 0))


def gated(rows: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """``risk_category`` null where unknown, and ``answerable``: personal intents need one."""
    rows = rows.withColumn("risk_category", F.when(F.col("risk_category").isin(*categories), F.col("risk_category")))
    return rows.withColumn("answerable", ~F.col("intent").isin(*PERSONAL) | F.col("risk_category").isNotNull())


def guard(summaries: DataFrame, facts: DataFrame, id_col: str = "summary_id", text_col: str = "text") -> DataFrame:
    """``summaries`` with ``accepted``: no sentence that names exactly one ticker of ``facts(ticker, rating, signal)`` says another rating or signal of it.

    Summaries and facts are of one set: every summary is held against all facts. Ids tell summaries apart.
    """
    others = [c for c in summaries.columns if c != id_col]
    sentence = F.posexplode_outer(F.split(text_col, r"(?<=[.!?])\s+")).alias("__at", "__sentence")
    rows = summaries.select(id_col, sentence)
    known = facts.select(F.col("ticker").alias("word"), F.lower("rating").alias("__rating"), F.lower("signal").alias("__signal"))
    of_sentence = _meets(rows.select(id_col, "__at", "__sentence"), "__sentence", known)
    named = of_sentence.groupBy(id_col, "__at", "__sentence").agg(F.count("*").alias("n"), F.first("__rating").alias("rating"), F.first("__signal").alias("signal")).where("n = 1")
    low = F.lower("__sentence")
    rating = F.when(low.contains("not suitable"), "not suitable").when(low.contains("use caution"), "use caution").when(low.contains("suitable"), "suitable")
    signal = F.when(has_word(low, F.lit("buy")), "buy").when(has_word(low, F.lit("hold")), "hold").when(has_word(low, F.lit("avoid")), "avoid")
    wrong = F.coalesce((F.col("rating") != "") & (rating != F.col("rating")), F.lit(False)) | F.coalesce((F.col("signal") != "") & (signal != F.col("signal")), F.lit(False))
    bad = named.groupBy(id_col).agg(F.bool_or(wrong).alias("__bad"))
    return summaries.select(id_col, *others).join(bad, id_col, "left").withColumn("accepted", ~F.coalesce("__bad", F.lit(False))).drop("__bad")


# Summaries to hold the guard against: {a}, {b} are tickers, {ra} a's rating, {sa} a's signal, and so on.
SOUND = (
    "{a} is rated {ra}.", "The signal for {a} is {sa}.", "{a} is {ra} for you; its signal is {sa}.", "{a} and {b} differ in outlook.", "Markets moved today. {b} is rated {rb}.", "{b} shows a {sb} signal.", "{a} is rated {ra}. {b} is rated {rb}.",
)
SWAPPED = ("{a} is rated {rb}.", "The signal for {a} is {sb}.", "{b} is rated {ra}.", "{b} shows a {sa} signal.")


def guard_cases(facts: DataFrame) -> DataFrame:
    """(summary_id, text, contradicts) for every ordered pair of the stocks of ``facts``: sound summaries, swapped ones where that changes something, and a denied Suitable.

    All pairs are the point of this set, so facts should be some hundreds of stocks at most: the work is their square.
    """
    a = facts.select(F.col("ticker").alias("a"), F.col("rating").alias("ra"), F.col("signal").alias("sa"))
    b = facts.select(F.col("ticker").alias("b"), F.col("rating").alias("rb"), F.col("signal").alias("sb"))
    pairs = a.join(b, F.col("a") != F.col("b"))

    def filled(template: str) -> Column:
        text = F.lit(template)
        for k in ("ra", "sa", "rb", "sb", "a", "b"):
            text = F.replace(text, F.lit("{" + k + "}"), F.lower(k) if len(k) == 2 else F.col(k))
        return text

    changes = (F.col("ra") != F.col("rb"), F.col("sa") != F.col("sb"), F.col("ra") != F.col("rb"), F.col("sa") != F.col("sb"))
    made = [F.struct(F.lit(i).alias("case"), filled(t).alias("text"), F.lit(False).alias("contradicts")) for i, t in enumerate(SOUND)]
    made += [F.when(c, F.struct(F.lit(len(SOUND) + i).alias("case"), filled(t).alias("text"), F.lit(True).alias("contradicts"))) for i, (t, c) in enumerate(zip(SWAPPED, changes))]
    made += [F.when(F.col("ra") == "Suitable", F.struct(F.lit(99).alias("case"), filled("{a} is not suitable.").alias("text"), F.lit(True).alias("contradicts")))]
    rows = pairs.select("a", "b", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("c"))
    return rows.select(F.concat_ws("|", "a", "b", "c.case").alias("summary_id"), "c.text", "c.contradicts")


def guard_performance(judged: DataFrame) -> DataFrame:
    """From (contradicts, accepted): counts, precision, recall, f1, accuracy, false accept and reject rates; 0 where undefined."""
    bad, rejected = F.col("contradicts"), ~F.col("accepted")
    got = judged.agg(F.count_if(bad & rejected).alias("tp"), F.count_if(~bad & rejected).alias("fp"), F.count_if(~bad & ~rejected).alias("tn"), F.count_if(bad & ~rejected).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    got = got.withColumns({"precision": ratio(tp, tp + fp, 0.0), "recall": ratio(tp, tp + fn, 0.0), "accuracy": ratio(tp + tn, tp + fp + tn + fn, 0.0), "false_accept_rate": ratio(fn, tp + fn, 0.0), "false_reject_rate": ratio(fp, tn + fp, 0.0)})
    return got.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))
