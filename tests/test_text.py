from pyspark.sql import functions as F

from panelwright.operators import text


def stocks(spark):
    return spark.createDataFrame([("MU", "Micron Technology", 1), ("AMD", "Advanced Micro Devices", 2), ("XOM", "Exxon Energy Corp.", 3), ("CAT", "Caterpillar Inc.", 4)], "ticker string, name string, position int")


def run(spark, *messages):
    df = spark.createDataFrame(list(enumerate(messages)), "message_id int, text string")
    got = {r.message_id: (r.tickers, r.intent) for r in text.classified(df, stocks(spark)).collect()}
    return [got[i] for i in range(len(messages))]


def test_tickers_and_intents(spark):
    got = run(spark, "How much should I invest?", "Compare mu and xom", "Is XOM, or CAT, a better buy?", "tell me about micron", "Why is exxon suitable?", "why is AMD high risk", "why?", "what is the best?", "my overall portfolio", "category", "")
    assert got[0] == ([], "general_help") and got[1] == (["MU", "XOM"], "compare") and got[2][0] == ["XOM", "CAT"]
    assert got[3] == (["MU"], "stock_info") and got[4] == (["XOM"], "explain_recommendation") and got[5] == (["AMD"], "explain_risk")
    assert got[6] == ([], "general_help") and got[7][1] == "stock_info" and got[8] == ([], "portfolio_overview") and got[9][0] == [] and got[10] == ([], "general_help")


def test_names_come_after_tickers(spark):
    assert run(spark, "caterpillar and micron against AMD")[0][0] == ["AMD", "MU", "CAT"]


def test_gate(spark):
    df = spark.createDataFrame([("best_pick", "Balanced"), ("best_pick", "Odd"), ("compare", None)], "intent string, risk_category string")
    assert [(r.risk_category, r.answerable) for r in text.gated(df, ("Balanced",)).collect()] == [("Balanced", True), (None, False), (None, True)]


def test_guard(spark):
    facts = spark.createDataFrame([("MU", "Suitable", "Buy"), ("CAT", "Not Suitable", "Avoid")], "ticker string, rating string, signal string")
    cases = {"MU is suitable. CAT is not suitable.": True, "MU is not suitable.": False, "CAT is suitable!": False, "MU and CAT are suitable.": True, "Buy now. MU is a hold.": False, "MU: buyers beware.": True, "It is suitable.": True, "mu has a buy signal, CAT none. cat says buy": False, "": True}
    df = spark.createDataFrame([(t, t) for t in cases], "summary_id string, text string")
    assert {r.summary_id: r.accepted for r in text.guard(df, facts).collect()} == cases
    assert text.guard(df, facts.where("false")).where("not accepted").count() == 0


def test_generated_cases_are_judged_right(spark):
    facts = spark.createDataFrame([("MU", "Suitable", "Buy"), ("CAT", "Not Suitable", "Avoid"), ("XOM", "Use Caution", "Hold")], "ticker string, rating string, signal string")
    cases = text.guard_cases(facts)
    judged = text.guard(cases, facts)
    p = text.guard_performance(judged).first()
    assert (p.fp, p.fn) == (0, 0) and p.tp == 6 * 4 + 2 and p.tn == 42 and p.f1 == 1
    assert text.guard_performance(judged.where(F.lit(False))).first().f1 == 0


def test_tickers_with_punctuation(spark):
    from panelwright.sources import dims

    stocks = dims.extended(spark)
    df = spark.createDataFrame(list(enumerate(["Is BRK-B risky?", "brk-b, V and C", "BRK B", "xBRK-B", "BRK-B.", "BRK-Bx", "AT&T or T?"])), "message_id int, text string")
    got = {r.message_id: r.tickers for r in text.mentions(df, stocks).collect()}
    assert got[0] == ["BRK-B"] and got[1] == ["BRK-B", "C", "V"] and got[2] == [] and got[3] == [] and got[4] == ["BRK-B"] and got[5] == [] and got[6] == ["T"]
    facts = spark.createDataFrame([("BRK-B", "Suitable", "Buy"), ("V", "Not Suitable", "Avoid")], "ticker string, rating string, signal string")
    cases = {"BRK-B is not suitable for you.": False, "BRK-B is suitable.": True, "Sell BRK-B? Hold, says brk-b.": False, "BRK-B and V are suitable.": True, "": True}
    got = text.guard(spark.createDataFrame([(t, t) for t in cases], "summary_id string, text string"), facts)
    assert {r.summary_id: r.accepted for r in got.collect()} == cases
