import pytest
from pyspark.sql import functions as F

from panelwright.operators import rules


def test_matrix_is_total_and_monotone(spark):
    m = rules.suitability_matrix(spark)
    assert m.count() == 18 and m.select("risk_category", "signal").distinct().count() == 18
    assert rules.matrix_violations(m).count() == 0


def test_matrix_violations_are_found(spark):
    m = rules.suitability_matrix(spark)
    bad = m.where("not (risk_category = 'Balanced' and signal = 'Avoid')").withColumn("rating", F.when((F.col("risk_category") == "Aggressive") & (F.col("signal") == "Buy"), "Use Caution").otherwise(F.col("rating"))).withColumn("explanation", F.when(F.col("risk_category") != "Moderate", F.col("explanation")))
    kinds = {r["kind"] for r in rules.matrix_violations(bad).collect()}
    assert kinds == {"missing", "unexplained", "risk order", "signal order"}


def test_suitability_errors_are_values(spark):
    rows = spark.createDataFrame([("Balanced", "Buy"), (None, "Buy"), ("", None), ("Growth", None), ("growth", "Buy"), ("Growth", "Sell")], "risk_category string, signal string")
    got = rules.recommend(rows, rules.suitability_matrix(spark)).collect()
    by = {(r.risk_category, r.signal): (r.rating, r.error) for r in got}
    assert by[("Balanced", "Buy")] == ("Suitable", None)
    assert by[(None, "Buy")][1] == by[("", None)][1] == "Missing Risk_Category" and by[("Growth", None)][1] == "Missing Stock_Signal"
    assert by[("growth", "Buy")][1].startswith("Invalid Risk_Category") and "'growth'" in by[("growth", "Buy")][1]
    assert by[("Growth", "Sell")] == (None, "Invalid Stock_Signal: must be one of ['Avoid', 'Buy', 'Hold'], got 'Sell'")


@pytest.mark.parametrize("row,want", [((30, 10, 5, 8), "Aggressive"), ((61, 10, 5, 8), "Moderate"), ((61, 2, 5, 8), "Conservative"), ((61, 2, 1, 8), "Conservative"), ((60, 3, 2, 6), "Moderate"), ((60, 3, 2, 3), "Conservative"), ((60, 3, 2, 7), "Aggressive")])
def test_risk_class(spark, row, want):
    df = spark.createDataFrame([row], "a int, h int, e int, r int")
    assert df.select(rules.risk_class(*[F.col(c) for c in "aher"])).first()[0] == want


def test_bands_cover_the_scale(spark):
    got = [r[0] for r in spark.range(4, 22).orderBy("id").select(rules.score_category(F.col("id"))).collect()]
    assert got[0] is None and got[-1] is None
    assert got[1:-1] == ["Conservative"] * 4 + ["Moderately Conservative"] * 3 + ["Balanced"] * 3 + ["Growth"] * 3 + ["Aggressive"] * 3
    moved = rules.band_sensitivity(spark.range(5, 21).selectExpr("cast(id as int) total", "1L n")).toPandas().set_index("shift")
    assert moved.changed.to_dict() == {-2: 8, -1: 4, 1: 4, 2: 8}


def test_all_profile_errors_are_reported(spark):
    typed = spark.createDataFrame([(1, 17, -1.0, 51, 51, 11), (2, 18, 0.0, 1, 0, 1), (3, None, None, None, None, None)], "investor_id int, age int, income double, horizon int, experience int, risk_score int")
    got = {r.investor_id: r.errors for r in rules.profile_errors(typed).collect()}
    assert len(got[1]) == 5 and got[2] == [] and all(e.startswith("Missing field") for e in got[3])
    assert got[1][0] == "Invalid field 'age': must be int in range [18, 120], got 17"
    raw = spark.createDataFrame([("30.5", "12", "x", "1", "5")], "age string, income string, horizon string, experience string, risk_score string")
    errors = rules.profile_errors(raw).first().errors
    assert len(errors) == 2 and "'age'" in errors[0] and "got x" in errors[1]


def test_questionnaire(spark):
    rows = [(1, f"q{j}", 4) for j in range(5)] + [(2, f"q{j}", 1) for j in range(4)]
    got = {r.respondent_id: r for r in rules.questionnaire(spark.createDataFrame(rows, "respondent_id bigint, item_id string, score int")).collect()}
    assert (got[1].total, got[1].category, got[1].complete) == (20, "Aggressive", True) and got[1].breakdown["q3"] == 4
    assert (got[2].category, got[2].complete) == (None, False)
    told = spark.createDataFrame([(name,) for _, _, name in rules.BANDS] + [(None,), ("Moderate",)], "c string").select("c", rules.category_text(F.col("c")).alias("t")).collect()
    assert [r.t for r in told] == [rules.CATEGORY_TEXTS.get(r.c) for r in told] and len({r.t for r in told}) == 6


STOCKS = "ticker string, signal string, volatility double, rsi double, macd double, price_change_30d double, position int"


def stocks(spark):
    return spark.createDataFrame([("A", "Buy", 3.5, 75.0, 1.0, 6.0, 1), ("B", "Hold", 1.0, 50.0, -1.0, -5.0, 2), ("C", "Avoid", 2.0, 20.0, 0.0, -6.0, 3), ("D", "Buy", 1.5, 50.0, 0.5, 5.0, 4)], STOCKS)


def test_recommendations_rank_and_pick(spark):
    inv = spark.createDataFrame([(1, "Balanced"), (2, "Conservative"), (3, None)], "investor_id int, risk_category string")
    rated = rules.recommendations(inv, stocks(spark), rules.suitability_matrix(spark))
    assert rated.count() == 12
    assert [r.ticker for r in rated.where("investor_id = 1").orderBy("rank").collect()] == ["A", "D", "B", "C"]
    assert {r.investor_id: r.ticker for r in rules.best_pick(rated).collect()} == {1: "D"}
    assert rules.best_in_comparison(rated, ["A", "B"]).collect() == [(1, "A")]
    view = {r.investor_id: r for r in rules.overview(rated).collect()}
    assert (view[1].n_buy, view[1].suitable, view[1].sentiment) == (2, ["A", "D"], "Bullish") and view[3].suitable == []


def test_bands_and_verdicts(spark):
    got = {r.ticker: r for r in rules.bands(stocks(spark)).collect()}
    assert (got["A"].risk_level, got["A"].rsi_zone) == ("HIGH", "overbought") and got["D"].risk_level == "MODERATE" and got["B"].risk_level == "LOW"
    assert (got["B"].trend_explained, got["B"].trend_assessed) == ("down", "uptrend") and got["C"].trend_assessed == "declining"
    c = rules.compare(stocks(spark), ["A", "B"]).first()
    assert (c.better_momentum, c.lower_volatility, c.stronger_outlook) == ("A", "B", "A")
    assert rules.compare(stocks(spark), ["A", "D"]).first().stronger_outlook is None
    with pytest.raises(ValueError):
        rules.compare(stocks(spark), ["A"])
    pc = {r.ticker: (r.pros, r.cons) for r in rules.pros_cons(stocks(spark).withColumn("rating", F.lit("Suitable"))).collect()}
    assert "rising" in pc["A"][0] and "overbought" in pc["A"][1] and "falling" in pc["C"][1]
    t = rules.comparison_table(stocks(spark), ["A", "B"], ("rsi", "volatility")).toPandas().set_index("metric")
    assert t.A["rsi"] == 75 and t.B["volatility"] == 1


def test_response_errors(spark):
    df = spark.createDataFrame([(1, 4), (0, 5), (None, 2)], "a int, b int")
    assert [len(r.errors) for r in rules.response_errors(df, ("a", "b")).collect()] == [0, 2, 1]


def test_picks_by_category_are_picks_by_investor(spark):
    people = spark.createDataFrame([(1, "Balanced"), (2, "Growth"), (3, "Conservative"), (4, None), (5, "Wild"), (6, "Growth")], "investor_id long, risk_category string")
    stocks = spark.createDataFrame([("A", "Hold", 1.0, 1), ("B", "Buy", 3.0, 2), ("C", "Buy", 3.0, 3), ("D", "Avoid", 0.1, 4)], "ticker string, signal string, volatility double, position int")
    m = rules.suitability_matrix(spark)
    plain = {(r.investor_id, r.ticker) for r in rules.best_pick(rules.recommendations(people, stocks, m)).collect()}
    got = [(r.investor_id, r.ticker) for r in rules.best_picks(people, stocks, m).collect()]
    assert set(got) == plain == {(1, "B"), (2, "B"), (6, "B")} and len(got) == 3
