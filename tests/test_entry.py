import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("label_counts", "rsi_macd", "purged_split", "class_report", "recommendations", "questionnaire", "kruskal", "cronbach", "message_intents", "guard_performance", "lookups", "matrix_monotone")


def settled(df):
    df = df[sorted(df.columns)]
    return df.map(lambda v: "" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)).sort_values(list(df.columns)).reset_index(drop=True)


def test_registry():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 80


@pytest.mark.parametrize("name", SOME)
def test_queries_agree_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = settled(entry.queries()[name](spark, sf).toPandas()), settled(con.execute(entry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(a, b)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
