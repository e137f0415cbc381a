import zlib

import pytest
from pyspark.sql import functions as F

from panelwright.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_every_row_has_one_place_and_the_inverse_finds_it(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id")).repartition(5)
    got = sharding.shard(df, 7).collect()
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
        assert sharding.row_of(r.shard, r.slot, 7, n) == r.row_number == r.doc_id
    assert all(sorted(s) == list(range(len(s))) for s in counts.values())
    sizes = [len(counts.get(s, [])) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_it_shuffles_and_repeats(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"))
    a = sharding.shard(df, 10).select("doc_id", "shard", "slot")
    b = sharding.shard(df.repartition(13), 10).select("doc_id", "shard", "slot")
    assert a.exceptAll(b).isEmpty()
    near = a.where("doc_id < 100").groupBy("shard").count().collect()
    assert max(r["count"] for r in near) < 30
    assert not a.exceptAll(sharding.shard(df, 10, seed=1).select("doc_id", "shard", "slot")).isEmpty()


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(None, "a", 1)] * 3 + [(1, None, 2)] * 4 + [(1, "", 3), (2, "x" * 50_000, 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, slot int")
    got = sharding.shard(df, 4)
    assert got.count() == 9 and got.select("shard", "slot").distinct().count() == 9
    assert got.columns.count("slot") == 1
    assert sharding.shard(df.where("false"), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df, 0)


def test_hot_ties_are_dealt_over_partitions(spark):
    df = spark.range(0, 4000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"))
    got = sharding.number_rows(df, [F.col("doc_id")])
    assert sorted(r.row_number for r in got.collect()) == list(range(4000))


def test_query(spark, sf):
    from panelwright.llm.entries import op1_sharding

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op1_sharding(spark, sf).collect():
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
