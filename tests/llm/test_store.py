import os

import pytest
from pyspark.sql import functions as F

from panelwright.llm import store


def test_frozen_values_stay_and_go(spark):
    df = store.frozen(spark.range(100).repartition(7).withColumn("m", F.monotonically_increasing_id()), "t")
    first = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, df.repartition(3).collect())) == first
    folder = df.frozen_path.removeprefix("file://")
    assert os.path.isdir(folder)
    store.release(df)
    assert not os.path.exists(folder)


def test_empty_tables_can_be_frozen(spark):
    assert store.frozen(spark.range(0).select(F.array(F.struct("id")).alias("x")), "e").count() == 0


def test_row_hash_skips_maps(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2}), (2, None)], "`an id` int, m map<string,int>")
    assert df.select(store.row_hash(df)).distinct().count() == 2


def test_without_ignores_case(spark):
    assert store.without(spark.createDataFrame([(1, 2, 3)], "Slot int, shard int, x int"), "slot", "shard").columns == ["x"]


def test_scratch_tables_go_but_those_kept(spark):
    with store.scratch() as kept:
        a, b = store.frozen(spark.range(3), "a"), store.frozen(spark.range(4), "b")
        kept.append(b)
    assert not os.path.exists(a.frozen_path.removeprefix("file://")) and b.count() == 4


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        def __init__(self, folder=None, checkpoint=None):
            self.conf = {"spark.checkpoint.dir": folder} if folder else {}
            self.sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": lambda _: checkpoint})()

    with pytest.raises(RuntimeError):
        store.shared_folder(Session())
    assert store.shared_folder(Session("hdfs:///a", "hdfs:///b")) == "hdfs:///a" and store.shared_folder(Session(None, "hdfs:///b")) == "hdfs:///b"


def test_operators_leave_only_what_their_results_read(spark, sf, tmp_path, monkeypatch):
    """After a result is computed, the folder holds the tables that it reads and no more."""
    from panelwright.llm.entries import QUERIES

    for name, most in {"op1_sharding": 1, "op2_simhash_dedup": 2, "op3_source_mixing": 2, "op4_quality_classifier": 0, "op5_toxicity": 0, "op6_recompression_dedup": 2, "op7_suffix_dedup": 2, "op8_decontamination": 0, "op9_license_scan": 0, "op10_lattice_dedup": 1}.items():
        folder = tmp_path / name
        folder.mkdir()
        monkeypatch.setattr(store, "shared_folder", lambda _, folder=folder: f"file://{folder}")
        assert QUERIES[name](spark, sf).count() > 0
        left = sorted(x.name for x in folder.iterdir())
        assert len(left) <= most, (name, left)


def test_queries_of_two_threads_keep_their_own_tables(spark):
    import threading
    from concurrent.futures import ThreadPoolExecutor

    from panelwright.llm import store

    barrier, name = threading.Barrier(2, timeout=120), store._CLEANUP
    before = spark.conf.get(name, None)

    def query(k):
        with store.scratch() as kept:
            table = store.frozen(spark.range(k, k + 5), "mine")
            barrier.wait()  # both have written
            if k == 0:
                kept.append(table)
        barrier.wait()  # the other's tables are gone
        return table.count() if k == 0 else None

    with ThreadPoolExecutor(2) as both:
        assert list(both.map(query, (0, 100))) == [5, None]
    assert spark.conf.get(name, None) == before and not store._changed
