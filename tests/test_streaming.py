import datetime as dt

from panelwright.streaming.bars import daily_bars


def test_stream_and_batch_agree(spark, tmp_path):
    t = dt.datetime(2020, 1, 1, 9)
    rows = [("A", t + dt.timedelta(hours=6 * i), float(10 + i % 3), i) for i in range(12)] + [(None, t, 1.0, 1)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, price double, size bigint")
    want = daily_bars(df).orderBy("date").collect()
    assert len(want) == 4 and (want[0].open, want[0].close, want[0].high, want[0].volume) == (10, 12, 12, 3)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = daily_bars(stream).writeStream.format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    closed = spark.table("bars").orderBy("date").collect()
    assert 1 <= len(closed) < 4 and closed == want[: len(closed)]
