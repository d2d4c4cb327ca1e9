from skerry.streaming import keyframes as K

SCHEMA = "stream long, id long, ts double, x double, y double"
ROWS = [(s, i, i * 0.3 + s, (i % 7) * 0.2, 0.0) for s in (1, 2) for i in range(40)]


def test_stream_equals_replay(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for k in range(4):
        df.where(f"id >= {k * 10} and id < {k * 10 + 10}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    K.run_available(K.keyframes(stream, rate=1.0, motion=0.9), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert len(got) == len(ROWS)
    assert got == sorted(map(tuple, K.replay(df, rate=1.0, motion=0.9).collect()))


def test_window_is_bounded_and_backlog_sheds(spark):
    r = K.replay(spark.createDataFrame(ROWS, SCHEMA), rate=10.0, motion=9.0).collect()
    assert max(x["n_window"] for x in r) == K.MOST and any(x["dropped"] >= 0 for x in r)
    slow = K.replay(spark.createDataFrame(ROWS, SCHEMA), rate=10.0, motion=9.0, cost=2.0).collect()
    assert any(x["status"] == "shed" for x in slow)
