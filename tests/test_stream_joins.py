import datetime as dt

from tidemark.streaming import live

T0 = dt.datetime(2024, 1, 1)


def test_two_streams_meet_within_the_tolerance(spark, tmp_path):
    def source(name, schema, rows):
        path = tmp_path / name
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        return live.new_files(spark, spark.read.parquet(str(path)).schema, str(path))

    at = lambda m: T0 + dt.timedelta(minutes=m)
    pings = source("p", "k long, ts timestamp", [(1, at(0)), (1, at(100)), (2, at(0))])
    samples = source("s", "k long, sample_ts timestamp, v double", [(1, at(8), 1.0), (1, at(80), 2.0), (2, at(-10), 3.0)])
    q = live.nearby_samples(pings, samples, "k").selectExpr("a.k", "v").writeStream.format("memory").queryName("nearby").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in spark.table("nearby").collect()) == [(1, 1.0), (2, 3.0)]


def test_sliding_spread(spark, tmp_path):
    path = tmp_path / "v"
    spark.createDataFrame([(T0, 1.0), (T0 + dt.timedelta(hours=1), 5.0)], "ts timestamp, sog double").coalesce(1).write.parquet(str(path))
    s = live.new_files(spark, spark.read.parquet(str(path)).schema, str(path))
    q = live.variability(s, "sog").writeStream.format("memory").queryName("spread").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.start: r.spread for r in spark.table("spread").collect()}
    assert got[T0] == 4.0 and got[T0 - dt.timedelta(hours=5)] == 0.0
