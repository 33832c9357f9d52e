"""Queries on streams: pings are written as files, read as a stream until none are left, and what came out is read back."""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import queries_events as QE
from tidemark.plans import roles as R
from tidemark.plans.lineage import TASK_ROWS, scratch
from tidemark.plans.register import query, rounded
from tidemark.streaming import files as N
from tidemark.streaming import live as L


def _stream(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df's rows as a stream of files."""
    path = scratch(spark)
    df.write.parquet(path)
    return L.new_files(spark, df.schema, path)


def _pings(spark: SparkSession, sf: str) -> DataFrame:
    return R.pings(spark, sf).select("event_id", "mmsi", "ts", "lat", "lon", "sog")


_NEAR = QE.MATCH.replace("PARTITION BY mmsi, ts", "PARTITION BY event_id").replace("WHERE sog < 0.5", "WHERE sog < 0.5 AND sog <= 2")


@query(f"{QE.WITH_PINGS}, {_NEAR} SELECT found_id, count(*) AS pings, round(avg(dist_m), 4) AS dist_m FROM best GROUP BY found_id")
def stream_matches(spark: SparkSession, sf: str) -> DataFrame:
    """ST-01."""
    got, _ = L.drain(L.filtered(_stream(spark, _pings(spark, sf)), R.turbines(spark, sf)))
    return rounded(got.groupBy("found_id").agg(F.count(F.lit(1)).alias("pings"), F.avg("dist_m").alias("dist_m")), dist_m=4)


@query(f"WITH {R.PINGS} SELECT mmsi, count(DISTINCT ts) AS pings FROM pings GROUP BY mmsi")
def stream_without_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """ST-02: every ping twice, and vessels with several pings at a time."""
    p = _pings(spark, sf)
    got, _ = L.drain(L.without_duplicates(_stream(spark, p.unionByName(p))))
    return got.groupBy("mmsi").agg(F.count(F.lit(1)).alias("pings"))


@query(f"""{QE.WITH_PINGS}, {QE.MATCH}, mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM best), ready AS (SELECT best.* FROM best, mark WHERE ts < wm),
marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR found_id <> lag(found_id) OVER w THEN 1 ELSE 0 END AS is_new FROM ready WINDOW w AS (PARTITION BY mmsi ORDER BY ts, found_id)),
numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY mmsi ORDER BY ts, found_id ROWS UNBOUNDED PRECEDING) AS k FROM marked),
s AS (SELECT mmsi, k, found_id, min(ts) AS "start", max(ts) AS "end", count(*) AS ping_count, avg(sog) AS mean_sog, min(dist_m) AS min_dist, epoch(max(ts) - min(ts)) / 60.0 AS duration_min FROM numbered GROUP BY ALL), f AS (SELECT *, k = max(k) OVER (PARTITION BY mmsi) AS is_last FROM s)
SELECT mmsi, found_id, "start", "end", ping_count, round(mean_sog, 6) AS mean_sog, round(min_dist, 3) AS min_dist, round(duration_min, 4) AS duration_min FROM f, mark WHERE (NOT is_last OR "end" + INTERVAL 30 MINUTE < wm) AND duration_min >= 15""")
def stream_dwell_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """ST-03: the sessions that are closed when the stream ends."""
    got, _ = L.drain(L.dwell_sessions(L.filtered(_stream(spark, _pings(spark, sf)), R.turbines(spark, sf))))
    return rounded(got, mean_sog=6, min_dist=3, duration_min=4)


@query(f"WITH {R.PINGS}, m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM pings) SELECT date_trunc('hour', ts) AS hour, round(avg(sog), 6) AS mean, count(*) AS n, 0::BIGINT AS late FROM pings, m GROUP BY date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= max(wm)")
def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """ST-04, ST-05: closed hours, and the late rows that the watermark dropped; a test has some."""
    got, late = L.drain(L.hourly(_stream(spark, _pings(spark, sf)), "sog"))
    return rounded(got.withColumn("late", F.lit(late).cast("long")), mean=6)


@query(f"""WITH {R.PINGS}, m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM pings), w AS (SELECT date_trunc('hour', ts) - to_hours(i::INT) AS start, sog FROM pings, (SELECT unnest(range(6)) AS i))
SELECT start, round(max(sog) - min(sog), 6) AS spread, round(stddev_pop(sog), 6) AS std FROM w, m GROUP BY start HAVING start + INTERVAL 6 HOUR <= any_value(wm)""")
def stream_variability(spark: SparkSession, sf: str) -> DataFrame:
    """ST-05."""
    got, _ = L.drain(L.variability(_stream(spark, _pings(spark, sf)), "sog"))
    return rounded(got, spread=6, std=6)


@query("SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def stream_files(spark: SparkSession, sf: str) -> DataFrame:
    """ST-06: files that arrive between two runs with one checkpoint are read once each, and a micro-batch that is run again writes nothing."""
    path, root, log = scratch(spark), scratch(spark), scratch(spark)
    e = R.table(spark, sf, "events").select("event_id", "event_type")
    middle = e.agg(F.percentile_approx("event_id", 0.5)).first()[0] or 0
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        e.filter(part).write.mode("append").parquet(path)
        N.sink_once(L.new_files(spark, e.schema, path, 2), root, log).awaitTermination()
    # without its checkpoint the stream starts anew, and the ledger has its batches
    N.sink_once(L.new_files(spark, e.schema, path, 2), root, scratch(spark)).awaitTermination()
    return N.committed(spark, root, e.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH k AS (SELECT event_type, (event_id % 7)::VARCHAR AS part, count(*) AS rows, sum(value) AS total FROM events GROUP BY ALL), p AS (SELECT *, (row_number() OVER (ORDER BY event_type, part) - 1) // 10 AS b FROM k)
SELECT event_type, part, b + 1 AS batch_id, rows, round(total, 3) AS total FROM p""")
def stable_files(spark: SparkSession, sf: str) -> DataFrame:
    """ST-06, SNK-02: pairs of files of a place and part, complete and stable ones consolidated by tens; a second run finds nothing new."""
    folder, root = scratch(spark), scratch(spark)
    e = R.table(spark, sf, "events").withColumn("part", (F.col("event_id") % 7).cast("string"))
    for kind, column in (("count", F.count(F.lit(1)).cast("double")), ("total", F.sum("value"))):
        rows = e.groupBy("event_type", "part").agg(column.alias("x"))
        rows.repartition("event_type", "part").write.partitionBy("event_type", "part").mode("overwrite").parquet(f"{folder}/{kind}")
    files = N.listing(spark, folder, r".*\.parquet$", [])
    at = lambda c: F.regexp_extract("path", rf"/{c}=([^/]+)/", 1)
    files = files.select("path", "modified", "size", F.regexp_extract("path", r"/(count|total)/event_type=", 1).alias("kind"), at("event_type").alias("event_type"), at("part").alias("part"))

    def read(spark: SparkSession, paths: dict[str, list[str]]) -> DataFrame:
        x = {k: spark.read.option("basePath", f"{folder}/{k}").parquet(*p).withColumn("part", F.col("part").cast("string")) for k, p in paths.items()}
        return x["count"].withColumnRenamed("x", "n").join(x["total"], ["event_type", "part"])

    keys = ["event_type", "part"]
    for _ in range(2):
        sets = N.complete_sets(files, "kind", ["count", "total"], keys, time.time() + 3600, 120)
        N.consolidate(sets, root, keys, read, 10)
    got = N.committed(spark, root, "event_type string, part string, n double, x double, batch_id int", "batch_id long")
    return rounded(got.select("event_type", "part", "batch_id", F.col("n").cast("long").alias("rows"), F.col("x").alias("total")), total=3)


@query(f"""WITH {R.PINGS}, s AS (SELECT mmsi, ts + to_minutes((event_id % 40)::INT) AS sample_ts FROM pings)
SELECT p.mmsi, count(*) AS pairs FROM pings p JOIN s ON s.mmsi = p.mmsi AND s.sample_ts BETWEEN p.ts - INTERVAL 10 MINUTE AND p.ts + INTERVAL 10 MINUTE GROUP BY p.mmsi""")
def stream_nearby_samples(spark: SparkSession, sf: str) -> DataFrame:
    """ST-07."""
    p = _pings(spark, sf)
    samples = p.select("mmsi", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 40 * 60_000_000).alias("sample_ts"))
    met = L.nearby_samples(_stream(spark, p), _stream(spark, samples), "mmsi").selectExpr("a.mmsi as mmsi", "a.ts as ts", "b.sample_ts as sample_ts")
    return L.drain(met)[0].groupBy("mmsi").agg(F.count(F.lit(1)).alias("pairs"))


@query(f"""WITH {R.PINGS}, ready AS (SELECT * FROM pings WHERE ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM pings)),
d AS (SELECT mmsi, epoch(ts - lag(ts) OVER w) / 3600.0 AS hours, {R.HAVERSINE.format(r='3440.065::DOUBLE', a='', b='p_')} AS nm
  FROM (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM ready WINDOW w AS (PARTITION BY mmsi ORDER BY ts, lat, lon)) WINDOW w AS (PARTITION BY mmsi ORDER BY ts, lat, lon))
SELECT mmsi, count(*) AS pings, count(*) FILTER (hours > 0 AND hours <= 2) AS with_speed, count(*) FILTER (hours > 0 AND hours <= 2 AND nm / hours > 45) AS alerts FROM d GROUP BY mmsi""")
def stream_vessel_state(spark: SparkSession, sf: str) -> DataFrame:
    """ST-08: pings in many files that come in three parts, each a run of the stream that goes on where the last one ended."""
    p = _pings(spark, sf)
    found = p.select(F.percentile_approx(F.unix_seconds("ts"), [1 / 3, 2 / 3]).alias("q"), F.count(F.lit(1)).alias("n")).first()
    times, files = found.q or [0, 0], max(4, math.ceil(found.n / 3 / TASK_ROWS))
    t, path, base = F.unix_seconds("ts"), scratch(spark), scratch(spark)
    with L.keyed_state(spark):
        for part in (t <= times[0], (t > times[0]) & (t <= times[1]), t > times[1]):
            p.filter(part).repartition(files, "event_id").write.mode("append").parquet(path)
            got, _ = L.drain(L.vessel_state(L.new_files(spark, p.schema, path, files)), base)
    return got.groupBy("mmsi").agg(F.count(F.lit(1)).alias("pings"), F.count("implied_knots").alias("with_speed"), F.count_if("alert").alias("alerts"))
