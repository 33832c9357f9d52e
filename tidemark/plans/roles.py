"""The given tables in the domain's roles, and the same in SQL.

Pings are `events`: a vessel is a user, times run 40 times as fast so that
pings form sessions, and places are offsets from the turbine where the
vessel lies for two hours at a time. Turbines are `supplier` by `nation`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import pieces

BASE = 1704067200  # 2024-01-01 UTC


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; times without a zone are taken as UTC, the session's zone."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def turbine_lat(k: Column) -> Column:
    return 54.0 + F.pmod(k * 37, F.lit(97)) * 0.01


def turbine_lon(k: Column) -> Column:
    return 6.0 + F.pmod(k * 53, F.lit(97)) * 0.02


def turbines(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        k.alias("found_id"), F.col("n_name").alias("wind_farm"), F.col("r_name").alias("country"), turbine_lat(k).alias("latitude"), turbine_lon(k).alias("longitude"),
        (2.0 + F.pmod(k, F.lit(9))).alias("rated_power"), (80.0 + F.pmod(k, F.lit(10)) * 12).alias("rotor_diameter"), F.add_months(F.lit("1996-01-01").cast("date"), F.pmod(k, F.lit(36)).cast("int")).alias("commissioning"),
    )


TURBINES = """turbines AS (
  SELECT s_suppkey AS found_id, n_name AS wind_farm, r_name AS country, 54.0::DOUBLE + (s_suppkey * 37 % 97) * 0.01::DOUBLE AS latitude,
         6.0::DOUBLE + (s_suppkey * 53 % 97) * 0.02::DOUBLE AS longitude, 2.0::DOUBLE + s_suppkey % 9 AS rated_power, 80.0::DOUBLE + (s_suppkey % 10) * 12 AS rotor_diameter,
         (DATE '1996-01-01' + to_months((s_suppkey % 36)::INT))::DATE AS commissioning
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def pings(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    sec = F.floor((F.unix_seconds("ts") - BASE) / 40)
    home = F.pmod(F.col("user_id") * 13 + F.floor(sec / 7200), F.lit(97)) + 1
    off = lambda m: (F.pmod(F.col("event_id") * m, F.lit(1000)) - 500) * 3e-6
    return e.select(
        "event_id", F.col("user_id").alias("mmsi"), F.timestamp_seconds(F.lit(BASE) + sec).alias("ts"), (turbine_lat(home) + off(7919)).alias("lat"), (turbine_lon(home) + off(6131)).alias("lon"),
        (F.pmod(F.col("event_id") * 31, F.lit(100)) / 100.0).alias("sog"), F.col("event_type").alias("ship_type"), F.concat(F.lit("V"), F.col("user_id").cast("string")).alias("name"),
        (10.0 + F.pmod(F.col("user_id"), F.lit(60))).alias("length"), (1.0 + F.pmod(F.col("event_id"), F.lit(7))).alias("draught"), "value",
    )


PINGS = """sec AS (SELECT *, (floor(epoch(ts))::BIGINT - 1704067200) // 40 AS sec FROM events),
home AS (SELECT *, (user_id * 13 + sec // 7200) % 97 + 1 AS home FROM sec),
pings AS (
  SELECT event_id, user_id AS mmsi, make_timestamp((1704067200 + sec) * 1000000) AS ts,
         54.0::DOUBLE + (home * 37 % 97) * 0.01::DOUBLE + (event_id * 7919 % 1000 - 500) * 3e-6 AS lat,
         6.0::DOUBLE + (home * 53 % 97) * 0.02::DOUBLE + (event_id * 6131 % 1000 - 500) * 3e-6 AS lon,
         (event_id * 31 % 100) / 100.0::DOUBLE AS sog, event_type AS ship_type, 'V' || user_id AS name,
         10.0::DOUBLE + user_id % 60 AS length, 1.0::DOUBLE + event_id % 7 AS draught, value
  FROM home)"""

HAVERSINE = "2 * {r} * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


# Dwell events for rates: one for each order, at a turbine by key, as orders cover years.
def dwells(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    # orders meet the turbines 1 to 97 alone: these are sent to the orders, which would else gather in 97 keys' tasks
    t = F.broadcast(turbines(spark, sf).filter(F.col("found_id").between(1, 97)).select(F.col("found_id").alias("t_id"), "wind_farm"))
    found = F.pmod(k * 17, F.lit(97)) + 1
    return o.withColumn("found_id", found).join(t, F.col("found_id") == F.col("t_id")).select(
        k.alias("dwell_id"), F.col("o_custkey").alias("mmsi"), "found_id", "wind_farm", F.col("o_orderdate").alias("start_utc"),
        F.timestamp_seconds(F.unix_seconds("o_orderdate") + F.pmod(k * 41, F.lit(300)) * 60).alias("end_utc"), F.pmod(k * 41, F.lit(300)).cast("double").alias("duration_min"),
        F.element_at(F.array(*map(F.lit, "ABCD")), (F.pmod(k, F.lit(4)) + 1).cast("int")).alias("dwell_tier"), (F.pmod(k * 7, F.lit(700)) * 1.0).alias("dist_m"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.floor(k / 50)).alias("duplicate_group_id"),
        F.when(F.pmod(k, F.lit(11)) != 0, F.pmod(k * 29, F.lit(400)) / 100.0).alias("hs"), F.when(F.pmod(k, F.lit(13)) != 0, 2.0 + F.pmod(k * 23, F.lit(1000)) / 100.0).alias("tp"),
        F.when(F.pmod(k, F.lit(7)) != 0, F.pmod(k * 19, F.lit(2500)) / 100.0).alias("wind_speed"), F.pmod(k * 43, F.lit(360)).cast("double").alias("wind_direction"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.pmod(k * 3, F.lit(150)) / 100.0).alias("current_speed"),
        F.when(F.pmod(k, F.lit(17)) != 0, F.pmod(k, F.lit(40)).cast("double")).alias("depth"), (F.pmod(k, F.lit(90)) / 10.0).alias("km"), F.col("o_totalprice").alias("price"),
    )


DWELLS = (
    TURBINES
    + """,
dwells AS (
  SELECT o_orderkey AS dwell_id, o_custkey AS mmsi, t.found_id, t.wind_farm, o_orderdate AS start_utc,
         make_timestamp((floor(epoch(o_orderdate))::BIGINT + (o_orderkey * 41 % 300) * 60) * 1000000) AS end_utc, (o_orderkey * 41 % 300)::DOUBLE AS duration_min,
         ['A', 'B', 'C', 'D'][o_orderkey % 4 + 1] AS dwell_tier, (o_orderkey * 7 % 700) * 1.0::DOUBLE AS dist_m,
         CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey // 50 END AS duplicate_group_id,
         CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 29 % 400) / 100.0::DOUBLE END AS hs, CASE WHEN o_orderkey % 13 <> 0 THEN 2.0::DOUBLE + (o_orderkey * 23 % 1000) / 100.0::DOUBLE END AS tp,
         CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 19 % 2500) / 100.0::DOUBLE END AS wind_speed, (o_orderkey * 43 % 360)::DOUBLE AS wind_direction,
         CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 3 % 150) / 100.0::DOUBLE END AS current_speed,
         CASE WHEN o_orderkey % 17 <> 0 THEN (o_orderkey % 40)::DOUBLE END AS depth, (o_orderkey % 90) / 10.0::DOUBLE AS km, o_totalprice AS price
  FROM orders JOIN turbines t ON t.found_id = o_orderkey * 17 % 97 + 1)"""
)


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Farm months with one or several statuses, from orders by customer nation."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    status = F.when(F.pmod(k, F.lit(50)) == 0, "success").when(F.pmod(k, F.lit(61)) == 0, "success_no_ais_in_bbox").when(F.pmod(k, F.lit(7)) == 0, "skipped_missing_source").otherwise("listed")
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("wind_farm"), F.trunc("o_orderdate", "MM").alias("month"), status.alias("status")).distinct()


MANIFEST = """manifest AS (
  SELECT DISTINCT n_name AS wind_farm, date_trunc('month', o_orderdate)::DATE AS month,
         CASE WHEN o_orderkey % 50 = 0 THEN 'success' WHEN o_orderkey % 61 = 0 THEN 'success_no_ais_in_bbox' WHEN o_orderkey % 7 = 0 THEN 'skipped_missing_source' ELSE 'listed' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Competing sources of one event: lines of an order, each three in a row an event."""
    before = F.col("l_linenumber") - 1
    line = table(spark, sf, "lineitem")
    n = pieces(line)
    line = line.select((F.col("l_orderkey") * 3 + F.floor(before / 3)).alias("l_orderkey"), (before % 3 + 1).alias("l_linenumber"), "l_quantity", "l_discount", "l_tax").repartition(n, "l_orderkey")
    k, i = F.col("l_orderkey"), F.col("l_linenumber")
    return line.groupBy(k.alias("dwell_id"), i.alias("i")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t")).select(
        "dwell_id", F.element_at(F.array(F.lit("nora3"), F.lit("nws"), F.lit("baltic")), F.col("i").cast("int")).alias("source"),
        (F.pmod(F.col("dwell_id"), F.lit(20)) / 10.0 + F.col("d")).alias("hs"), (4.0 + F.pmod(F.col("dwell_id"), F.lit(5)) + F.col("t") * 8).alias("tp"), F.pmod(F.col("q") * 7.2, F.lit(360.0)).alias("direction"),
        (0.5 + F.col("d")).alias("quality"), (F.pmod(F.col("dwell_id"), F.lit(9)) == 0).alias("shallow"),
    )


#: Lines, each three in a row an event.
EVENT_LINES = "(SELECT l_orderkey * 3 + (l_linenumber - 1) // 3 AS l_orderkey, (l_linenumber - 1) % 3 + 1 AS l_linenumber, l_discount, l_tax, l_quantity FROM lineitem)"
CANDIDATES = f"""candidates AS (
  SELECT l_orderkey AS dwell_id, ['nora3', 'nws', 'baltic'][l_linenumber] AS source, l_linenumber AS rank, (l_orderkey % 20) / 10.0::DOUBLE + max(l_discount) AS hs,
         4.0::DOUBLE + l_orderkey % 5 + max(l_tax) * 8 AS tp, (max(l_quantity) * 7.2::DOUBLE) % 360 AS direction, 0.5::DOUBLE + max(l_discount) AS quality, l_orderkey % 9 = 0 AS shallow
  FROM {EVENT_LINES} GROUP BY l_orderkey, l_linenumber)"""
