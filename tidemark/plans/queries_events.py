"""Queries on pings, dwell events and time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import angles, values
from tidemark.operators import farms as M
from tidemark.operators import pings as P
from tidemark.operators import timejoin as J
from tidemark.plans import roles as R
from tidemark.plans.register import query, rounded

DIST = R.HAVERSINE.format(r="6371000.0::DOUBLE", a="p.", b="t.")
MATCH = f"""slow AS (SELECT * FROM pings WHERE sog < 0.5),
near AS (
  SELECT p.*, t.found_id, t.wind_farm, {DIST} AS dist_m FROM slow p JOIN (SELECT found_id, wind_farm, latitude AS lat, longitude AS lon FROM turbines) t
  ON t.lat BETWEEN p.lat - 0.002 AND p.lat + 0.002 AND t.lon BETWEEN p.lon - 0.004 AND p.lon + 0.004),
best AS (SELECT * FROM near WHERE dist_m < 100 QUALIFY row_number() OVER (PARTITION BY mmsi, ts ORDER BY dist_m, found_id) = 1)"""
SESSIONS = """marked AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR found_id <> lag(found_id) OVER w THEN 1 ELSE 0 END AS is_new
  FROM best WINDOW w AS (PARTITION BY mmsi ORDER BY ts, found_id)),
numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY mmsi ORDER BY ts, found_id ROWS UNBOUNDED PRECEDING) AS event_id_s FROM marked),
dwell AS (
  SELECT mmsi, event_id_s::BIGINT AS event_id, wind_farm, found_id, min(ts) AS "start", max(ts) AS "end", count(*) AS ping_count, avg(sog) AS mean_sog, min(dist_m) AS min_dist,
         epoch(max(ts) - min(ts)) / 60.0 AS duration_min
  FROM numbered GROUP BY ALL HAVING epoch(max(ts) - min(ts)) / 60.0 >= 15)"""
WITH_PINGS = f"WITH {R.TURBINES}, {R.PINGS}"
WITH_DWELL = f"{WITH_PINGS}, {MATCH}, {SESSIONS}"


def _dwell(spark: SparkSession, sf: str) -> DataFrame:
    p = R.pings(spark, sf).drop("event_id")
    return P.dwell_events(p, R.turbines(spark, sf))


@query(f"""{WITH_DWELL} SELECT mmsi, event_id, wind_farm, found_id, "start", "end", ping_count, round(mean_sog, 6) AS mean_sog, round(min_dist, 3) AS min_dist, round(duration_min, 4) AS duration_min,
CASE WHEN duration_min < 720 THEN 'Transfer' WHEN duration_min <= 1440 THEN 'Extended' ELSE 'Stationary/Construction' END AS event_class FROM dwell""")
def dwell_events(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-06, JN-01, JN-02, WN-01, AG-03, AG-04."""
    return rounded(_dwell(spark, sf), mean_sog=6, min_dist=3, duration_min=4)


@query(f"""{WITH_DWELL},
kinds AS (SELECT mmsi, ship_type, count(*) AS n FROM pings GROUP BY ALL),
meta AS (SELECT mmsi, max(length) AS length, max(draught) AS draught, any_value(name) AS name FROM pings GROUP BY mmsi),
kind AS (SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY n DESC, ship_type) = 1)
SELECT d.mmsi, name, ship_type, wind_farm, round(sum(duration_min), 4) AS total_min, round(median(duration_min), 4) AS median_min, count(*) AS n_events, max(length) AS length, max(draught) AS draught,
       max(length) BETWEEN 10 AND 40 AND median(duration_min) < 120 AS probable_ctv
FROM dwell d JOIN meta USING (mmsi) JOIN kind USING (mmsi) GROUP BY d.mmsi, name, ship_type, wind_farm""")
def fleet_registry(spark: SparkSession, sf: str) -> DataFrame:
    """AG-02, AG-05, JN-12."""
    return rounded(P.fleet_registry(_dwell(spark, sf), P.vessel_metadata(R.pings(spark, sf))), total_min=4, median_min=4)


@query(f"""WITH {R.TURBINES}, {R.PINGS}, f AS (SELECT *, CASE WHEN NOT (lat BETWEEN 54.2 AND 54.8 AND lon BETWEEN 6.2 AND 7.6) THEN 'outside_region' WHEN sog > 0.6 THEN 'above_max_sog' END AS why FROM pings)
SELECT ship_type, count(*) AS seen, count(*) FILTER (why IS NULL) AS kept, 0::BIGINT AS bad_lat_lon, 0::BIGINT AS bad_sog, count(*) FILTER (why = 'outside_region') AS outside_region,
       count(*) FILTER (why = 'above_max_sog') AS above_max_sog, round(count(*) FILTER (why IS NULL) * 100.0::DOUBLE / count(*), 4) AS retention_pct FROM f GROUP BY ship_type""")
def reject_counts(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-02, FLT-04, FLT-05."""
    return P.reject_counts(R.pings(spark, sf), "ship_type", box=(54.2, 54.8, 6.2, 7.6), max_sog=0.6)


@query(f"""{WITH_PINGS}, box AS (
  SELECT wind_farm, min(latitude) - 2 / 60.0::DOUBLE AS a, max(latitude) + 2 / 60.0::DOUBLE AS b,
         min(longitude) - 2 / (60.0::DOUBLE * greatest(cos(radians((min(latitude) + max(latitude)) / 2)), 0.01)) AS c, max(longitude) + 2 / (60.0::DOUBLE * greatest(cos(radians((min(latitude) + max(latitude)) / 2)), 0.01)) AS d
  FROM turbines GROUP BY wind_farm)
SELECT mmsi, count(*) AS pings FROM pings p WHERE EXISTS (SELECT 1 FROM box WHERE lat BETWEEN a AND b AND lon BETWEEN c AND d) GROUP BY mmsi""")
def farm_candidate_pings(spark: SparkSession, sf: str) -> DataFrame:
    """AG-01, FLT-03."""
    boxes = P.farm_boxes(R.turbines(spark, sf), 2.0)
    return P.in_any_box(R.pings(spark, sf), boxes).groupBy("mmsi").agg(F.count(F.lit(1)).alias("pings"))


@query(f"""{WITH_PINGS}, near AS (
  SELECT p.*, t.found_id, {DIST} AS dist_m FROM pings p JOIN (SELECT found_id, latitude AS lat, longitude AS lon FROM turbines WHERE wind_farm = 'NATION_7') t
  ON t.lat BETWEEN p.lat - 0.002 AND p.lat + 0.002 AND t.lon BETWEEN p.lon - 0.004 AND p.lon + 0.004 WHERE sog < 1.0)
SELECT mmsi, count(DISTINCT ts) AS pings FROM near WHERE dist_m < 100 GROUP BY mmsi""")
def candidate_vessels(spark: SparkSession, sf: str) -> DataFrame:
    """AG-06."""
    return P.candidate_vessels(R.pings(spark, sf), R.turbines(spark, sf), "NATION_7")


@query(f"WITH {R.PINGS} SELECT mmsi, count(*) AS pings, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM pings WHERE lat BETWEEN 54 AND 54.5 AND lon BETWEEN 6 AND 7 AND sog < 0.4 GROUP BY mmsi")
def slow_in_box(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-15."""
    return rounded(P.slow_in_box(R.pings(spark, sf), (54.0, 54.5, 6.0, 7.0), 0.4), lat=6, lon=6)


@query(f"""WITH {R.PINGS}, d AS (
  SELECT *, epoch(ts - lag(ts) OVER w) / 3600.0 AS hours, {R.HAVERSINE.format(r='3440.065::DOUBLE', a='', b='p_')} AS nm
  FROM (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM pings WINDOW w AS (PARTITION BY mmsi ORDER BY ts, lat, lon)) WINDOW w AS (PARTITION BY mmsi ORDER BY ts, lat, lon)),
k AS (SELECT *, CASE WHEN hours > 0 THEN nm / hours END AS knots FROM d)
SELECT mmsi, count(*) AS kept, round(max(knots), 4) AS max_knots FROM k WHERE knots IS NULL OR knots <= 20 GROUP BY mmsi""")
def clean_track(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-07 (our definition)."""
    c = P.clean_track(R.pings(spark, sf), 20.0)
    return rounded(c.groupBy("mmsi").agg(F.count(F.lit(1)).alias("kept"), F.max("implied_knots").alias("max_knots")), max_knots=4)


@query(f"""{WITH_DWELL},
place AS (SELECT d.*, t.latitude AS lat, t.longitude AS lon FROM dwell d JOIN turbines t USING (found_id)),
prev AS (SELECT *, lag("end") OVER w AS p_end, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM place WINDOW w AS (PARTITION BY mmsi ORDER BY "start", "end")),
j AS (SELECT *, epoch("start" - p_end) / 3600.0 AS hours, {R.HAVERSINE.format(r='3440.065::DOUBLE', a='', b='p_')} AS nm FROM prev)
SELECT mmsi, event_id, round(nm, 4) AS nm, round(hours, 4) AS hours, CASE WHEN hours < 0 THEN 'overlap' WHEN hours = 0 AND nm > 0 THEN 'moved_in_no_time' ELSE 'too_fast' END AS reason
FROM j WHERE hours < 0 OR (hours = 0 AND nm > 0) OR (hours > 0 AND nm / hours > 5)""")
def impossible_jumps(spark: SparkSession, sf: str) -> DataFrame:
    """JN-16, SC-19."""
    t = R.turbines(spark, sf).select("found_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return rounded(P.impossible_jumps(_dwell(spark, sf).join(t, "found_id"), 5.0).select("mmsi", "event_id", "nm", "hours", "reason"), nm=4, hours=4)


@query(f"""WITH {R.PINGS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 20 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM pings WINDOW w AS (PARTITION BY mmsi ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY mmsi ORDER BY ts) AS span FROM g)
SELECT mmsi, span::BIGINT AS span, min(ts) AS first, max(ts) AS last, count(*) AS rows FROM s GROUP BY ALL""")
def islands(spark: SparkSession, sf: str) -> DataFrame:
    """WN-08."""
    return J.islands(R.pings(spark, sf), ["mmsi"], "ts", 1200)


_INTERVALS = """iv AS (SELECT user_id AS mmsi, event_id, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS "start", to_timestamp(floor(epoch(ts)) + event_id % 7 * 1800)::TIMESTAMP AS "end" FROM events)"""


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    e = R.table(spark, sf, "events")
    s = F.unix_seconds("ts")
    return e.select(F.col("user_id").alias("mmsi"), "event_id", F.timestamp_seconds(s).alias("start"), F.timestamp_seconds(s + F.pmod("event_id", F.lit(7)) * 1800).alias("end"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return R.table(spark, sf, "events").select(F.col("user_id").alias("mmsi"), F.timestamp_seconds(F.unix_seconds("ts")).alias("ts"), "value", F.col("event_id").alias("sample"))


_SAMPLES = "sm AS (SELECT user_id AS mmsi, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS ts, value, event_id AS sample FROM events)"


@query(f'WITH {_INTERVALS}, {_SAMPLES} SELECT event_id, sample, round(value, 4) AS value FROM sm JOIN iv ON sm.mmsi = iv.mmsi AND ts BETWEEN "start" AND "end"')
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """JN-05."""
    return rounded(J.interval_join(_samples(spark, sf), _intervals(spark, sf), ["mmsi"]).select("event_id", "sample", "value"), value=4)


@query(f"""WITH {_INTERVALS}, {_SAMPLES}, near AS (
  SELECT iv.event_id, sm.value, sm.sample, abs(epoch(sm.ts) - epoch(iv."start")) AS gap FROM iv JOIN sm ON sm.mmsi = iv.mmsi AND abs(epoch(sm.ts) - epoch(iv."start")) <= 14400
  QUALIFY row_number() OVER (PARTITION BY iv.event_id ORDER BY abs(epoch(sm.ts) - epoch(iv."start")), sm.ts, '{{"sample":' || sm.sample || '}}') = 1)
SELECT iv.event_id, near.sample, near.gap AS gap_s FROM iv LEFT JOIN near USING (event_id)""")
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """JN-07."""
    left = _intervals(spark, sf).select("mmsi", "event_id", F.col("start").alias("ts"))
    return J.asof_nearest(left, _samples(spark, sf), ["mmsi"], ["sample"], 14400).select("event_id", "sample", "gap_s")


@query(f"""WITH {_INTERVALS}, {_SAMPLES},
w AS (SELECT event_id, avg(value) AS v, count(*) AS n FROM iv JOIN sm ON sm.mmsi = iv.mmsi AND ts BETWEEN "start" AND "end" GROUP BY event_id),
near AS (
  SELECT iv.event_id, sm.value FROM iv JOIN sm ON sm.mmsi = iv.mmsi AND abs(epoch(sm.ts) - (epoch("start") + epoch("end")) / 2) <= 10800
  QUALIFY row_number() OVER (PARTITION BY iv.event_id ORDER BY abs(epoch(sm.ts) - (epoch("start") + epoch("end")) / 2), sm.ts) = 1)
SELECT event_id, round(coalesce(v, value), 4) AS value, coalesce(n, CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) AS n_samples, CASE WHEN n > 0 THEN 'window' WHEN value IS NOT NULL THEN 'nearest' END AS method,
       CASE WHEN v IS NULL AND value IS NULL THEN 'no_samples_in_tolerance' END AS missing_reason
FROM iv LEFT JOIN w USING (event_id) LEFT JOIN near USING (event_id)""")
def window_or_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """JN-06."""
    return rounded(J.window_or_nearest(_intervals(spark, sf), _samples(spark, sf), ["mmsi"], "value", 10800), value=4)


@query(f"""WITH {_INTERVALS}, {_SAMPLES}, one AS (SELECT mmsi, ts, avg(value) AS v, sum(value) AS s, count(value) AS full_, count(*) AS n FROM sm GROUP BY mmsi, ts),
g AS (SELECT iv.event_id, sum(s) FILTER (ts BETWEEN "start" AND "end") AS s, sum(full_) FILTER (ts BETWEEN "start" AND "end") AS full_, sum(n) FILTER (ts BETWEEN "start" AND "end") AS n,
             max_by(v, ts) FILTER (ts <= "start") AS b, min_by(v, ts) FILTER (ts >= "end") AS a, bool_or(ts <= "start") AND bool_or(ts >= "end") AS pair,
             min(abs(epoch(ts) - (epoch("start") + epoch("end")) / 2)) / 60 AS gap_min FROM iv JOIN one USING (mmsi) GROUP BY iv.event_id)
SELECT event_id, round(CASE WHEN n > 0 THEN s / full_ WHEN pair THEN (b + a) / 2 END, 4) AS value, coalesce(n, 0)::BIGINT AS n_inside, coalesce(pair, false) AS bracketed, round(gap_min, 4) AS gap_min,
       CASE WHEN n > 0 THEN 'window' WHEN pair THEN 'bracket' ELSE 'not_assigned' END AS method, CASE WHEN n > 0 OR pair THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS missing_fraction,
       CASE WHEN NOT coalesce(n > 0 OR pair, false) THEN 'no_assignable_samples' END AS missing_reason
FROM iv LEFT JOIN g USING (event_id)""")
def bracketed(spark: SparkSession, sf: str) -> DataFrame:
    """JN-08."""
    return rounded(J.bracketed(_intervals(spark, sf), _samples(spark, sf), ["mmsi"], "value"), value=4, gap_min=4)


@query(f"""WITH {_INTERVALS}, b AS (SELECT mmsi, event_id AS b_id, "start" + INTERVAL 1 HOUR AS b_start, "end" + INTERVAL 90 MINUTE AS b_end FROM iv)
SELECT event_id, b_id, round(epoch(least("end", b_end) - greatest("start", b_start)) / 60, 4) AS overlap_min, round(epoch(least("end", b_end) - greatest("start", b_start)) / nullif(epoch("end" - "start"), 0), 6) AS overlap_fraction
FROM iv JOIN b USING (mmsi) WHERE greatest("start", b_start) < least("end", b_end)""")
def overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """JN-23."""
    a = _intervals(spark, sf)
    b = a.select("mmsi", F.col("event_id").alias("b_id"), (F.col("start") + F.expr("interval 1 hour")).alias("b_start"), (F.col("end") + F.expr("interval 90 minutes")).alias("b_end"))
    return rounded(J.overlap_join(a, b, ["mmsi"]).select("event_id", "b_id", "overlap_min", "overlap_fraction"), overlap_min=4, overlap_fraction=6)


@query(f"""WITH {_INTERVALS} SELECT event_id, unnest(generate_series(to_timestamp(floor(epoch("start") / 600) * 600)::TIMESTAMP, to_timestamp(ceil(epoch("end") / 600) * 600)::TIMESTAMP, INTERVAL 10 MINUTE)) AS ts FROM iv""")
def ten_minute_grid(spark: SparkSession, sf: str) -> DataFrame:
    """TG-01."""
    return J.grid(_intervals(spark, sf)).select("event_id", "ts")


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(v) AS value FROM (SELECT event_type, ts, avg(value) AS v FROM events GROUP BY ALL) GROUP BY ALL)
SELECT event_type, hour, round(value, 6) AS value FROM h""")
def hourly_mean(spark: SparkSession, sf: str) -> DataFrame:
    """AG-48, TG-04."""
    from tidemark.operators.stats import hourly_mean as mean

    return rounded(mean(R.table(spark, sf, "events"), ["event_type"], "value"), value=6)


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL),
seg AS (SELECT event_type, ts AS t0, value AS v0, lead(ts) OVER w AS t1, lead(value) OVER w AS v1 FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 20 MINUTE)) AS ts FROM h GROUP BY event_type)
SELECT g.event_type, g.ts, round(CASE WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (epoch(g.ts) - epoch(t0)) / (epoch(t1) - epoch(t0)) END, 6) AS value
FROM g JOIN seg ON g.event_type = seg.event_type AND g.ts >= t0 AND (g.ts < t1 OR t1 IS NULL)""")
def interpolated(spark: SparkSession, sf: str) -> DataFrame:
    """TG-02 (linear part), WN-10, WN-11."""
    h = R.table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))
    span = h.groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    g = span.select("event_type", F.explode(F.sequence("a", "b", F.expr("interval 20 minutes"))).alias("ts"))
    return rounded(J.interpolate(g, h, ["event_type"], ["value"]), value=6)


@query("""WITH a AS (SELECT user_id, ts, avg(value) AS x FROM events WHERE event_type IN ('click', 'view') OR value < 60 GROUP BY ALL), b AS (SELECT user_id, ts, avg(value) AS y FROM events WHERE value > 40 GROUP BY ALL)
SELECT user_id, ts, round(x, 4) AS x, round(y, 4) AS y FROM a FULL JOIN b USING (user_id, ts)""")
def full_time_join(spark: SparkSession, sf: str) -> DataFrame:
    """JN-13, JN-14, WN-13."""
    e = R.table(spark, sf, "events")
    a = e.filter("event_type in ('click', 'view') or value < 60").groupBy("user_id", "ts").agg(F.avg("value").alias("x"))
    b = e.filter("value > 40").groupBy("user_id", "ts").agg(F.avg("value").alias("y"))
    return rounded(J.full_time_join(a, b, ["user_id", "ts"]), x=4, y=4)


@query("""SELECT o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate)::DATE, date_trunc('month', o_orderdate + INTERVAL 70 DAY)::DATE, INTERVAL 1 MONTH))::DATE::VARCHAR AS month FROM orders""")
def months_touched(spark: SparkSession, sf: str) -> DataFrame:
    """TG-06."""
    o = R.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"), F.to_date(F.col("o_orderdate") + F.expr("interval 70 days")).alias("b"))
    return J.months(o, "a", "b").select("o_orderkey", F.col("month").cast("string").alias("month"))


@query("""WITH a AS (SELECT event_type, user_id, (value * 7.2) % 360 AS deg FROM events)
SELECT event_type, user_id, count(*) AS n, round((degrees(atan2(avg(sin(radians(deg))), avg(cos(radians(deg))))) + 360) % 360, 3) AS mean_direction, round(1 - sqrt(avg(sin(radians(deg))) ** 2 + avg(cos(radians(deg))) ** 2), 5) AS variance,
       round(avg(abs((deg - 90 + 180 + 360) % 360 - 180)), 4) AS from_east FROM a GROUP BY ALL""")
def circular_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """FX-04, FX-05, AG-25."""
    e = R.table(spark, sf, "events").withColumn("deg", angles.wrap(F.col("value") * 7.2))
    out = e.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), angles.mean_direction(F.col("deg")).alias("mean_direction"), angles.circular_variance(F.col("deg")).alias("variance"), F.avg(angles.difference(F.col("deg"), F.lit(90.0))).alias("from_east"))
    return rounded(out, mean_direction=3, variance=5, from_east=4)


@query("""WITH a AS (SELECT event_id, value, (value * 7.2) % 360 AS deg, ((event_id * 37) % 360)::DOUBLE AS other FROM events),
c AS (SELECT *, sin(radians(deg)) * 0.75 + sin(radians(other)) * 0.25 AS s, cos(radians(deg)) * 0.75 + cos(radians(other)) * 0.25 AS k FROM a)
SELECT event_id, ['N','NE','E','SE','S','SW','W','NW'][(floor(((deg + 22.5) % 360) / 45))::INT + 1] AS sector, CASE WHEN sqrt(s * s + k * k) >= 0.0001 THEN round((degrees(atan2(s, k)) + 360) % 360, 2) % 360 END AS between_directions,
       round(sqrt(s * s + k * k), 5) AS speed, round(floor(value / 25) * 25, 2) AS bin_left, round((ceil(value / 25) - 1) * 25, 2) AS bin_right_closed FROM c""")
def directions_and_bins(spark: SparkSession, sf: str) -> DataFrame:
    """FX-06, FX-07, FX-15, FX-18."""
    e = R.table(spark, sf, "events").withColumns({"deg": angles.wrap(F.col("value") * 7.2), "other": F.pmod(F.col("event_id") * 37, F.lit(360)).cast("double")})
    (a, b), (c, d) = angles.components(F.col("deg")), angles.components(F.col("other"))
    e = e.withColumns({"s": a * 0.75 + c * 0.25, "k": b * 0.75 + d * 0.25})
    speed, _ = angles.speed_direction(F.col("s"), F.col("k"))
    out = e.select("event_id", angles.sector(F.col("deg")).alias("sector"), angles.interpolate(F.col("deg"), F.col("other"), F.lit(0.25)).alias("between_directions"), speed.alias("speed"), values.left_closed_bin(F.col("value"), 25.0).alias("bin_left"), values.right_closed_bin(F.col("value"), 25.0).alias("bin_right_closed"))
    calm = F.when(F.col("speed") >= 0.0001, F.round("between_directions", 2) % 360)
    return rounded(out.withColumn("between_directions", calm), speed=5, bin_left=2, bin_right_closed=2)


@query(f"""WITH {R.TURBINES}, q AS (SELECT a.found_id, b.found_id AS nearest, {R.HAVERSINE.format(r='6371.0088::DOUBLE', a='a.', b='b.')} AS km
  FROM (SELECT found_id, wind_farm, latitude AS lat, longitude AS lon FROM turbines) a JOIN (SELECT found_id, wind_farm, latitude AS lat, longitude AS lon FROM turbines) b ON a.wind_farm = b.wind_farm AND a.found_id <> b.found_id)
SELECT found_id, arg_min(nearest, struct_pack(k := km, f := nearest)) AS nearest, round(min(km), 4) AS km, CASE WHEN min(km) * 1000 <= 20000 THEN 'near' ELSE 'far' END AS band FROM q GROUP BY found_id""")
def nearest_neighbour_turbine(spark: SparkSession, sf: str) -> DataFrame:
    """JN-04: nearest in space within a group; FX-01."""
    out = M.nearest_neighbours(R.turbines(spark, sf))
    return rounded(out.withColumn("band", F.when(F.col("km") * 1000 <= 20000, "near").otherwise("far")), km=4)
