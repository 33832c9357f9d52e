"""Queries on farms, feature matrices, sources and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo, values
from tidemark.operators import audit as A
from tidemark.operators import evidence as E
from tidemark.operators import farms as M
from tidemark.operators import intensity as I
from tidemark.operators import matrix as X
from tidemark.operators import pings as P
from tidemark.operators import stats as S
from tidemark.plans import roles as R
from tidemark.plans.register import query, rounded


@query(f"""WITH {R.TURBINES} SELECT wind_farm, count(*) AS turbines, min(commissioning)::VARCHAR AS operation_start, round(min(latitude) - 0.25, 5) AS min_lat, round(max(latitude) + 0.25, 5) AS max_lat,
round(min(longitude) - 0.25, 5) AS min_lon, round(max(longitude) + 0.25, 5) AS max_lon FROM turbines GROUP BY wind_farm""")
def farm_requirements(spark: SparkSession, sf: str) -> DataFrame:
    """AG-45, AG-69."""
    out = M.requirements(R.turbines(spark, sf)).drop("needs_review").withColumn("operation_start", F.col("operation_start").cast("string"))
    return rounded(out, min_lat=5, max_lat=5, min_lon=5, max_lon=5)


@query(f"""WITH {R.TURBINES}, b AS (SELECT wind_farm, min(latitude) - 0.25 AS a, max(latitude) + 0.25 AS b, min(longitude) - 0.25 AS c, max(longitude) + 0.25 AS d FROM turbines GROUP BY wind_farm)
SELECT wind_farm, ((floor(b) - floor(a) + 1) * (floor(d) - floor(c) + 1))::BIGINT AS tiles FROM b""")
def degree_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """AG-66."""
    return M.degree_tiles(M.requirements(R.turbines(spark, sf)))


_FARM_YEARS = f"""{R.DWELLS}, fy AS (SELECT wind_farm, year(start_utc) AS year, count(*) AS events, count(hs) AS valid_waves, round(quantile_cont(depth, 0.5), 4) AS median_depth, wind_farm <> 'NATION_3' AS in_domain FROM dwells WHERE dwell_tier = 'A' GROUP BY ALL),
rec AS (SELECT *, CASE WHEN in_domain AND events >= 20 AND valid_waves > 0 AND NOT coalesce(median_depth <= 5, false) THEN 'yes' WHEN in_domain AND events >= 3 THEN 'stress_test_only' ELSE 'no' END AS recommendation,
  concat_ws('; ', CASE WHEN NOT in_domain THEN 'outside_domain' END, CASE WHEN events < 20 THEN 'few_events' END, CASE WHEN valid_waves = 0 THEN 'no_valid_waves' END, CASE WHEN median_depth <= 5 THEN 'shallow' END) AS reason FROM fy)"""


def _farm_years(spark: SparkSession, sf: str) -> DataFrame:
    d = R.dwells(spark, sf).filter("dwell_tier = 'A'")
    fy = d.groupBy("wind_farm", F.year("start_utc").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("events"), F.count("hs").alias("valid_waves"), F.round(F.percentile("depth", 0.5), 4).alias("median_depth"))
    return M.recommend(fy.withColumn("in_domain", F.col("wind_farm") != "NATION_3"), 20, 3)


@query(f"WITH {_FARM_YEARS} SELECT wind_farm, year, events, valid_waves, median_depth, in_domain, recommendation, reason FROM rec")
def farm_year_recommendation(spark: SparkSession, sf: str) -> DataFrame:
    """AG-43 (farm years), SC-13."""
    return _farm_years(spark, sf)


@query(f"WITH {_FARM_YEARS} SELECT wind_farm, year, events FROM rec WHERE recommendation = 'yes' ORDER BY events DESC, wind_farm, year LIMIT 10")
def top_recommended(spark: SparkSession, sf: str) -> DataFrame:
    """TK-04."""
    return M.top_recommended(_farm_years(spark, sf), 10).select("wind_farm", "year", "events")


@query(f"""WITH {R.DWELLS}, l AS (SELECT quantile_cont(hs, 0.9) AS h, quantile_cont(wind_speed, 0.9) AS w, quantile_cont(tp, 0.9) AS t FROM dwells)
SELECT 'hs+wind_speed' AS "case", count(*) FILTER (hs >= h AND wind_speed >= w) AS rows FROM dwells, l UNION ALL SELECT 'hs+tp', count(*) FILTER (hs >= h AND tp >= t) FROM dwells, l""")
def interaction_cases(spark: SparkSession, sf: str) -> DataFrame:
    """AG-41."""
    return M.interaction_cases(R.dwells(spark, sf), [("hs", "wind_speed"), ("hs", "tp")])


@query(f"WITH {R.TURBINES} SELECT wind_farm, count(*) AS turbines, string_agg(DISTINCT country, '; ' ORDER BY country) AS country, string_agg(DISTINCT rotor_diameter::INT::VARCHAR, '; ' ORDER BY rotor_diameter::INT::VARCHAR) AS rotor FROM turbines GROUP BY wind_farm")
def attribute_lists(spark: SparkSession, sf: str) -> DataFrame:
    """AG-55."""
    return M.attribute_lists(R.turbines(spark, sf).withColumn("rotor", F.col("rotor_diameter").cast("int")), ["country", "rotor"])


@query(f"""WITH {R.DWELLS}, c AS (SELECT wind_farm, avg(latitude) AS la, avg(longitude) AS lo FROM turbines GROUP BY wind_farm)
SELECT dwell_id, round(latitude, 5) AS asset_lat, round(c.la, 5) AS farm_lat, 'asset' AS asset_status, 'farm' AS farm_status FROM dwells d JOIN turbines t USING (found_id) JOIN c ON c.wind_farm = d.wind_farm""")
def event_points(spark: SparkSession, sf: str) -> DataFrame:
    """JN-21."""
    d, t = R.dwells(spark, sf).select("dwell_id", "found_id", "wind_farm"), R.turbines(spark, sf)
    a = M.event_points(d, t, "asset").select("dwell_id", F.col("point_lat").alias("asset_lat"), F.col("point_status").alias("asset_status"))
    f = M.event_points(d, t, "farm").select("dwell_id", F.col("point_lat").alias("farm_lat"), F.col("point_status").alias("farm_status"))
    return rounded(a.join(f, "dwell_id"), asset_lat=5, farm_lat=5)


@query("""WITH m AS (SELECT user_id, event_type, value, (value * 7.2) % 360 AS deg FROM events), n AS (SELECT user_id, event_type, count(*) AS n FROM m GROUP BY ALL),
top AS (SELECT user_id, event_type AS dominant_label, n / sum(n) OVER (PARTITION BY user_id) AS dominant_share FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1),
a AS (SELECT user_id, count(*) AS rows, count(*) / 6.0 AS duration_h, avg(value) AS value_mean, max(value) AS value_max, min(value) AS value_min, stddev_pop(value) AS value_std,
             (degrees(atan2(avg(sin(radians(deg))), avg(cos(radians(deg))))) + 360) % 360 AS deg_mean FROM m GROUP BY user_id)
SELECT user_id, rows, round(duration_h, 5) AS duration_h, round(value_mean, 5) AS value_mean, value_max, value_min, round(value_std, 5) AS value_std, round(deg_mean, 2) AS deg_mean, dominant_label, round(dominant_share, 6) AS dominant_share FROM a JOIN top USING (user_id)""")
def event_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """AG-24."""
    e = R.table(spark, sf, "events").withColumn("deg", F.pmod(F.col("value") * 7.2, F.lit(360.0)))
    out = X.event_aggregates(e, ["user_id"], ["value"], ["deg"], "event_type").drop("value_null_share", "deg_variance")
    return rounded(out, duration_h=5, value_mean=5, value_std=5, deg_mean=2, dominant_share=6)


@query("""WITH p AS (SELECT user_id, event_id % 2 AS lab, quantile_cont(value, 0.5) AS m FROM events GROUP BY ALL)
SELECT a.user_id, round(a.m, 5) AS median_0, round(b.m, 5) AS median_1 FROM p a JOIN p b ON a.user_id = b.user_id AND a.lab = 0 AND b.lab = 1""")
def paired_medians(spark: SparkSession, sf: str) -> DataFrame:
    """AG-59."""
    e = R.table(spark, sf, "events").withColumn("lab", (F.col("event_id") % 2).cast("int"))
    return rounded(X.paired_medians(e, "user_id", "lab", "value"), median_0=5, median_1=5)


@query("""WITH n AS (SELECT date_trunc('hour', ts) AS ts, event_id % 6 AS status, count(*) AS n FROM events GROUP BY ALL)
SELECT ts, (arg_min(status, -n * 100 + status))::BIGINT AS mode, round(coalesce(sum(n) FILTER (status IN (3, 4)), 0) / sum(n), 6) AS service_share FROM n GROUP BY ts""")
def status_profile(spark: SparkSession, sf: str) -> DataFrame:
    """AG-54."""
    s = R.table(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("ts"), (F.col("event_id") % 6).alias("status"))
    return rounded(X.status_profile(s).drop("down_share"), service_share=6)


@query("""WITH e AS (SELECT event_id, user_id % 97 AS found_id, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS s, to_timestamp(floor(epoch(ts)) + 3600)::TIMESTAMP AS t FROM events),
g AS (SELECT event_id, found_id, unnest(generate_series(to_timestamp(floor(epoch(s) / 600) * 600)::TIMESTAMP, to_timestamp(ceil(epoch(t) / 600) * 600)::TIMESTAMP, INTERVAL 10 MINUTE)) AS ts FROM e),
st AS (SELECT user_id % 97 AS found_id, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS ts, event_id % 6 AS status, event_id FROM events),
near AS (SELECT g.event_id, g.ts, st.status FROM g JOIN st ON st.found_id = g.found_id AND abs(epoch(st.ts) - epoch(g.ts)) <= 600 QUALIFY row_number() OVER (PARTITION BY g.event_id, g.ts ORDER BY abs(epoch(st.ts) - epoch(g.ts)), st.ts, '{"status":' || st.status) = 1)
SELECT g.event_id, g.ts, status, CASE WHEN status IS NULL THEN 'unknown' WHEN status IN (3, 4) THEN 'service' WHEN status IN (1, 2, 5) THEN 'downtime_visit' ELSE 'inspection' END AS label FROM g LEFT JOIN near ON g.event_id = near.event_id AND g.ts = near.ts""")
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """TG-05, SC-15."""
    e = R.table(spark, sf, "events")
    s = F.unix_seconds("ts")
    ev = e.select("event_id", (F.col("user_id") % 97).alias("found_id"), F.timestamp_seconds(s).alias("start"), F.timestamp_seconds(s + 3600).alias("end"), F.lit(60.0).alias("duration_min"), F.lit(50.0).alias("min_dist"))
    st = e.select((F.col("user_id") % 97).alias("found_id"), F.timestamp_seconds(s).alias("ts"), (F.col("event_id") % 6).alias("status"))
    met = e.select((F.col("user_id") % 97).alias("found_id"), F.timestamp_seconds(s).alias("ts"), "value")
    return X.feature_matrix(ev, st, met, ["value"]).select("event_id", "ts", "status", "label")


@query("""WITH b AS (SELECT user_id % 5 AS asset, (floor(value / 14 / 0.5) + 0.5) * 0.5 AS wind, avg((event_id % 100) / 100.0::DOUBLE) AS power, count(*) AS n FROM events WHERE event_id % 3 IN (0, 1) AND value / 14 BETWEEN 0 AND 35 GROUP BY ALL HAVING count(*) >= 30)
SELECT asset, wind, round(power, 6) AS power, n FROM b WHERE wind BETWEEN 4 AND 25""")
def power_curve(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-14 (status and limits), AG-53 (bins)."""
    e = R.table(spark, sf, "events").select((F.col("user_id") % 5).alias("asset"), (F.col("value") / 14).alias("wind"), ((F.col("event_id") % 100) / 100.0).alias("power"), (F.col("event_id") % 3).alias("status"))
    return rounded(S.power_curve(e, "asset", "wind", "power"), power=6)


@query("""SELECT s_suppkey, CASE WHEN r_name = 'EUROPE' AND 6.0::DOUBLE + (s_suppkey * 53 % 97) * 0.06 < 9.5 THEN 'north_sea' WHEN r_name = 'EUROPE' THEN 'baltic_sea' WHEN r_name = 'ASIA' THEN 'baltic_sea' ELSE 'unknown' END AS basin,
CASE WHEN s_suppkey % 40 < 5 THEN '<5y' WHEN s_suppkey % 40 < 10 THEN '5-10y' WHEN s_suppkey % 40 < 20 THEN '10-20y' ELSE '>=20y' END AS age_band FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def basins_and_bands(spark: SparkSession, sf: str) -> DataFrame:
    """SC-16, SC-17 (bands)."""
    t = R.turbines(spark, sf)
    lon = 6.0 + F.pmod(F.col("found_id") * 53, F.lit(97)) * 0.06
    country = F.when(F.col("country") == "EUROPE", "Germany").when(F.col("country") == "ASIA", "Poland").otherwise("none")
    return t.select(F.col("found_id").alias("s_suppkey"), I.sea_basin(country, lon).alias("basin"), I.band(F.col("found_id") % 40, [5, 10, 20], "y").alias("age_band"))


@query(f"""WITH {R.DWELLS}, x AS (SELECT dwell_id, ((hs IS NOT NULL)::INT + (tp IS NOT NULL)::INT + (depth IS NOT NULL)::INT) / 3.0::DOUBLE AS comp, (dwell_id % 200)::DOUBLE AS gap, km, dwell_id % 2 = 0 AS br, coalesce(depth <= 10, false) AS sh FROM dwells)
SELECT dwell_id, round((0.4 * comp + 0.3 * (CASE WHEN gap <= 30 THEN 1.0 WHEN gap <= 60 THEN 0.8 WHEN gap <= 180 THEN 0.5 ELSE 0 END) * (CASE WHEN br THEN 1.0 ELSE 0.8 END) + 0.2 * (CASE WHEN km <= 2 THEN 1.0 WHEN km <= 5 THEN 0.8 WHEN km <= 10 THEN 0.6 WHEN km <= 25 THEN 0.3 ELSE 0 END) + 0.1)
  * (CASE WHEN sh THEN 0.85 ELSE 1 END), 6) AS quality, sh OR coalesce(km > 5, false) AS coastal FROM x""")
def candidate_quality(spark: SparkSession, sf: str) -> DataFrame:
    """SC-04, SC-25, FX-08."""
    d = R.dwells(spark, sf)
    f = E.depth_flags(F.col("depth"), F.col("km"))
    q = E.quality_score({"completeness": E.completeness(F.col("hs"), F.col("tp"), F.col("depth")), "gap_min": (F.col("dwell_id") % 200).cast("double"), "km": F.col("km"), "bracketed": F.col("dwell_id") % 2 == 0, "in_domain": F.lit(True), "shallow": f["shallow"]})
    return rounded(d.select("dwell_id", q.alias("quality"), f["coastal_complexity"].alias("coastal")), quality=6)


@query(f"WITH {R.DWELLS} SELECT dwell_id, CASE WHEN current_speed IS NOT NULL THEN 'baltic' WHEN wind_speed IS NOT NULL THEN 'nws' WHEN hs IS NOT NULL THEN 'nora3' ELSE 'missing' END AS source FROM dwells")
def source_priority(spark: SparkSession, sf: str) -> DataFrame:
    """SC-02."""
    return R.dwells(spark, sf).select("dwell_id", E.choose_source(("baltic", F.col("current_speed")), ("nws", F.col("wind_speed")), ("nora3", F.col("hs"))).alias("source"))


@query("""WITH v AS (SELECT c_custkey AS mmsi, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS ship_type, CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey % 200)::DOUBLE END AS length FROM customer)
SELECT mmsi, concat_ws('; ', CASE WHEN contains(lower(ship_type), 'auto') THEN 'type_auto' END, CASE WHEN ship_type IS NULL THEN 'type_missing' END, CASE WHEN length IS NULL THEN 'length_missing' END, CASE WHEN length < 5 THEN 'length_below_5' END, CASE WHEN length > 180 THEN 'length_above_180' END) AS suspect_reason
FROM v WHERE contains(lower(ship_type), 'auto') OR ship_type IS NULL OR length IS NULL OR length < 5 OR length > 180""")
def suspect_vessels(spark: SparkSession, sf: str) -> DataFrame:
    """SC-18."""
    k = F.col("c_custkey")
    v = R.table(spark, sf, "customer").select(k.alias("mmsi"), F.when(k % 9 != 0, F.col("c_mktsegment")).alias("ship_type"), F.when(k % 8 != 0, (k % 200).cast("double")).alias("length"))
    return P.suspect_vessels(v, ("auto",)).select("mmsi", "suspect_reason")


@query("""SELECT o_orderkey, sha256(o_orderkey || '|' || o_orderstatus) AS key, (o_orderkey % 20000 // 8760) || 'y ' || (o_orderkey % 20000 % 8760 // 24) || 'd ' || (o_orderkey % 20000 % 24) || 'h' AS lag,
round(round_even(o_totalprice / 250, 0) * 250, 8) AS snapped, round((epoch(o_orderdate) + 1800) * 1.0, 1) AS mid, floor((o_orderkey % 360 + 180) / 6)::INT + 1 AS zone FROM orders""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """FX-02 (zone), FX-09, FX-11, FX-16, FX-17."""
    o = R.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    mid = F.unix_seconds(values.midpoint(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 1 hour"))).cast("double")
    return o.select("o_orderkey", values.cache_key(k.cast("string"), F.col("o_orderstatus")).alias("key"), values.lag_text(k % 20000).alias("lag"), geo.snap(F.col("o_totalprice"), 250.0).alias("snapped"), mid.alias("mid"), geo.utm_zone(k % 360).alias("zone"))


@query("""SELECT p_partkey, TRY_CAST(replace(replace(p_retailprice::VARCHAR, '.', ','), ',', '.') AS DOUBLE) AS price, p_type IN ('ECONOMY') AS yes, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN '2020-0' || (p_size % 9 + 1) WHEN p_size % 3 = 1 THEN '2021' ELSE 'none' END || CASE WHEN p_size % 3 = 0 THEN '-01' WHEN p_size % 3 = 1 THEN '-01-01' ELSE '' END AS DATE)::VARCHAR AS day,
54.01::DOUBLE + p_partkey % 5 AS lat, 2024 AS year, (p_partkey % 9 + 1)::INT AS month FROM part""")
def text_coercions(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-01, FLT-12, FX-10, FX-13."""
    p = R.table(spark, sf, "part")
    text = F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ",")
    day = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("2020-0"), (F.col("p_size") % 9 + 1).cast("string"))).when(F.col("p_size") % 3 == 1, "2021").otherwise("none")
    name = F.format_string("site_%.2f_6.53_2024_%02d.csv", 54.01 + F.col("p_partkey") % 5, F.col("p_partkey") % 9 + 1)
    lat, _, year, month = values.file_fields(name)
    return p.select("p_partkey", values.number(text).alias("price"), values.flag(F.when(F.col("p_type") == "ECONOMY", " Yes ").otherwise("no")).alias("yes"), values.loose_date(day).cast("string").alias("day"), lat.alias("lat"), year.alias("year"), month.alias("month"))


@query(f"""WITH {R.MANIFEST}, m AS (SELECT DISTINCT wind_farm, month FROM manifest WHERE status = 'success'), ex AS (SELECT f.wind_farm, c.month FROM (SELECT DISTINCT wind_farm FROM manifest) f CROSS JOIN (SELECT DISTINCT month FROM manifest) c)
SELECT wind_farm, month::VARCHAR AS month FROM ex ANTI JOIN m USING (wind_farm, month)""")
def unresolved_slices(spark: SparkSession, sf: str) -> DataFrame:
    """AG-46 (unresolved), JN-17."""
    m = R.manifest(spark, sf)
    expected = m.select("wind_farm").distinct().crossJoin(F.broadcast(m.select("month").distinct()))
    return A.unresolved(expected, m, ["wind_farm", "month"], ["success"]).select("wind_farm", F.col("month").cast("string").alias("month"))


@query(f"WITH {R.PINGS}, {R.TURBINES} SELECT wind_farm, date_trunc('month', commissioning)::DATE::VARCHAR AS month, min(found_id) AS first_id, max(found_id) AS last_id, count(*) AS n FROM turbines GROUP BY ALL")
def extents(spark: SparkSession, sf: str) -> DataFrame:
    """AG-07, AG-08."""
    t = R.turbines(spark, sf)
    return t.groupBy("wind_farm", F.trunc("commissioning", "MM").cast("string").alias("month")).agg(F.min("found_id").alias("first_id"), F.max("found_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {R.DWELLS} SELECT dwell_tier, round(quantile_cont(hs, 0.9), 5) AS p90_all, round(quantile_cont(hs, 0.9) FILTER (dist_m > 300), 5) AS p90_away FROM dwells GROUP BY dwell_tier""")
def control_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """AG-22."""
    d = R.dwells(spark, sf).groupBy("dwell_tier").agg(F.percentile("hs", 0.9).alias("p90_all"), F.percentile(F.when(F.col("dist_m") > 300, F.col("hs")), 0.9).alias("p90_away"))
    return rounded(d, p90_all=5, p90_away=5)


@query("""WITH a AS (SELECT o_orderkey AS dwell_id, 1 AS pri FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, 2 FROM lineitem) SELECT dwell_id, min(pri) AS origin FROM a GROUP BY dwell_id""")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """SO-01, SO-02, TK-05."""
    o = R.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("dwell_id"), F.lit(1).alias("origin"))
    more = R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("dwell_id"), F.lit(2).alias("origin"), F.col("l_shipdate").alias("more"))
    u = o.unionByName(more, allowMissingColumns=True)
    return u.groupBy("dwell_id").agg(F.min("origin").alias("origin"))
