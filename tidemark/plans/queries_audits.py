"""Queries on audits of an index, top rows, export profiles and features by task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import tables as T
from tidemark.operators import audit as A
from tidemark.operators import evidence as E
from tidemark.operators import farms as M
from tidemark.operators import models as U
from tidemark.operators import reports as Q
from tidemark.operators import sketches as K
from tidemark.plans import roles as R
from tidemark.plans.lineage import cut, scratch
from tidemark.plans.queries_evidence import _PAIRS, event_confidence
from tidemark.plans.queries_events import WITH_DWELL, _dwell
from tidemark.plans.register import ORACLE, query, rounded
from tidemark.sources import files

_INDEX = """com AS (SELECT wind_farm, min(commissioning) AS since FROM turbines GROUP BY wind_farm),
ms AS (SELECT wind_farm, month, max(status) AS manifest_status FROM manifest GROUP BY ALL),
g AS (SELECT wind_farm, date_trunc('month', start_utc)::DATE AS m, count(*) AS n, sum(dwell_id)::BIGINT AS s, count(*) FILTER (dwell_tier = 'D') AS tier_d, count(duplicate_group_id) AS duplicates, 1 - count(hs) / count(*) AS weather_missing FROM dwells GROUP BY ALL),
ix AS (SELECT g.wind_farm, year(m)::BIGINT AS year, month(m)::BIGINT AS month, s % 2 = 0 AS target, m >= since AS operational, manifest_status, CASE WHEN s % 7 = 0 THEN 'missing' ELSE 'exists' END AS raw_status, s % 5 / 2.0::DOUBLE AS raw_mb,
  CASE s % 11 WHEN 0 THEN 'interrupted' WHEN 1 THEN 'empty' ELSE 'exists' END AS filtered_status, s % 4 AS filtered_rows, CASE WHEN s % 5 = 0 THEN 'missing' ELSE 'exists' END AS visits_status, s % 6 AS visits,
  CASE WHEN s % 3 = 0 THEN 'missing' ELSE 'exists' END AS dwells_status, n AS dwells, tier_d, duplicates, CASE WHEN s % 4 = 0 THEN 'missing' ELSE 'joined' END AS weather_status, n AS weather_rows, weather_missing
  FROM g JOIN com USING (wind_farm) LEFT JOIN ms ON ms.wind_farm = g.wind_farm AND ms.month = g.m)"""
_SCOPE = "CASE WHEN target THEN 'Warning' ELSE 'Info' END"
_FAILED = "CASE WHEN manifest_status = 'success' THEN 'Critical' WHEN target AND operational THEN 'Warning' ELSE 'Info' END"
_RULES = [
    (_SCOPE, "missing_raw_source", "raw_status = 'missing' AND operational", "raw_status"),
    (_FAILED, "interrupted_filtering", "raw_status = 'exists' AND raw_mb > 0 AND filtered_status IN ('interrupted', 'empty')", "filtered_status"),
    (f"CASE WHEN manifest_status = 'success' THEN 'Critical' ELSE {_SCOPE} END", "missing_visits",
     "raw_status = 'exists' AND raw_mb > 0.1 AND visits_status = 'missing' AND coalesce(manifest_status, '') NOT IN ('success_no_ais_in_bbox', 'skipped_missing_source') AND (coalesce(manifest_status = 'success', false) OR operational)", "coalesce(manifest_status, 'not run')"),
    (_FAILED, "missing_dwells", "visits_status = 'exists' AND visits > 0 AND dwells_status = 'missing'", "visits::VARCHAR"),
    ("'Warning'", "missing_weather", "dwells_status = 'exists' AND dwells > 0 AND weather_status = 'missing'", "dwells::VARCHAR"),
    ("'Warning'", "many_duplicates", "dwells_status = 'exists' AND duplicates / dwells > 0.3", "printf('%.1f%%', duplicates / dwells * 100)"),
    ("'Info'", "many_tier_d", "dwells_status = 'exists' AND tier_d / dwells > 0.4", "printf('%.1f%%', tier_d / dwells * 100)"),
    ("'Warning'", "many_dwells_a_visit", "visits_status = 'exists' AND visits > 0 AND dwells_status = 'exists' AND dwells / visits > 2", "printf('%.1f', dwells / visits)"),
    (_SCOPE, "empty_output", "raw_status = 'exists' AND raw_mb > 0.1 AND operational AND (filtered_status = 'exists' AND filtered_rows = 0 OR visits_status = 'exists' AND visits = 0 OR dwells_status = 'exists' AND dwells = 0) AND coalesce(manifest_status, '') NOT IN ('success_no_ais_in_bbox', 'skipped_missing_source')", "concat_ws('/', filtered_rows, visits, dwells)"),
    ("'Warning'", "weather_gaps", "weather_status = 'joined' AND weather_rows > 0 AND weather_missing > 0.25", "printf('%.1f%%', weather_missing * 100)"),
]


@query(f"WITH {R.DWELLS}, {R.MANIFEST}, {_INDEX} " + " UNION ALL ".join(f"SELECT wind_farm, year, month, {s} AS severity, '{t}' AS type, {e} AS evidence FROM ix WHERE {w}" for s, t, w, e in _RULES))
def observatory_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """SC-20: all ten rules, with thresholds, worst first."""
    d = R.dwells(spark, sf)
    g = d.groupBy("wind_farm", F.trunc("start_utc", "MM").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("dwell_id").alias("s"), F.count_if(F.col("dwell_tier") == "D").alias("tier_d"), F.count("duplicate_group_id").alias("duplicates"), (1 - F.count("hs") / F.count(F.lit(1))).alias("weather_missing"))
    since = R.turbines(spark, sf).groupBy("wind_farm").agg(F.min("commissioning").alias("since"))
    status = R.manifest(spark, sf).groupBy("wind_farm", F.col("month").alias("m")).agg(F.max("status").alias("manifest_status"))
    s = F.col("s")
    missing = lambda k: F.when(s % k == 0, "missing")
    ix = g.join(since, "wind_farm").join(status, ["wind_farm", "m"], "left").select(
        "wind_farm", F.year("m").cast("long").alias("year"), F.month("m").cast("long").alias("month"), (s % 2 == 0).alias("target"), (F.col("m") >= F.col("since")).alias("operational"), "manifest_status",
        missing(7).otherwise("exists").alias("raw_status"), (s % 5 / 2.0).alias("raw_mb"), F.when(s % 11 == 0, "interrupted").when(s % 11 == 1, "empty").otherwise("exists").alias("filtered_status"), (s % 4).alias("filtered_rows"),
        missing(5).otherwise("exists").alias("visits_status"), (s % 6).alias("visits"), missing(3).otherwise("exists").alias("dwells_status"), F.col("n").alias("dwells"), "tier_d", "duplicates",
        missing(4).otherwise("joined").alias("weather_status"), F.col("n").alias("weather_rows"), "weather_missing")
    return A.observatory(ix).drop("action")


@query(f"""{WITH_DWELL}, p AS (SELECT mmsi, min(name) AS name, min(ship_type) AS ship_type, max(length) AS length FROM pings GROUP BY mmsi)
SELECT mmsi, round(sum(duration_min), 4) AS minutes, count(*) AS events, any_value(p.name) AS name, any_value(p.ship_type) AS ship_type, any_value(p.length) AS length FROM dwell JOIN p USING (mmsi) GROUP BY mmsi ORDER BY sum(duration_min) DESC, mmsi LIMIT 10""")
def top_vessels(spark: SparkSession, sf: str) -> DataFrame:
    """TK-01: vessels by dwell time, with name, type and length."""
    p = R.pings(spark, sf).groupBy("mmsi").agg(F.min("name").alias("name"), F.min("ship_type").alias("ship_type"), F.max("length").alias("length"))
    return rounded(Q.top_vessels(_dwell(spark, sf).join(p, "mmsi")), minutes=4)


def disagreement_examples(spark: SparkSession, sf: str) -> DataFrame:
    """TK-03: the 25 events whose sources differ most."""
    return Q.disagreement_examples(event_confidence(spark, sf), "dwell_id").select("dwell_id", "n_sources", "hs_range", "tp_range", "confidence")


@query("""WITH x AS (SELECT event_type, value, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -1.5 ELSE value / 10 END AS hs, CASE WHEN event_id % 17 = 0 THEN 0.0 ELSE value END AS tp, (event_id * 7) % 365 AS dir FROM events),
u AS (SELECT event_type, 'wave height' AS "column", 'hs' AS name, hs AS v, hs < 0 AS bad FROM x UNION ALL SELECT event_type, 'period', 'tp', tp, tp <= 0 FROM x UNION ALL SELECT event_type, 'from', 'wave_direction', dir, dir >= 360 FROM x)
SELECT event_type, "column", name, count(v) AS "values", count(*) - count(v) AS null_count, round((count(*) - count(v)) / count(*), 6) AS null_rate, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, count(*) FILTER (bad) AS out_of_range,
       CASE WHEN count(*) FILTER (bad) > 0 THEN any_value(name) || ' out of range' END AS warning FROM u GROUP BY ALL""")
def export_profile(spark: SparkSession, sf: str) -> DataFrame:
    """AG-65: ranges, missing shares and out-of-range warnings of an export; the height is text with a decimal comma."""
    i, v = F.col("event_id"), F.col("value")
    hs = F.when(i % 9 == 0, "NaN").when(i % 13 == 0, "-1,5").otherwise(F.translate((v / 10).cast("string"), ".", ","))
    e = R.table(spark, sf, "events").select("event_type", hs.alias("wave height"), F.when(i % 17 == 0, 0.0).otherwise(v).alias("period"), (i * 7 % 365).alias("from"))
    return rounded(A.export_profile(e, {"wave height": "hs", "period": "tp", "from": "wave_direction"}, ["event_type"]), null_rate=6, min=6, max=6, mean=6)


@query(f"""WITH {R.DWELLS}, e AS (SELECT dwell_id, hs AS hs_mean, tp AS tp_mean, wind_speed AS wind_speed_max, dwell_tier FROM dwells),
m AS (SELECT quantile_cont(hs_mean, 0.5) AS a, quantile_cont(tp_mean, 0.5) AS b, quantile_cont(wind_speed_max, 0.5) AS c FROM e)
SELECT dwell_id AS event_id, round(coalesce(hs_mean, a), 5) AS hs_mean, round(coalesce(tp_mean, b), 5) AS tp_mean, round(coalesce(wind_speed_max, c), 5) AS wind_speed_max, (dwell_tier = 'A')::INT AS target FROM e, m""")
def task_features(spark: SparkSession, sf: str) -> DataFrame:
    """UD-06: metocean features of the boundary task, without null shares and labels, gaps filled by medians."""
    d = R.dwells(spark, sf).select(F.col("dwell_id").alias("event_id"), F.col("hs").alias("hs_mean"), F.col("tp").alias("tp_mean"), F.col("wind_speed").alias("wind_speed_max"), F.col("hs").isNull().cast("double").alias("hs_null_share"), F.col("dist_m").alias("found_dist"), F.when(F.col("dwell_tier") == "A", "maintenance_success").otherwise("idle").alias("event_label_model"))
    return rounded(U.task_features(d, "B", ["event_id"]), hs_mean=5, tp_mean=5, wind_speed_max=5)


@query("""WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, round(min(value), 6) AS p0, round(max(value), 6) AS p100, true AS p50_holds, true AS p95_holds FROM v GROUP BY event_type""")
def merged_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """AG-09, AG-14: sketches by type and day, kept as a table and merged by type; whether the ranks of their quantiles, counted exactly, are within three times the stated error."""
    e = R.table(spark, sf, "events")
    table = cut(K.sketches(e, ["event_type"], "value", {"day": F.to_date("ts")}))
    got = K.sketch_quantiles(K.merged(table, ["event_type"]), {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).drop("sketch")
    near = 3 * K.rank_error(400)
    # a quantile's rank lies between the shares of smaller and of not larger values
    met = e.select("event_type", "value").join(F.broadcast(got.select("event_type", "p50", "p95")), "event_type").groupBy("event_type").agg(
        *(F.avg(t.cast("int")).alias(f"{p}_{n}") for p in ("p50", "p95") for n, t in (("below", F.col("value") < F.col(p)), ("upto", F.col("value") <= F.col(p)))))
    holds = lambda p, q: ((F.col(f"{p}_below") <= q + near) & (F.col(f"{p}_upto") >= q - near)).alias(f"{p}_holds")
    return rounded(got.join(met, "event_type").select("event_type", "n", "p0", "p100", holds("p50", 0.5), holds("p95", 0.95)), p0=6, p100=6)


@query(f"WITH {R.CANDIDATES}, {_PAIRS} SELECT dwell_id, source_a, source_b, round(hs_diff, 5) + 0.0 AS hs_diff, round(tp_diff, 5) + 0.0 AS tp_diff, round(direction_diff, 5) AS direction_diff FROM pairs")
def source_pairs_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    """UD-03, SC-03: the pairs of sources by a table function, called from SQL on a temporary view."""
    T.register_tables(spark)
    c = R.candidates(spark, sf)
    c.withColumn("rank", E.source_rank(F.col("source"))).withColumn("part", F.pmod(F.xxhash64("dwell_id"), F.lit(4096))).createOrReplaceTempView("tidemark_candidates")
    got = spark.sql("SELECT * FROM source_pairs(TABLE(SELECT dwell_id, source, rank, hs, tp, direction, part FROM tidemark_candidates) PARTITION BY part ORDER BY dwell_id)")
    out = rounded(got, hs_diff=5, tp_diff=5, direction_diff=5)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("hs_diff", "tp_diff")})


@query(f"WITH {R.DWELLS} SELECT dwell_tier AS lane, floor(hs / 0.5) * 0.5 AS hs_bin, floor(tp / 1.0) * 1.0 AS tp_bin, count(*) AS n FROM dwells WHERE hs IS NOT NULL AND tp IS NOT NULL GROUP BY ALL")
def occupied_bins_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    """UD-01: the occupied bins of a lane by a table function with widths, called from SQL."""
    T.register_tables(spark)
    R.dwells(spark, sf).select(F.col("dwell_tier").alias("lane"), "hs", "tp").createOrReplaceTempView("tidemark_lanes")
    # lanes are few: a lane's rows are dealt by period first, and its bins in the parts don't overlap
    return spark.sql("SELECT lane, hs_bin, tp_bin, sum(n) AS n FROM occupied_bins(TABLE(SELECT lane, hs, tp, floor(tp) AS part FROM tidemark_lanes) PARTITION BY (lane, part), hs_width => 0.5D, tp_width => 1.0D) GROUP BY lane, hs_bin, tp_bin")


@query("""SELECT event_type, month(ts)::INT AS month, count(*) AS rows, min(ts)::DATE::VARCHAR AS first_day, max(ts)::DATE::VARCHAR AS last_day, count(CASE WHEN event_id % 5 <> 0 THEN value END) AS hs_values, 0::BIGINT AS tp_values FROM events GROUP BY ALL""")
def index_from_footers(spark: SparkSession, sf: str) -> DataFrame:
    """SC-23, SRC-10: the partitions of an archive from the footers of its files."""
    root = scratch(spark)
    e = R.table(spark, sf, "events").select("event_type", F.month("ts").alias("month"), F.to_date("ts").alias("day"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("hs"))
    e.repartition("event_type", "month").write.partitionBy("event_type", "month").parquet(root)
    got = files.archive_index(spark, root, ["event_type", "month"], ["day"], ["hs", "tp"])
    return got.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


_SUBSETS = {"all_events": "true", "waves": "hs IS NOT NULL", "current_ready": "current_speed IS NOT NULL", "current_missing": "current_speed IS NULL", "tier_a_current": "current_speed IS NOT NULL AND dwell_tier = 'A'"}
_LONG = " UNION ALL ".join(f"""SELECT '{s}' AS subset, '{c}' AS "column", coalesce({c}::VARCHAR, 'missing') AS value FROM d WHERE {w}""" for s, w in _SUBSETS.items() for c in ("wind_farm", "year", "duplicate_group_id"))


@query(f"""WITH {R.DWELLS}, d AS (SELECT *, year(start_utc) AS year FROM dwells), u AS ({_LONG}), n AS (SELECT subset, "column", value, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY subset, "column" ORDER BY n DESC, value) AS r FROM n)
SELECT subset, "column", sum(n)::BIGINT AS events, round(sum(n) / (SELECT count(*) FROM d), 6) AS share_of_all, count(*) AS "unique", max(value) FILTER (r = 1) AS top_value, max(n) FILTER (r = 1) AS top_count, round(max(n) FILTER (r = 1) / sum(n), 6) AS top_share,
       (sum(n) FILTER (r <= 5))::BIGINT AS few_count, round(sum(n) FILTER (r <= 5) / sum(n), 6) AS few_share FROM r GROUP BY subset, "column" """)
def concentration_by_readiness(spark: SparkSession, sf: str) -> DataFrame:
    """AG-38: concentration in each readiness subset, and of events with and without a current (its bias)."""
    d = R.dwells(spark, sf).withColumn("year", F.year("start_utc"))
    out = A.concentration_by(d, {n: F.expr(w) for n, w in _SUBSETS.items()}, ["wind_farm", "year", "duplicate_group_id"])
    return rounded(out, share_of_all=6, top_share=6, few_share=6)


@query(f"""WITH {R.DWELLS}, box AS (SELECT wind_farm, any_value(CASE country WHEN 'EUROPE' THEN 'Germany' WHEN 'ASIA' THEN 'United Kingdom' WHEN 'AFRICA' THEN 'France' ELSE country END) AS country, min(longitude) + found AS min_lon, max(longitude) + found AS max_lon, min(latitude) AS min_lat, max(latitude) AS max_lat, count(*) AS turbines
  FROM turbines, (SELECT 2.5::DOUBLE AS found) GROUP BY wind_farm, found),
p AS (SELECT wind_farm, year(start_utc)::INT AS year, count(*) AS sample_points, coalesce(avg((depth <= 10)::INT), 0) AS shallow_share, quantile_cont(depth, 0.1) AS p10_depth, quantile_cont(depth, 0.5) AS median_depth, count(*) AS events, count(*) FILTER (dwell_tier = 'A') AS tier_a FROM dwells GROUP BY ALL),
f AS (SELECT *, CASE WHEN max_lon > 10 THEN 'baltic_or_transition' WHEN country = 'United Kingdom' THEN 'uk_irish_shelf' WHEN country = 'Germany' THEN CASE WHEN (min_lon + max_lon) / 2 < 9 THEN 'southern_north_sea' ELSE 'north_sea_transition' END WHEN country = 'France' THEN 'channel_or_biscay' ELSE 'north_west_shelf' END AS region,
  CASE WHEN max_lon > 10 THEN 'masked_or_boundary' ELSE 'inside' END AS domain, CASE WHEN shallow_share >= 0.8 THEN 'severe' WHEN shallow_share > 0.5 THEN 'dominated' WHEN shallow_share >= 0.2 THEN 'moderate' WHEN shallow_share > 0 THEN 'some' ELSE 'none' END AS shallow_warning,
  sample_points * date_diff('day', make_date(year, 1, 1), make_date(year + 1, 1, 1)) * 24 AS rows FROM p JOIN box USING (wind_farm)),
g AS (SELECT *, round(rows * 64.0 / 1e6, 3) AS raw_mb, round(rows * (4498964 / 500688) / 1e6, 3) AS processed_mb, CASE WHEN rows < 1000000 THEN 'small' WHEN rows < 5000000 THEN 'medium' ELSE 'large' END AS runtime FROM f)
SELECT wind_farm, year, sample_points, round(shallow_share, 6) AS shallow_share, round(p10_depth, 4) AS p10_depth, round(median_depth, 4) AS median_depth, events, tier_a, region, domain, shallow_warning, rows, raw_mb, processed_mb, runtime,
  CASE WHEN domain = 'inside' AND events >= 10 AND processed_mb <= 250 AND tier_a >= 3 AND shallow_share <= 0.5 THEN 'yes' WHEN domain = 'inside' AND events >= 10 AND processed_mb <= 250 AND (shallow_share > 0.5 OR events >= 50) THEN 'stress_test_only' ELSE 'no' END AS recommendation,
  concat_ws('; ', CASE WHEN domain <> 'inside' THEN 'domain' END, CASE WHEN events < 10 THEN 'few_events' END, CASE WHEN tier_a < 3 AND events >= 50 THEN 'few_tier_a_but_many_events' END, CASE WHEN tier_a < 3 AND events < 50 THEN 'few_tier_a' END, CASE WHEN shallow_share > 0.5 THEN 'shallow' END, CASE WHEN processed_mb > 250 THEN 'too_large' END) AS reason FROM g""")
def farm_year_scale(spark: SparkSession, sf: str) -> DataFrame:
    """AG-43, AG-66, SC-13: farm years with depths, region, size, runtime class and a recommendation; farms lie 2.5 degrees further east than the turbines, so that some are masked."""
    t = R.turbines(spark, sf)
    country = F.col("country")
    said = F.when(country == "EUROPE", "Germany").when(country == "ASIA", "United Kingdom").when(country == "AFRICA", "France").otherwise(country)
    box = t.groupBy("wind_farm").agg(F.first(said).alias("country"), (F.min("longitude") + 2.5).alias("min_lon"), (F.max("longitude") + 2.5).alias("max_lon"), F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"))
    d = cut(R.dwells(spark, sf).select("wind_farm", F.year("start_utc").alias("year"), "depth", "dwell_tier"))
    counts = d.groupBy("wind_farm", "year").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("dwell_tier") == "A").alias("tier_a"))
    out = M.scale_plan(M.depth_shares(d, ["wind_farm", "year"]).join(counts, ["wind_farm", "year"]).join(box, "wind_farm"))
    return rounded(out.drop("country", "min_lon", "max_lon", "min_lat", "max_lat"), shallow_share=6, p10_depth=4, median_depth=4)


_EXAMPLES = ORACLE[event_confidence.__name__]
_CUT = "SELECT dwell_id, n_sources, hs_range, tp_range, confidence FROM ({}) ORDER BY hs_range DESC NULLS LAST, tp_range DESC NULLS LAST, dwell_id LIMIT 25"
query(_CUT.format(_EXAMPLES))(disagreement_examples)
