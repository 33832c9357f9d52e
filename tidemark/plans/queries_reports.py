"""Queries on summaries, comparisons, gates and rates, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import angles
from tidemark.functions.values import flag, slug
from tidemark.operators import audit as A
from tidemark.operators import envelope as V
from tidemark.operators import evidence as E
from tidemark.operators import intensity as I
from tidemark.operators import pings as P
from tidemark.operators import reports as Q
from tidemark.operators import stats as S
from tidemark.operators import timejoin as J
from tidemark.plans import queries_events as QE
from tidemark.plans import roles as R
from tidemark.plans.register import query, rounded

_RATES = f"""{R.DWELLS}, rates AS (
  SELECT t.found_id, t.wind_farm, t.country, t.rated_power, t.rotor_diameter, count(d.dwell_id) AS events, (t.found_id % 20 + 1)::DOUBLE AS years, CASE WHEN t.found_id % 4 = 0 THEN 'outer' ELSE 'inner' END AS ring
  FROM turbines t LEFT JOIN dwells d ON d.found_id = t.found_id GROUP BY ALL)"""


def _rates(spark: SparkSession, sf: str) -> DataFrame:
    n = R.dwells(spark, sf).groupBy("found_id").agg(F.count(F.lit(1)).alias("events"))
    k = F.col("found_id")
    t = R.turbines(spark, sf).select("found_id", "wind_farm", "country", "rated_power", "rotor_diameter", (k % 20 + 1).cast("double").alias("years"), F.when(k % 4 == 0, "outer").otherwise("inner").alias("ring"))
    return t.join(n, "found_id", "left").na.fill(0, ["events"])


@query("""SELECT l_returnflag AS source, count(*) AS n, round(quantile_cont(l_quantity, 0.5), 5) AS km_p50, round(quantile_cont(l_quantity, 0.95), 5) AS km_p95, round(quantile_cont(l_tax * 100, 0.5), 5) AS gap_min_p50, round(quantile_cont(l_tax * 100, 0.95), 5) AS gap_min_p95,
count(*) FILTER (l_linenumber % 2 = 0) AS unbracketed, count(*) FILTER (l_discount > 0.05) AS shallow FROM lineitem GROUP BY l_returnflag""")
def source_quality(spark: SparkSession, sf: str) -> DataFrame:
    """AG-14."""
    c = R.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_quantity").alias("km"), (F.col("l_tax") * 100).alias("gap_min"), (F.col("l_linenumber") % 2 != 0).alias("bracketed"), (F.col("l_discount") > 0.05).alias("shallow"))
    return rounded(Q.source_quality(c, "source", ("km", "gap_min")), km_p50=5, km_p95=5, gap_min_p50=5, gap_min_p95=5)


@query(f"""WITH {R.DWELLS}, s AS (SELECT 'all' AS subset, hs FROM dwells UNION ALL SELECT 'tier_a', hs FROM dwells WHERE dwell_tier = 'A'), t AS (SELECT unnest([1.0, 1.5, 2.5])::DOUBLE AS threshold)
SELECT subset, threshold, count(hs) AS rows, count(*) FILTER (hs > threshold) AS above, round(count(*) FILTER (hs > threshold) / count(hs)::DOUBLE, 6) AS above_share FROM s, t GROUP BY ALL""")
def threshold_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AG-15, FLT-16."""
    d = R.dwells(spark, sf)
    return rounded(Q.threshold_counts(d, "hs", [1.0, 1.5, 2.5], {"all": F.lit(True), "tier_a": F.col("dwell_tier") == "A"}), above_share=6)


_BOUNDS = f"""{R.DWELLS}, b AS (SELECT floor(tp) AS bin, count(hs) AS n, quantile_cont(hs, 0.95) AS p95 FROM dwells WHERE tp IS NOT NULL GROUP BY 1), a AS (SELECT floor(tp) AS bin, count(hs) AS n, quantile_cont(hs, 0.95) AS p95 FROM dwells WHERE tp IS NOT NULL AND dwell_tier = 'A' GROUP BY 1),
d AS (SELECT bin, b.n, b.p95, a.n AS n_variant, a.p95 AS p95_variant, a.p95 - b.p95 AS delta, coalesce(abs(a.p95 - b.p95) >= 0.1, false) AS material FROM b FULL JOIN a USING (bin))"""


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    d = R.dwells(spark, sf).filter("tp is not null")
    at = lambda x: V.boundary(x, x.select(F.floor("tp").cast("double").alias("bin")).distinct(), F.floor("tp").cast("double"), "hs", 0)
    return Q.boundary_delta(at(d), at(d.filter("dwell_tier = 'A'")))


@query(f"WITH {_BOUNDS} SELECT bin, n, n_variant, round(p95, 5) AS p95, round(p95_variant, 5) AS p95_variant, round(delta, 5) AS delta, material FROM d")
def boundary_delta(spark: SparkSession, sf: str) -> DataFrame:
    """AG-17 (by bin)."""
    return rounded(_deltas(spark, sf), p95=5, p95_variant=5, delta=5)


@query(f"WITH {_BOUNDS} SELECT count(delta) AS bins, round(avg(abs(delta)), 5) AS mean_abs, round(max(abs(delta)), 5) AS max_abs, count(*) FILTER (material) AS material_bins, bool_or(material) AS material FROM d")
def boundary_delta_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AG-17 (summary)."""
    return rounded(Q.delta_summary(_deltas(spark, sf)), mean_abs=5, max_abs=5)


@query(f"""WITH {_RATES}, s AS (SELECT unnest([0.0, 5.0, 10.0])::DOUBLE AS least_years)
SELECT least_years, ring AS "group", count(*) AS turbines, sum(events)::BIGINT AS events, sum(years) AS years, count(*) FILTER (events = 0) AS without_events, round(sum(events) / sum(years), 6) AS rate,
CASE WHEN count(*) >= 30 AND sum(years) >= 100 THEN 'strong' WHEN count(*) >= 10 AND sum(years) >= 30 THEN 'moderate' ELSE 'thin' END AS sample_class FROM rates, s WHERE years >= least_years GROUP BY ALL""")
def exposure_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """AG-34."""
    return rounded(Q.exposure_comparison(_rates(spark, sf), [0, 5, 10]), rate=6)


_STRATA = f"""{_RATES}, st AS (SELECT rated_power, sum(events) FILTER (country = 'EUROPE') AS a_events, sum(years) FILTER (country = 'EUROPE') AS a_years, count(*) FILTER (country = 'EUROPE') AS a_turbines,
  sum(events) FILTER (country = 'ASIA') AS b_events, sum(years) FILTER (country = 'ASIA') AS b_years, count(*) FILTER (country = 'ASIA') AS b_turbines FROM rates GROUP BY rated_power HAVING a_turbines > 0 AND b_turbines > 0)"""


@query(f"""WITH {_STRATA} SELECT rated_power, a_events::BIGINT AS a_events, a_years, a_turbines, b_events::BIGINT AS b_events, b_years, b_turbines, round(a_events / a_years, 6) AS a_rate, round(b_events / b_years, 6) AS b_rate,
round(CASE WHEN b_events > 0 THEN (a_events / a_years) / (b_events / b_years) END, 6) AS ratio FROM st""")
def basin_strata(spark: SparkSession, sf: str) -> DataFrame:
    """AG-36 (matched strata)."""
    return rounded(Q.matched_strata(_rates(spark, sf), ["rated_power"], "country", "EUROPE", "ASIA"), a_rate=6, b_rate=6, ratio=6)


@query(f"""WITH {_STRATA} SELECT count(*) AS strata, sum(a_events)::BIGINT AS a_events, sum(b_events)::BIGINT AS b_events, round(sum(a_events * b_years / (a_years + b_years)) / nullif(sum(b_events * a_years / (a_years + b_years)), 0), 6) AS pooled_ratio FROM st""")
def basin_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """AG-36 (pooled ratio)."""
    return rounded(Q.pooled_ratio(Q.matched_strata(_rates(spark, sf), ["rated_power"], "country", "EUROPE", "ASIA")), pooled_ratio=6)


@query(f"""WITH {_RATES}, f AS (SELECT country, wind_farm, sum(events) AS e FROM rates GROUP BY ALL), k AS (SELECT country, wind_farm FROM f QUALIFY NOT e > 0.25 * sum(e) OVER (PARTITION BY country))
SELECT country, count(*) AS turbines, sum(events)::BIGINT AS events, round(sum(events) / sum(years), 6) AS rate FROM rates SEMI JOIN k USING (country, wind_farm) GROUP BY country""")
def basin_trimmed(spark: SparkSession, sf: str) -> DataFrame:
    """AG-36 (without dominant farms)."""
    t = Q.without_dominant_farms(_rates(spark, sf), "country", 0.25)
    return rounded(t.groupBy("country").agg(F.count(F.lit(1)).alias("turbines"), F.sum("events").alias("events"), (F.sum("events") / F.sum("years")).alias("rate")), rate=6)


@query(f"""WITH {R.DWELLS} SELECT wind_farm, year(start_utc) AS year, count(*) AS points, count(depth) AS with_depth, min(depth) AS min, round(quantile_cont(depth, 0.1), 4) AS p10, round(quantile_cont(depth, 0.5), 4) AS median, max(depth) AS max,
count(*) FILTER (depth <= 1) AS le_1m, count(*) FILTER (depth <= 5) AS le_5m, count(*) FILTER (depth <= 10) AS le_10m, round(avg((depth IS NOT NULL AND hs IS NOT NULL)::INT), 6) AS provenance_share FROM dwells GROUP BY ALL""")
def depth_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AG-43, AG-44."""
    d = R.dwells(spark, sf).withColumns({"year": F.year("start_utc").cast("long"), "complete": F.col("depth").isNotNull() & F.col("hs").isNotNull()})
    return rounded(Q.depth_summary(d, ["wind_farm", "year"]), p10=4, median=4, provenance_share=6)


@query(f"""WITH {R.DWELLS} SELECT wind_farm, count(*) FILTER (dwell_tier = 'A') AS "tier_A", count(*) FILTER (dwell_tier = 'B') AS "tier_B", count(*) FILTER (dwell_tier = 'C') AS "tier_C", count(*) FILTER (dwell_tier = 'D') AS "tier_D",
round(quantile_cont(duration_min, 0.5), 4) AS median_min, count(*) FILTER (duplicate_group_id IS NULL) + count(DISTINCT duplicate_group_id) AS deduplicated FROM dwells GROUP BY wind_farm""")
def atlas(spark: SparkSession, sf: str) -> DataFrame:
    """AG-47 (atlas)."""
    return rounded(Q.atlas(R.dwells(spark, sf), list("ABCD")), median_min=4)


@query(f"""WITH {R.DWELLS}, a AS (SELECT wind_farm, quantile_cont(hs, 0.5) AS median FROM dwells WHERE dwell_tier = 'A' GROUP BY 1), b AS (SELECT wind_farm, quantile_cont(hs, 0.5) AS comparator FROM dwells GROUP BY 1)
SELECT wind_farm, round(median, 5) AS median, round(comparator, 5) AS comparator, round(median - comparator, 5) AS delta FROM a LEFT JOIN b USING (wind_farm)""")
def comparator_delta(spark: SparkSession, sf: str) -> DataFrame:
    """AG-47 (deltas)."""
    d = R.dwells(spark, sf)
    return rounded(Q.comparator_delta(d.filter("dwell_tier = 'A'"), d, "wind_farm", "hs"), median=5, comparator=5, delta=5)


_PAIRED = """h AS (SELECT date_trunc('hour', ts) AS hour, event_type AS site, avg(value) AS y, avg((event_id % 50)::DOUBLE) AS deg7 FROM events GROUP BY ALL), x AS (SELECT date_trunc('hour', ts) AS hour, avg((event_id % 97)::DOUBLE) AS x FROM events GROUP BY ALL), pairs AS (SELECT site, hour, x, y, deg7 * 7.2 AS deg FROM h JOIN x USING (hour))"""


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    e = R.table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    y = e.groupBy("hour", F.col("event_type").alias("site")).agg(F.avg("value").alias("y"), (F.avg((F.col("event_id") % 50).cast("double")) * 7.2).alias("deg"))
    return y.join(e.groupBy("hour").agg(F.avg((F.col("event_id") % 97).cast("double")).alias("x")), "hour")


@query(f"""WITH {_PAIRED}, c AS (SELECT site, date_trunc('month', hour)::TIMESTAMP AS month, corr(x, y) AS r, count(*) AS hours FROM pairs GROUP BY ALL HAVING count(*) >= 24)
SELECT site, month, round(r, 5) AS r, hours, row_number() OVER (PARTITION BY month ORDER BY r DESC, site) AS rank FROM c""")
def monthly_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """AG-50 (months)."""
    return rounded(Q.monthly_ranks(_paired(spark, sf)), r=5)


@query(f"""WITH {_PAIRED}, s AS (SELECT *, ['N','NE','E','SE','S','SW','W','NW'][(floor(((deg + 22.5) % 360) / 45))::INT + 1] AS sector FROM pairs), c AS (SELECT site, sector, corr(x, y) AS r, count(*) AS hours FROM s GROUP BY ALL)
SELECT site, sector, round(CASE WHEN hours >= 24 THEN r END, 5) AS r, hours, round(hours / sum(hours) OVER (PARTITION BY site), 6) AS rose_share FROM c""")
def sector_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """AG-50 (sectors and wind rose)."""
    return rounded(Q.sector_correlations(_paired(spark, sf), angles.sector(F.col("deg"))), r=5, rose_share=6)


_BINNED = """b AS (SELECT user_id % 5 AS asset, (floor(value / 14 / 0.5) + 0.5) * 0.5 AS wind, avg((event_id % 100) / 100.0::DOUBLE) AS power, count(*) AS n FROM events WHERE event_id % 3 IN (0, 1) AND value / 14 BETWEEN 0 AND 35 GROUP BY ALL HAVING count(*) >= 5),
k AS (SELECT *, least(1.0, greatest(0.0, (wind - 3) / 9))::DOUBLE AS given, max(power) OVER (PARTITION BY asset) AS top FROM b WHERE wind BETWEEN 4 AND 25),
f AS (SELECT *, min(CASE WHEN power >= 0.98 * top THEN wind END) OVER (PARTITION BY asset) AS rated FROM k)"""


@query(f"""WITH {_BINNED} SELECT asset, rated, count(*) AS bins, round(avg(abs(power - given)), 6) AS mae, round(sqrt(avg((power - given) ** 2)), 6) AS rmse, round(1 - sum((power - given) ** 2) / (var_pop(power) * count(*)), 4) AS r2, round(avg(power) FILTER (wind >= rated), 6) AS plateau
FROM f GROUP BY ALL HAVING count(*) >= 12""")
def curve_fit(spark: SparkSession, sf: str) -> DataFrame:
    """AG-53 (fit), FLT-14 (status and wind limits)."""
    e = R.table(spark, sf, "events").select((F.col("user_id") % 5).alias("asset"), (F.col("value") / 14).alias("wind"), ((F.col("event_id") % 100) / 100.0).alias("power"), (F.col("event_id") % 3).alias("status"))
    binned = S.power_curve(e, "asset", "wind", "power", least_rows=5)
    curve = spark.range(8, 51).select((F.col("id") * 0.5 + 0.25).alias("wind")).withColumn("power", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("wind") - 3) / 9)))
    return rounded(Q.curve_fit(binned, curve, "asset"), mae=6, rmse=6, r2=4, plateau=6)


@query("SELECT event_type, count(*) AS kept FROM events WHERE value / 9 BETWEEN 0 AND 45 GROUP BY event_type")
def sound_wind(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-14 (outliers)."""
    return S.sound_wind(R.table(spark, sf, "events").withColumn("wind", F.col("value") / 9), "wind").groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH a AS (SELECT user_id, count(*) FILTER (value > 200) AS p, count(*) FILTER (value <= 200 AND event_id % 9 <> 0) AS n, count(*) FILTER (value <= 200 AND event_id % 9 = 0) AS u FROM events GROUP BY user_id),
t AS (SELECT sum(p) AS top3 FROM (SELECT p FROM a ORDER BY p DESC LIMIT 3)), s AS (SELECT count(*) FILTER (p > 0) AS events, sum(p) AS p, sum(n) AS n, sum(u) AS u FROM a)
SELECT 'positive_events' AS gate, events::DOUBLE AS value, events >= 5 AS passed FROM s UNION ALL SELECT 'positive_rows', p::DOUBLE, p >= 100 FROM s UNION ALL SELECT 'top3_share', round(top3 / p::DOUBLE, 6), top3 / p::DOUBLE <= 0.6 FROM s, t
UNION ALL SELECT 'positive_share', round(p / (p + n)::DOUBLE, 6), p / (p + n)::DOUBLE >= 0.01 FROM s UNION ALL SELECT 'unknown_share', round(u / (p + n + u)::DOUBLE, 6), u / (p + n + u)::DOUBLE <= 0.5 FROM s""")
def viability_gates(spark: SparkSession, sf: str) -> DataFrame:
    """AG-58 (gates)."""
    v, k = F.col("value"), F.col("event_id")
    e = R.table(spark, sf, "events").withColumns({"label": F.when(v > 200, 1).when(k % 9 != 0, 0), "at": F.struct("ts", "event_id")})
    return rounded(Q.viability(S.label_audit(e, "user_id", "at", "label")), value=6)


@query("""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) / 100 AS speed, avg((event_id % 50)::DOUBLE) * 7.2 AS deg FROM events GROUP BY ALL),
d AS (SELECT *, CASE WHEN lag(hour) OVER w = hour - INTERVAL 1 HOUR THEN abs(speed - lag(speed) OVER w) END AS ds, CASE WHEN lag(hour) OVER w = hour - INTERVAL 1 HOUR THEN abs((deg - lag(deg) OVER w + 540) % 360 - 180) END AS dd FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour))
SELECT event_type, count(ds) AS steps, round(quantile_cont(ds, 0.5), 5) AS speed_p50, round(quantile_cont(ds, 0.95), 5) AS speed_p95, round(quantile_cont(dd, 0.5), 4) AS turn_p50, round(quantile_cont(dd, 0.95), 4) AS turn_p95,
coalesce(quantile_cont(ds, 0.95) > 0.5 OR quantile_cont(dd, 0.95) > 45, false) AS variable FROM d GROUP BY event_type""")
def hourly_change(spark: SparkSession, sf: str) -> DataFrame:
    """AG-60."""
    h = R.table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg((F.avg("value") / 100).alias("speed"), (F.avg((F.col("event_id") % 50).cast("double")) * 7.2).alias("deg"))
    return rounded(Q.hourly_change(h, ["event_type"], "speed", "deg"), speed_p50=5, speed_p95=5, turn_p50=4, turn_p95=4)


_IV = QE._INTERVALS.replace('AS "start"', '+ INTERVAL 37 MINUTE AS "start"').replace('AS "end"', '+ INTERVAL 37 MINUTE AS "end"')
_SM = QE._SAMPLES


@query(f"""WITH {_IV}, {_SM}, m AS (SELECT iv.event_id, "start", "end", sm.ts FROM iv JOIN sm ON sm.mmsi = iv.mmsi),
g AS (SELECT event_id, count(*) FILTER (ts BETWEEN "start" AND "end") AS n, bool_or(ts <= "start") AND bool_or(ts >= "end") AS br, min(abs(epoch(ts) - (epoch("start") + epoch("end")) / 2)) / 60 AS gap FROM m GROUP BY event_id),
e AS (SELECT event_id, coalesce(n, 0) > 0 AS win, coalesce(br, false) AS br, coalesce(br AND gap <= 60, false) AS tight FROM iv LEFT JOIN g USING (event_id))
SELECT count(*) AS events, round(avg(win::INT), 6) AS in_window, round(avg(br::INT), 6) AS bracketed, round(avg(tight::INT), 6) AS tight, round(avg((win OR tight)::INT), 6) AS usable,
CASE WHEN avg((win OR tight)::INT) >= 0.8 THEN 'suitable' WHEN avg((win OR tight)::INT) >= 0.5 THEN 'partly' ELSE 'unsuitable' END AS verdict FROM e""")
def suitability(spark: SparkSession, sf: str) -> DataFrame:
    """AG-61: intervals begin 37 minutes after their event, so that they don't hold its own sample by definition."""
    later = {c: F.col(c) + F.expr("interval 37 minutes") for c in ("start", "end")}
    b = J.bracketed(QE._intervals(spark, sf).withColumns(later), QE._samples(spark, sf), ["mmsi"], "value")
    return rounded(Q.suitability(b, 60.0), in_window=6, bracketed=6, tight=6, usable=6)


@query(f"""WITH {R.DWELLS}, n AS (SELECT avg((hs IS NULL)::INT) AS hs, avg((tp IS NULL)::INT) AS tp, avg((current_speed IS NULL)::INT) AS c, avg((depth IS NULL)::INT) AS d FROM dwells)
SELECT 'waves' AS question, 2 AS columns, round(greatest(hs, tp), 6) AS worst, CASE WHEN greatest(hs, tp) <= 0.2 THEN 'yes' WHEN greatest(hs, tp) < 0.5 THEN 'limited' ELSE 'no' END AS answerable FROM n
UNION ALL SELECT 'currents', 1, round(c, 6), CASE WHEN c <= 0.2 THEN 'yes' WHEN c < 0.5 THEN 'limited' ELSE 'no' END FROM n UNION ALL SELECT 'ice', 2, 1.0, 'no' FROM n""")
def answerability(spark: SparkSession, sf: str) -> DataFrame:
    """AG-62."""
    rates = A.null_rates(R.dwells(spark, sf), ["hs", "tp", "current_speed", "depth"])
    return rounded(Q.answerability(rates, {"waves": (["hs", "tp"], 0.2), "currents": (["current_speed"], 0.2), "ice": (["depth", "ice_class"], 0.2)}), worst=6)


@query(f"""WITH {R.DWELLS}, w AS (
  SELECT dwell_id, source, conf, (dwell_id % 240)::DOUBLE AS gap, km FROM (SELECT *, ['A', 'B', 'C', 'D'][dwell_id // 4 % 4 + 1] AS conf, 's' AS source FROM dwells) WHERE hs IS NOT NULL),
s AS (SELECT (SELECT count(*) FROM w) AS rows, (SELECT count(*) FROM dwells) AS base_rows, (SELECT count(*) FROM dwells ANTI JOIN w USING (dwell_id)) AS lost_keys, 0 AS repeated_keys, count(*) FILTER (conf = 'A') AS "class_A", count(*) FILTER (conf = 'B') AS "class_B", count(*) FILTER (conf = 'C') AS "class_C", count(*) FILTER (conf = 'D') AS "class_D",
  quantile_cont(gap, 0.5) AS gap_p50, quantile_cont(gap, 0.95) AS gap_p95, quantile_cont(km, 0.5) AS km_p50, quantile_cont(km, 0.95) AS km_p95 FROM w)
SELECT metric, round(value, 5) AS value FROM (SELECT rows::DOUBLE AS rows, base_rows::DOUBLE AS base_rows, lost_keys::DOUBLE AS lost_keys, repeated_keys::DOUBLE AS repeated_keys, "class_A"::DOUBLE AS "class_A", "class_B"::DOUBLE AS "class_B", "class_C"::DOUBLE AS "class_C", "class_D"::DOUBLE AS "class_D", gap_p50, gap_p95, km_p50, km_p95 FROM s)
UNPIVOT (value FOR metric IN (rows, base_rows, lost_keys, repeated_keys, "class_A", "class_B", "class_C", "class_D", gap_p50, gap_p95, km_p50, km_p95))""")
def layer_validation(spark: SparkSession, sf: str) -> DataFrame:
    """AG-70; the layer lacks events without waves, so losses show."""
    d = R.dwells(spark, sf)
    k = F.col("dwell_id")
    layer = d.filter("hs is not null").select("dwell_id", F.element_at(F.array(*map(F.lit, "ABCD")), (F.floor(k / 4) % 4 + 1).cast("int")).alias("conf"), (k % 240).cast("double").alias("gap"), "km")
    return rounded(Q.layer_validation(d, layer, "dwell_id", "conf", "gap", "km"), value=5)


@query(f"""WITH {R.CANDIDATES.replace(R.EVENT_LINES, "lineitem")}, v1 AS (SELECT dwell_id, CASE WHEN min(quality) > 0.52 THEN 'A' WHEN max(quality) > 0.55 THEN 'B' ELSE 'D' END AS confidence, min(source) AS source_v1 FROM candidates WHERE source IS NOT NULL GROUP BY dwell_id),
v0 AS (SELECT o_orderkey AS dwell_id, ['nora3', 'nws', 'baltic'][o_orderkey % 3 + 1] AS source_v0 FROM orders)
SELECT source_v0, CASE WHEN confidence IS NULL OR confidence = 'D' THEN 'missing' WHEN source_v0 = source_v1 AND confidence IN ('A', 'B') THEN 'supported' ELSE 'questionable' END AS state, count(*) AS events FROM v0 LEFT JOIN v1 USING (dwell_id) GROUP BY ALL""")
def version_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """SC-07."""
    line = R.table(spark, sf, "lineitem")
    names = F.array(F.lit("nora3"), F.lit("nws"), F.lit("baltic"))
    c = line.groupBy(F.col("l_orderkey").alias("dwell_id"), "l_linenumber").agg(F.max("l_discount").alias("d")).select("dwell_id", F.get(names, F.col("l_linenumber") - 1).alias("source"), (0.5 + F.col("d")).alias("quality")).filter("source is not null")
    v1 = c.groupBy("dwell_id").agg(F.when(F.min("quality") > 0.52, "A").when(F.max("quality") > 0.55, "B").otherwise("D").alias("confidence"), F.min("source").alias("source"))
    v0 = R.table(spark, sf, "orders").select(F.col("o_orderkey").alias("dwell_id"), F.get(names, (F.col("o_orderkey") % 3).cast("int")).alias("source"))
    return Q.version_comparison(v1, v0, "dwell_id")


@query(f"""WITH {R.DWELLS}, c AS (SELECT 'waves_tier_a' AS claim, count(*) FILTER (dwell_tier = 'A') AS rows, count(*) FILTER (dwell_tier = 'A' AND hs IS NOT NULL) AS support, 0.8::DOUBLE AS least FROM dwells
UNION ALL SELECT 'currents', count(*), count(current_speed), 0.5::DOUBLE FROM dwells UNION ALL SELECT 'tier_x', 0, 0, 0.5::DOUBLE)
SELECT claim, rows, support, least, round(support / nullif(rows, 0)::DOUBLE, 6) AS support_share, CASE WHEN support / nullif(rows, 0)::DOUBLE >= least THEN 'allowed' WHEN rows > 0 THEN 'limited' ELSE 'not_allowed' END AS status FROM c""")
def claim_checks(spark: SparkSession, sf: str) -> DataFrame:
    """SC-12."""
    a = F.col("dwell_tier") == "A"
    claims = {"waves_tier_a": (a, F.col("hs").isNotNull(), 0.8), "currents": (F.lit(True), F.col("current_speed").isNotNull(), 0.5), "tier_x": (F.col("dwell_tier") == "X", F.lit(True), 0.5)}
    return rounded(Q.claim_checks(R.dwells(spark, sf), claims), support_share=6)


@query("""WITH s AS (SELECT user_id, to_timestamp(floor(epoch(ts) / 600) * 600)::TIMESTAMP AS ts, min(value) AS hs FROM events GROUP BY ALL),
g AS (SELECT user_id, count(*) AS rows, count(DISTINCT ts) AS times, 0::BIGINT AS nulls, count(*) FILTER (hs > 400) AS out_of_bounds, 0::BIGINT AS off_grid, ((epoch(max(ts)) - epoch(min(ts)))::BIGINT // 600) + 1 AS expected, (epoch(max(ts)) - epoch(min(ts))) / 86400 AS days FROM s GROUP BY user_id)
SELECT user_id, rows, times, nulls, out_of_bounds, off_grid, expected, round(days, 5) AS days, out_of_bounds = 0 AND rows = expected AND days <= 32 AS passed FROM g""")
def backbone_gate(spark: SparkSession, sf: str) -> DataFrame:
    """SC-22."""
    t = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 600) * 600)
    s = R.table(spark, sf, "events").groupBy("user_id", t.alias("ts")).agg(F.min("value").alias("hs"))
    return rounded(Q.backbone_gate(s, ["user_id"], {"hs": (0.0, 400.0)}), days=5)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 200 = 0 THEN 'unknown' WHEN c_custkey % 200 < 30 THEN 'small' WHEN c_custkey % 200 < 80 THEN 'medium' WHEN c_custkey % 200 < 150 THEN 'large' ELSE 'very_large' END AS length_class,
CASE WHEN contains(lower(c_mktsegment), 'auto') OR contains(lower(c_mktsegment), 'machin') THEN 'service' WHEN contains(lower(c_mktsegment), 'furn') THEN 'cargo' ELSE 'other' END AS alias FROM customer""")
def vessel_classes(spark: SparkSession, sf: str) -> DataFrame:
    """SC-17 (length classes and type aliases)."""
    c = R.table(spark, sf, "customer")
    return c.select("c_custkey", Q.length_class((F.col("c_custkey") % 200).cast("double")).alias("length_class"), Q.type_alias(F.col("c_mktsegment"), {"service": ["auto", "machin"], "cargo": ["furn"]}).alias("alias"))


@query(f"""{QE.WITH_DWELL}, k AS (SELECT *, CASE WHEN duration_min < 720 THEN 'Transfer' WHEN duration_min <= 1440 THEN 'Extended' ELSE 'Stationary/Construction' END AS event_class FROM dwell),
s AS (SELECT count(*)::DOUBLE AS events, count(DISTINCT mmsi)::DOUBLE AS vessels, count(DISTINCT wind_farm)::DOUBLE AS farms, count(*) FILTER (event_class = 'Transfer')::DOUBLE AS "class_Transfer", count(*) FILTER (event_class = 'Extended')::DOUBLE AS "class_Extended", count(*) FILTER (event_class = 'Stationary/Construction')::DOUBLE AS "class_Stationary/Construction",
  (SELECT count(*)::DOUBLE FROM (SELECT DISTINCT mmsi FROM pings) ANTI JOIN k USING (mmsi)) AS registry_without_events FROM k)
UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value""")
def event_totals(spark: SparkSession, sf: str) -> DataFrame:
    """AG-46 (totals), AG-30."""
    return Q.event_totals(QE._dwell(spark, sf), R.pings(spark, sf).select("mmsi").distinct())


@query(f"""{QE.WITH_DWELL}, k AS (SELECT *, CASE WHEN duration_min < 720 THEN 'Transfer' WHEN duration_min <= 1440 THEN 'Extended' ELSE 'Stationary/Construction' END AS event_class FROM dwell),
reg AS (SELECT mmsi, max(length) AS length, mode(ship_type) AS t FROM pings GROUP BY mmsi), vessels AS (SELECT mmsi, sum(duration_min) AS n FROM k GROUP BY mmsi ORDER BY n DESC, mmsi LIMIT 10),
place AS (SELECT d.*, t.latitude AS lat, t.longitude AS lon FROM dwell d JOIN turbines t USING (found_id)),
prev AS (SELECT *, lag("end") OVER w AS p_end, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM place WINDOW w AS (PARTITION BY mmsi ORDER BY "start", "end")),
j AS (SELECT epoch("start" - p_end) / 3600.0 AS hours, {R.HAVERSINE.format(r='3440.065::DOUBLE', a='', b='p_')} AS nm FROM prev),
jumps AS (SELECT CASE WHEN hours < 0 THEN 'overlap' WHEN hours = 0 AND nm > 0 THEN 'moved_in_no_time' ELSE 'too_fast' END AS reason FROM j WHERE hours < 0 OR (hours = 0 AND nm > 0) OR (hours > 0 AND nm / hours > 5)),
sus AS (SELECT concat_ws('; ', CASE WHEN length < 20 THEN 'short' END, CASE WHEN length > 60 THEN 'long' END) AS r FROM reg WHERE length < 20 OR length > 60)
SELECT section, item, round(value, 4) AS value FROM (
SELECT 'counts' AS section, 'events' AS item, count(*)::DOUBLE AS value FROM k UNION ALL SELECT 'counts', 'vessels', count(DISTINCT mmsi) FROM k UNION ALL SELECT 'counts', 'minutes', sum(duration_min) FROM k
UNION ALL SELECT 'classes', event_class, count(*) FROM k GROUP BY event_class UNION ALL SELECT 'farms', wind_farm, count(*) FROM k GROUP BY wind_farm UNION ALL SELECT 'top_vessels', mmsi::VARCHAR, n FROM vessels
UNION ALL SELECT 'duration_min', 'min', min(duration_min) FROM k UNION ALL SELECT 'duration_min', 'p25', quantile_cont(duration_min, 0.25) FROM k UNION ALL SELECT 'duration_min', 'median', quantile_cont(duration_min, 0.5) FROM k
UNION ALL SELECT 'duration_min', 'p75', quantile_cont(duration_min, 0.75) FROM k UNION ALL SELECT 'duration_min', 'max', max(duration_min) FROM k UNION ALL SELECT 'suspects', r, count(*) FROM sus GROUP BY r UNION ALL SELECT 'jumps', reason, count(*) FROM jumps GROUP BY reason)""")
def event_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """AG-67."""
    from tidemark.functions.values import reasons
    from tidemark.plans.lineage import cut

    e = cut(QE._dwell(spark, sf))
    t = R.turbines(spark, sf).select("found_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    registry = R.pings(spark, sf).groupBy("mmsi").agg(F.max("length").alias("length"))
    odd = lambda r: r.withColumn("suspect_reason", reasons((F.col("length") < 20, "short"), (F.col("length") > 60, "long"))).filter("suspect_reason != ''")
    return rounded(Q.event_bundle(e, registry, odd, P.impossible_jumps(e.join(t, "found_id"), 5.0)), value=4)


@query(f"""WITH {R.PINGS}, d AS (SELECT *, epoch(ts - lag(ts) OVER w) / 3600.0 AS hours, {R.HAVERSINE.format(r='3440.065::DOUBLE', a='', b='p_')} AS nm
  FROM (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon FROM pings WINDOW w AS (PARTITION BY mmsi ORDER BY ts, lat, lon)) WINDOW w AS (PARTITION BY mmsi ORDER BY ts, lat, lon)),
k AS (SELECT *, CASE WHEN hours > 0 THEN nm / hours END AS knots FROM d)
SELECT mmsi, count(*) AS pings, count(*) FILTER (knots > 20) AS removed, round(max(knots) FILTER (knots <= 20), 4) AS max_kept, round(max(knots) FILTER (knots > 20), 3) AS max_removed, round(count(*) FILTER (knots > 20) / count(*)::DOUBLE, 6) AS removed_share FROM k GROUP BY mmsi""")
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-07 (report)."""
    return rounded(P.cleaning_report(R.pings(spark, sf), 20.0), max_kept=4, max_removed=3, removed_share=6)


@query(f"""WITH {R.DWELLS}, o AS (SELECT wind_farm, count(*) FILTER (dwell_tier = 'A') AS n FROM dwells GROUP BY wind_farm), l AS (SELECT quantile_cont(n, 0.9) AS q FROM o) SELECT wind_farm, n, round(q, 4) AS "limit" FROM o, l WHERE n > q""")
def outlier_farms(spark: SparkSession, sf: str) -> DataFrame:
    """AG-31 (outliers)."""
    n = R.dwells(spark, sf).groupBy("wind_farm").agg(F.count_if(F.col("dwell_tier") == "A").alias("n"))
    return rounded(Q.outliers(n, "n"), limit=4)


@query(f"""WITH {R.DWELLS}, {R.MANIFEST}, r AS (SELECT unnest([0, 6, 12]) AS m), c AS (SELECT wind_farm, date_trunc('month', min(commissioning)) AS f, date_trunc('month', max(commissioning)) AS l FROM turbines GROUP BY wind_farm),
mt AS (SELECT m, wind_farm, f, l + to_months(m::INT) AS s FROM c, r)
SELECT m AS ramp_up_months, wind_farm, count(*) FILTER (dwell_tier = 'A' AND date_trunc('month', start_utc) >= f) AS tier_a, count(*) FILTER (dwell_tier = 'A' AND date_trunc('month', start_utc) >= s) AS steady FROM mt JOIN dwells USING (wind_farm) GROUP BY ALL""")
def ramp_up_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """AG-31 (ramp-up of 0, 6 and 12 months)."""
    out = Q.ramp_up_sensitivity(R.manifest(spark, sf), R.dwells(spark, sf), R.turbines(spark, sf), [0, 6, 12])
    return out.join(R.dwells(spark, sf).select("wind_farm").distinct(), "wind_farm", "left_semi").select("ramp_up_months", "wind_farm", "tier_a", F.col("tier_a_steady_operational").alias("steady"))


@query(f"""WITH {R.DWELLS}, {R.MANIFEST} SELECT metric, value FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT wind_farm, month FROM manifest))::DOUBLE AS farm_months, (SELECT count(*) FROM turbines)::DOUBLE AS turbines,
count(*)::DOUBLE AS dwells, count(*) FILTER (dwell_tier = 'A')::DOUBLE AS tier_a, count(*) FILTER (duration_min >= 120)::DOUBLE AS long_dwells, count(DISTINCT duplicate_group_id)::DOUBLE AS duplicate_groups FROM dwells) UNPIVOT (value FOR metric IN (farm_months, turbines, dwells, tier_a, long_dwells, duplicate_groups))""")
def intensity_validation(spark: SparkSession, sf: str) -> DataFrame:
    """AG-30."""
    one = R.dwells(spark, sf).agg(F.count(F.lit(1)).alias("dwells"), F.count_if(F.col("dwell_tier") == "A").alias("tier_a"), F.count_if(F.col("duration_min") >= 120).alias("long_dwells"), F.count_distinct("duplicate_group_id").alias("duplicate_groups"))
    more = R.turbines(spark, sf).agg(F.count(F.lit(1)).alias("turbines")).crossJoin(I.manifest_months(R.manifest(spark, sf)).agg(F.count(F.lit(1)).alias("farm_months")))
    return A.metrics_long(one.crossJoin(F.broadcast(more)))


@query("""WITH s AS (SELECT quality AS y, (doc_id % 100) / 100.0::DOUBLE AS s FROM labels), p AS (SELECT s FROM s WHERE y = 1), q AS (SELECT s FROM s WHERE y = 0),
a AS (SELECT (SELECT count(*) FROM p) AS positive, (SELECT count(*) FROM q) AS negative, avg(CASE WHEN p.s > q.s THEN 1.0 WHEN p.s = q.s THEN 0.5 ELSE 0 END) AS auc FROM p, q),
c AS (SELECT s, count(*) FILTER (y = 1) AS n, sum(count(*) FILTER (y = 1)) OVER (ORDER BY s DESC) AS tp, sum(count(*)) OVER (ORDER BY s DESC) AS m FROM s GROUP BY s)
SELECT positive, negative, round(auc, 6) AS roc_auc, round((SELECT sum(n * tp / m) FROM c) / positive, 6) AS average_precision FROM a""")
def roc_pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    """UD-05 (ROC-AUC, PR-AUC)."""
    s = R.table(spark, sf, "labels").withColumn("s", (F.col("doc_id") % 100) / 100.0)
    return rounded(Q.roc_pr_auc(s, "quality", "s"), roc_auc=6, average_precision=6)


@query(f"WITH {R.DWELLS} SELECT dwell_tier, count(*) AS rows, round(avg(price), 2) AS price FROM dwells WHERE wind_farm IN ('NATION_3', 'NATION_7') AND start_utc >= TIMESTAMP '1994-01-01' AND start_utc < TIMESTAMP '1997-01-01' GROUP BY dwell_tier")
def slice_filter(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-08."""
    return rounded(P.slice_rows(R.dwells(spark, sf), ["NATION_3", "NATION_7"], "1994-01-01", "1997-01-01").groupBy("dwell_tier").agg(F.count(F.lit(1)).alias("rows"), F.avg("price").alias("price")), price=2)


@query("""SELECT s_suppkey AS found_id, regexp_replace(regexp_replace(lower(trim(n_name)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') || '::' || s_suppkey AS turbine_id FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def turbine_ids(spark: SparkSession, sf: str) -> DataFrame:
    """JN-25 (stable ids)."""
    return R.turbines(spark, sf).select("found_id", F.concat(slug(F.col("wind_farm")), F.lit("::"), F.col("found_id").cast("string")).alias("turbine_id"))


@query(f"""WITH {R.DWELLS}, m AS (SELECT wind_farm, date_trunc('month', min(commissioning)) AS f, date_trunc('month', max(commissioning)) + INTERVAL 6 MONTH AS s FROM turbines GROUP BY wind_farm),
w AS (SELECT duplicate_group_id, count(DISTINCT wind_farm) AS k FROM dwells WHERE dwell_tier = 'A' AND duplicate_group_id IS NOT NULL GROUP BY 1)
SELECT d.dwell_id, d.found_id, CASE WHEN date_trunc('month', start_utc) < f THEN 'pre_operational' WHEN date_trunc('month', start_utc) < s THEN 'commissioning_ramp_up' ELSE 'steady_operational' END AS phase, round(coalesce(1.0::DOUBLE / k, 1.0), 6) AS weight, t.rated_power, t.rotor_diameter
FROM dwells d JOIN m ON m.wind_farm = d.wind_farm JOIN turbines t ON t.found_id = d.found_id LEFT JOIN w USING (duplicate_group_id) WHERE dwell_tier = 'A'""")
def turbine_events(spark: SparkSession, sf: str) -> DataFrame:
    """JN-25 (tier A events with phase, weight and turbine attributes)."""
    t = R.turbines(spark, sf)
    e = I.duplicate_weight(R.dwells(spark, sf).filter("dwell_tier = 'A'")).join(I.operational_metadata(t), "wind_farm")
    e = e.withColumn("phase", I.lifecycle_phase(F.trunc("start_utc", "MM"), F.col("first_month"), F.col("steady_start")))
    return rounded(e.join(t.select("found_id", "rated_power", "rotor_diameter"), "found_id").select("dwell_id", "found_id", "phase", "weight", "rated_power", "rotor_diameter"), weight=6)


@query("SELECT p_partkey, p_size % 4 = 0 AS yes, false AS brand FROM part")
def text_flags(spark: SparkSession, sf: str) -> DataFrame:
    """FX-10: spellings of true."""
    names = F.array(F.lit(" YES "), F.lit("n"), F.lit("no"), F.lit("off"))
    return R.table(spark, sf, "part").select("p_partkey", flag(F.get(names, F.col("p_size") % 4)).alias("yes"), flag(F.col("p_brand")).alias("brand"))


@query(f"""WITH {R.CANDIDATES.replace(R.EVENT_LINES, "lineitem")} SELECT 'real' AS provenance, count(*) AS rows FROM candidates GROUP BY 1""")
def provenance_gate(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-10: passes, as every row is labelled real; a test has rows that fail."""
    line = R.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("current_speed")).withColumn("provenance", F.lit("real"))
    return E.provenance_gate(line).groupBy("provenance").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT count(*) AS rows, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders")
def without_empty_columns(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-11."""
    o = A.drop_empty_columns(R.table(spark, sf, "orders").withColumns({"a": F.lit(None).cast("string"), "b": F.lit(None).cast("double")}))
    return o.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(",".join(o.columns)))


@query(f"""WITH {R.DWELLS}, n AS (SELECT *, row_number() OVER (ORDER BY start_utc, dwell_id) AS r, count(*) OVER () AS c FROM dwells), w AS (SELECT DISTINCT round_even(i * (c - 1) / 9.0, 0)::BIGINT + 1 AS r FROM (SELECT DISTINCT c FROM n), (SELECT unnest(range(10)) AS i))
SELECT dwell_id, r AS position, duration_min, round(epoch(end_utc - (to_timestamp(floor(epoch(start_utc)))::TIMESTAMP)) / 60.0, 6) AS expected, true AS as_expected FROM n SEMI JOIN w USING (r)""")
def spot_checks(spark: SparkSession, sf: str) -> DataFrame:
    """AG-68: evenly spaced dwells with their durations computed anew from both times."""
    d = R.dwells(spark, sf).select("start_utc", "dwell_id", "end_utc", "duration_min")
    seconds = F.unix_seconds("end_utc") - F.unix_seconds("start_utc")
    out = A.recomputed(A.spot_checks(d, ["start_utc", "dwell_id"], 10), "duration_min", seconds / 60.0)
    return rounded(out.select("dwell_id", "position", "duration_min", "expected", "as_expected"), expected=6)
