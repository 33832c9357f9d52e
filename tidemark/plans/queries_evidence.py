"""Queries on evidence, fusion, envelopes, intensity, audits and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import normal_name, slug
from tidemark.operators import audit as A
from tidemark.operators import envelope as V
from tidemark.operators import evidence as E
from tidemark.operators import intensity as I
from tidemark.operators import lags
from tidemark.operators import pings as P
from tidemark.operators import stats as S
from tidemark.operators import timejoin as J
from tidemark.plans import roles as R
from tidemark.plans.lineage import cut
from tidemark.plans.register import query, rounded
from tidemark.sources import gridded as G

_AGREE = "CASE WHEN {h} IS NULL OR {t} IS NULL THEN 'insufficient' WHEN {h} <= 0.15 AND {t} <= 0.75 THEN 'strong' WHEN {h} <= 0.35 AND {t} <= 1.5 THEN 'moderate' ELSE 'weak' END"
_PAIRS = f"""pairs AS (
  SELECT a.dwell_id, a.source AS source_a, b.source AS source_b, a.hs AS ha, b.hs AS hb, a.hs - b.hs AS hs_diff, a.tp - b.tp AS tp_diff, abs((a.direction - b.direction + 180 + 360) % 360 - 180) AS direction_diff,
         {_AGREE.format(h='abs(a.hs - b.hs)', t='abs(a.tp - b.tp)')} AS agreement
  FROM candidates a JOIN candidates b ON a.dwell_id = b.dwell_id AND a.rank < b.rank)"""


@query(f"WITH {R.CANDIDATES}, {_PAIRS} SELECT dwell_id, source_a, source_b, round(hs_diff, 5) + 0.0 AS hs_diff, round(tp_diff, 5) + 0.0 AS tp_diff, round(direction_diff, 5) AS direction_diff, agreement FROM pairs")
def source_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """JN-15, SC-03."""
    out = rounded(E.pairwise(R.candidates(spark, sf)), hs_diff=5, tp_diff=5, direction_diff=5)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("hs_diff", "tp_diff")})


@query(f"""WITH {R.CANDIDATES}, {_PAIRS} SELECT source_a, source_b, count(*) AS n, round(corr(ha, hb) ** 2, 5) AS r2, round(sqrt(avg(hs_diff ** 2)), 6) AS rmse, round(avg(abs(hs_diff)), 6) AS mae, round(avg(hs_diff), 6) AS bias,
round(quantile_cont(abs(hs_diff), 0.5), 6) AS median_abs, round(quantile_cont(abs(hs_diff), 0.95), 6) AS p95_abs FROM pairs GROUP BY ALL""")
def pairwise_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """AG-11, AG-13."""
    c = R.candidates(spark, sf).withColumn("rank", E.source_rank(F.col("source")))
    p = c.alias("a").join(c.alias("b"), (F.col("a.dwell_id") == F.col("b.dwell_id")) & (F.col("a.rank") < F.col("b.rank")))
    out = E.pair_metrics(p.select(F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"), F.col("a.hs").alias("hs_a"), F.col("b.hs").alias("hs_b")), ["source_a", "source_b"], "hs_a", "hs_b")
    return rounded(out, r2=5, rmse=6, mae=6, bias=6, median_abs=6, p95_abs=6)


@query(f"""WITH {R.CANDIDATES},
s AS (SELECT a.dwell_id, a.source, a.rank, a.hs, a.tp, a.quality, a.shallow, coalesce(avg(abs(a.hs - b.hs) / 0.15::DOUBLE + abs(a.tp - b.tp) / 0.75::DOUBLE), 0) AS dis
      FROM candidates a LEFT JOIN candidates b ON a.dwell_id = b.dwell_id AND a.source <> b.source GROUP BY ALL),
g AS (SELECT dwell_id, count(*) AS n_sources, sum(quality / (1 + dis) * hs) / sum(quality / (1 + dis)) AS hs, sum(quality / (1 + dis) * tp) / sum(quality / (1 + dis)) AS tp,
             max(hs) - min(hs) AS hs_range, max(tp) - min(tp) AS tp_range, bool_or(shallow) AS sh FROM s GROUP BY dwell_id),
k AS (SELECT *, {_AGREE.format(h='hs_range', t='tp_range')} AS agree FROM g),
c AS (SELECT *, CASE WHEN n_sources >= 2 AND agree = 'strong' AND NOT sh THEN 'A' WHEN n_sources >= 2 AND agree IN ('strong', 'moderate') THEN 'B' ELSE 'C' END AS confidence FROM k)
SELECT dwell_id, n_sources, round(hs, 5) AS hs, round(tp, 5) AS tp, round(hs_range, 5) AS hs_range, round(tp_range, 5) AS tp_range, confidence,
       CASE WHEN confidence = 'A' THEN 'sources_agree' WHEN confidence = 'B' THEN 'sources_nearly_agree' WHEN n_sources = 1 THEN 'single_source' ELSE 'sources_disagree' END AS confidence_reason FROM c""")
def event_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """SC-05, SC-06."""
    out = E.event_confidence(R.candidates(spark, sf)).select("dwell_id", "n_sources", "hs", "tp", "hs_range", "tp_range", "confidence", "confidence_reason")
    return rounded(out, hs=5, tp=5, hs_range=5, tp_range=5)


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    d = R.dwells(spark, sf)
    wave = d.select("dwell_id", "hs", "tp", F.lit("nws").alias("wave_source"), F.when(F.col("hs").isNull() | F.col("tp").isNull(), "D").when(F.col("depth") > 10, "A").otherwise("C").alias("wave_confidence"))
    s, c = F.sin(F.radians("wind_direction")), F.cos(F.radians("wind_direction"))
    wc, _ = E.wind_confidence(F.col("wind_speed"), s, c)
    wind = d.select("dwell_id", "wind_speed", "wind_direction", wc.alias("wind_confidence"))
    cc = E.current_confidence(F.col("current_speed"), F.col("km"), F.col("dwell_id") % 2 == 0, (F.col("dwell_id") % 100).cast("double"), (F.col("dwell_id") % 10) / 100.0)
    current = d.select("dwell_id", "current_speed", cc.alias("current_confidence"))
    return E.fuse(d.select("dwell_id", "wind_farm", "dwell_tier", "start_utc", "depth"), wave, wind, current)


FUSED = f"""{R.DWELLS}, conf AS (
  SELECT *, CASE WHEN hs IS NULL OR tp IS NULL THEN 'D' WHEN depth > 10 THEN 'A' ELSE 'C' END AS wave_confidence, CASE WHEN wind_speed IS NULL THEN 'D' ELSE 'A' END AS wind_confidence,
         CASE WHEN current_speed IS NULL THEN 'D' WHEN km <= 10 AND dwell_id % 2 = 0 AND dwell_id % 100 <= 60 AND dwell_id % 10 <= 5 THEN 'A' WHEN km <= 10 AND dwell_id % 2 = 0 AND (dwell_id % 100 <= 60 OR dwell_id % 10 <= 5) THEN 'B' ELSE 'C' END AS current_confidence FROM dwells),
ready AS (SELECT *, wave_confidence <> 'D' AS wave_ready, wind_confidence = 'A' AS wind_ready, current_confidence IN ('A', 'B') AS current_ready FROM conf),
fused AS (
  SELECT dwell_id, wind_farm, dwell_tier, start_utc, depth, hs, tp, wave_confidence, wind_speed, wind_confidence, current_confidence, wave_ready, wind_ready, current_ready,
         CASE WHEN current_ready THEN current_speed END AS current_speed, CASE WHEN wind_confidence = 'A' THEN wind_direction END AS wind_direction,
         CASE WHEN wave_ready AND wind_ready AND current_ready THEN 'multivariate' WHEN wave_ready AND wind_ready THEN 'wave_wind' WHEN wave_ready THEN 'wave_only' WHEN wind_ready THEN 'wind_only' ELSE 'none' END AS feature_class,
         concat_ws('; ', CASE WHEN NOT wave_ready THEN 'wave_not_ready' END, CASE WHEN NOT wind_ready THEN 'wind_not_ready' END, CASE WHEN NOT current_ready THEN 'current_not_ready' END) AS missing_reason
  FROM ready)"""


@query(f"WITH {FUSED} SELECT dwell_id, hs, wind_speed, current_speed, wind_direction, wave_ready, wind_ready, current_ready, feature_class, missing_reason FROM fused")
def fused_events(spark: SparkSession, sf: str) -> DataFrame:
    """JN-09, SC-08, SC-09, SC-10, SC-27, UD-02."""
    return _layers(spark, sf).select("dwell_id", "hs", "wind_speed", "current_speed", "wind_direction", "wave_ready", "wind_ready", "current_ready", "feature_class", "missing_reason")


@query(f"""WITH {FUSED} SELECT 'dwell_tier' AS level, dwell_tier, NULL::VARCHAR AS feature_class, count(*) AS rows, count(*) FILTER (wave_ready) AS valid_rows, round(count(*) FILTER (wave_ready) / count(*)::DOUBLE, 6) AS valid_share FROM fused GROUP BY dwell_tier
UNION ALL SELECT 'dwell_tier+feature_class', dwell_tier, feature_class, count(*), count(*) FILTER (wave_ready), round(count(*) FILTER (wave_ready) / count(*)::DOUBLE, 6) FROM fused GROUP BY dwell_tier, feature_class""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """AG-12, AG-37, AG-42 (grouping sets)."""
    return rounded(A.coverage(_layers(spark, sf), F.col("wave_ready"), [["dwell_tier"], ["dwell_tier", "feature_class"]]), valid_share=6)


@query(f"""WITH {R.DWELLS}, u AS (SELECT dwell_tier, 'hs' AS "column", hs AS v FROM dwells UNION ALL SELECT dwell_tier, 'tp', tp FROM dwells UNION ALL SELECT dwell_tier, 'price', price FROM dwells)
SELECT dwell_tier, "column", count(v) AS n, round(min(v), 4) AS min, round(quantile_cont(v, 0.05), 4) AS p05, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75,
       round(quantile_cont(v, 0.95), 4) AS p95, round(max(v), 4) AS max, round(avg(v), 5) AS mean, NULL::VARCHAR AS unavailable FROM u GROUP BY ALL""")
def distributions(spark: SparkSession, sf: str) -> DataFrame:
    """AG-09."""
    out = A.distribution(R.dwells(spark, sf), ["hs", "tp", "price"], "dwell_tier")
    return rounded(out, min=4, p05=4, p25=4, median=4, p75=4, p95=4, max=4, mean=5)


@query(f"""WITH {R.DWELLS}, b AS (SELECT CASE WHEN tp > 2 AND tp <= 4 THEN 2.0 WHEN tp > 4 AND tp <= 6 THEN 4.0 WHEN tp > 6 AND tp <= 9 THEN 6.0 WHEN tp > 9 AND tp <= 12 THEN 9.0 END AS bin, hs FROM dwells WHERE dwell_tier = 'A'),
bins AS (SELECT unnest([2.0, 4.0, 6.0, 9.0, 50.0])::DOUBLE AS bin)
SELECT bins.bin, count(hs) AS n, round(quantile_cont(hs, 0.5), 5) AS p50, round(quantile_cont(hs, 0.75), 5) AS p75, round(quantile_cont(hs, 0.9), 5) AS p90, round(quantile_cont(hs, 0.95), 5) AS p95, min(hs) AS lo, max(hs) AS hi FROM bins LEFT JOIN b ON bins.bin = b.bin GROUP BY bins.bin""")
def tp_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """AG-16, UD-01; unobserved bins stay."""
    axis = V.Axis("tp", (2.0, 4.0, 6.0, 9.0, 12.0), right=True)
    bins = spark.createDataFrame([(2.0,), (4.0,), (6.0,), (9.0,), (50.0,)], "bin double")
    return rounded(V.boundary(R.dwells(spark, sf).filter("dwell_tier = 'A'"), bins, axis.left(), "hs"), p50=5, p75=5, p90=5, p95=5)


@query(f"""WITH {R.DWELLS}, own AS (SELECT dwell_tier, hs, tp, CASE WHEN hs >= 0 AND hs < 4 THEN floor(hs) END AS h, CASE WHEN tp >= 2 AND tp < 10 THEN floor(tp / 2) * 2 END AS t FROM dwells),
acc AS (SELECT dwell_tier, count(*) AS group_rows, count(*) FILTER (hs IS NULL OR tp IS NULL) AS null_rows, count(*) FILTER (hs IS NOT NULL AND tp IS NOT NULL AND (h IS NULL OR t IS NULL)) AS outside_rows FROM own GROUP BY dwell_tier),
grid AS (SELECT hs_left, tp_left FROM (SELECT unnest([0, 1, 2, 3])::DOUBLE AS hs_left), (SELECT unnest([2, 4, 6, 8])::DOUBLE AS tp_left)),
c AS (SELECT dwell_tier, h AS hs_left, t AS tp_left, count(*) AS n FROM own WHERE h IS NOT NULL AND t IS NOT NULL GROUP BY ALL)
SELECT acc.dwell_tier, grid.hs_left, grid.hs_left + 1 AS hs_right, grid.tp_left, grid.tp_left + 2 AS tp_right, group_rows, null_rows, outside_rows, coalesce(n, 0) AS rows
FROM acc CROSS JOIN grid LEFT JOIN c ON c.dwell_tier = acc.dwell_tier AND c.hs_left = grid.hs_left AND c.tp_left = grid.tp_left""")
def occupancy_surface(spark: SparkSession, sf: str) -> DataFrame:
    """AG-18, AG-19, AG-20, UD-04."""
    spec = V.Surface((V.Axis("hs", (0, 1, 2, 3, 4)), V.Axis("tp", (2, 4, 6, 8, 10))), ("dwell_tier",))
    return V.occupancy_surface(R.dwells(spark, sf), spec)


@query(f"""WITH {R.DWELLS}, r AS (SELECT tp AS x, hs AS v, count(*) AS n FROM dwells WHERE tp IS NOT NULL AND hs IS NOT NULL GROUP BY ALL), g AS (SELECT unnest(generate_series(2, 12))::DOUBLE AS g),
w AS (SELECT g, v, sum(n * exp(-0.5 * (x - g) ** 2)) AS w FROM g, r WHERE abs(x - g) <= 6 GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY v) AS run, sum(w) OVER (PARTITION BY g) AS total FROM w)
SELECT g, round(max(total), 4) AS weight, min(v) FILTER (run >= 0.5 * total) AS p50, min(v) FILTER (run >= 0.95 * total) AS p95 FROM c WHERE total >= 2 GROUP BY g""")
def kernel_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """AG-21, WN-12."""
    g = spark.range(2, 13).select(F.col("id").cast("double").alias("g"))
    return rounded(V.kernel_percentiles(R.dwells(spark, sf), g, "tp", "hs", (0.5, 0.95)), weight=4)


@query(f"WITH {R.DWELLS}, n AS (SELECT dwell_tier, hs, count(*) AS n FROM dwells WHERE hs IS NOT NULL GROUP BY ALL) SELECT dwell_tier, hs, round(sum(n) OVER (PARTITION BY dwell_tier ORDER BY hs) / sum(n) OVER (PARTITION BY dwell_tier), 6) AS ecdf FROM n")
def ecdf(spark: SparkSession, sf: str) -> DataFrame:
    """AG-23."""
    return rounded(V.ecdf(R.dwells(spark, sf), ["dwell_tier"], "hs"), ecdf=6)


_LANES = [V.Lane("all", "wave_ready"), V.Lane("tier_a", "wave_ready and dwell_tier = 'A'"), V.Lane("multi", "feature_class = 'multivariate'")]
_SCOPES = [V.Lane("all_depths", "true"), V.Lane("deep", "depth > 10"), V.Lane("warned", "depth <= 10")]


@query(f"""WITH {FUSED}, lanes AS (SELECT 'all' AS lane, * FROM fused WHERE wave_ready UNION ALL SELECT 'tier_a', * FROM fused WHERE wave_ready AND dwell_tier = 'A' UNION ALL SELECT 'multi', * FROM fused WHERE feature_class = 'multivariate'),
scoped AS (SELECT 'all_depths' AS scope, * FROM lanes UNION ALL SELECT 'deep', * FROM lanes WHERE depth > 10 UNION ALL SELECT 'warned', * FROM lanes WHERE depth <= 10),
farm AS (SELECT lane, scope, wind_farm, count(*) AS n FROM scoped GROUP BY ALL), top AS (SELECT lane, scope, max(n) / sum(n) AS top_share FROM farm GROUP BY ALL),
s AS (SELECT lane, scope, count(*) AS n, quantile_cont(hs, 0.95) AS hs_p95, quantile_cont(tp, 0.95) AS tp_p95 FROM scoped GROUP BY ALL), j AS (SELECT * FROM s JOIN top USING (lane, scope))
SELECT j.lane, j.scope, j.n, round(j.hs_p95, 4) AS hs_p95, round(j.tp_p95, 4) AS tp_p95, round(j.top_share, 5) AS top_share, round(j.n / b.n, 6) AS retained_share,
       concat_ws('; ', CASE WHEN j.n / b.n < 0.8 THEN 'rows' END, CASE WHEN abs(j.hs_p95 - b.hs_p95) >= 0.25 THEN 'hs' END, CASE WHEN abs(j.tp_p95 - b.tp_p95) >= 0.5 THEN 'tp' END, CASE WHEN abs(j.top_share - b.top_share) >= 0.1 THEN 'top_farm' END) AS material
FROM j JOIN j b ON b.lane = 'all' AND b.scope = j.scope""")
def lane_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-13, FLT-16, AG-39, AG-40, UD-03."""
    rows = cut(V.in_lanes(_layers(spark, sf), _LANES, _SCOPES).select("lane", "scope", "wind_farm", "hs", "tp"))
    key = ["lane", "scope"]
    top = rows.groupBy(*key, "wind_farm").agg(F.count(F.lit(1)).alias("m")).groupBy(*key).agg((F.max("m") / F.sum("m")).alias("top_share"))
    s = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.percentile("hs", 0.95).alias("hs_p95"), F.percentile("tp", 0.95).alias("tp_p95")).join(top, key)
    s = cut(s)
    out = V.lane_comparison(s, "all").select(*key, "n", "hs_p95", "tp_p95", "top_share", "retained_share", "material")
    return rounded(out, hs_p95=4, tp_p95=4, top_share=5, retained_share=6)


_META = "meta AS (SELECT wind_farm, count(*) AS turbine_count, min(date_trunc('month', commissioning))::DATE AS first_month, max(date_trunc('month', commissioning))::DATE AS last_month, (max(date_trunc('month', commissioning)) + INTERVAL 6 MONTH)::DATE AS steady_start FROM turbines GROUP BY wind_farm)"
_STATE = "st AS (SELECT wind_farm, month, CASE WHEN bool_or(status IN ('success', 'success_no_ais_in_bbox')) THEN 'observed' WHEN bool_or(status IN ('skipped_missing_source', 'failed')) THEN 'missing' ELSE 'other' END AS state FROM manifest GROUP BY ALL)"
_PHASE = "CASE WHEN first_month IS NULL OR steady_start IS NULL THEN 'unknown_phase' WHEN {m} < first_month THEN 'pre_operational' WHEN {m} < steady_start THEN 'commissioning_ramp_up' ELSE 'steady_operational' END"


@query(f"""WITH {R.TURBINES}, {R.MANIFEST}, {_META}, {_STATE}, p AS (SELECT st.*, {_PHASE.format(m='month')} AS phase FROM st LEFT JOIN meta USING (wind_farm))
SELECT wind_farm, count(*) AS months, count(*) FILTER (state = 'observed') AS observed_months, count(*) FILTER (state = 'missing') AS missing_months, count(*) FILTER (state = 'other') AS other_months,
       count(*) FILTER (state = 'observed' AND phase = 'pre_operational') AS observed_pre_operational, count(*) FILTER (state = 'observed' AND phase = 'commissioning_ramp_up') AS observed_commissioning_ramp_up,
       count(*) FILTER (state = 'observed' AND phase = 'steady_operational') AS observed_steady_operational, count(*) FILTER (state = 'observed' AND phase = 'unknown_phase') AS observed_unknown_phase,
       round(count(*) FILTER (state = 'observed') / 12.0::DOUBLE, 6) AS observed_years, round(count(*) FILTER (state = 'observed') / count(*)::DOUBLE, 6) AS coverage_share FROM p GROUP BY wind_farm""")
def manifest_denominator(spark: SparkSession, sf: str) -> DataFrame:
    """AG-26, AG-27, SC-14."""
    out = I.denominator(R.manifest(spark, sf), I.operational_metadata(R.turbines(spark, sf))).drop("first_observed", "last_observed")
    return rounded(out, observed_years=6, coverage_share=6)


_NUM = f"""ph AS (SELECT d.*, {_PHASE.format(m="date_trunc('month', start_utc)::DATE")} AS phase FROM dwells d LEFT JOIN meta USING (wind_farm)),
op AS (SELECT * FROM ph WHERE phase <> 'pre_operational'), dg AS (SELECT duplicate_group_id, count(DISTINCT wind_farm) AS n FROM op WHERE duplicate_group_id IS NOT NULL GROUP BY ALL),
wt AS (SELECT op.*, coalesce(1.0::DOUBLE / n, 1.0) AS weight FROM op LEFT JOIN dg USING (duplicate_group_id)),
num AS (SELECT wind_farm, count(*) FILTER (dwell_tier = 'A') AS tier_a, count(*) FILTER (dwell_tier = 'B') AS tier_b, count(*) FILTER (dwell_tier = 'A' AND duration_min >= 120) AS long_dwells,
               count(DISTINCT mmsi) FILTER (dwell_tier = 'A') AS vessels, sum(CASE WHEN dwell_tier = 'A' THEN weight ELSE 0 END) AS tier_a_weighted FROM wt GROUP BY wind_farm),
pre AS (SELECT wind_farm, count(*) AS pre_operational FROM ph WHERE phase = 'pre_operational' GROUP BY wind_farm),
den AS (SELECT wind_farm, count(*) AS months, count(*) FILTER (state = 'observed') AS om FROM st GROUP BY wind_farm)"""


@query(f"""WITH {R.DWELLS}, {R.MANIFEST}, {_META}, {_STATE}, {_NUM},
j AS (SELECT wind_farm, coalesce(om, 0) / 12.0::DOUBLE AS years, om / months::DOUBLE AS cover, coalesce(tier_a, 0) AS tier_a, coalesce(tier_b, 0) AS tier_b, coalesce(long_dwells, 0) AS long_dwells, coalesce(vessels, 0) AS vessels,
             coalesce(tier_a_weighted, 0) AS w, coalesce(pre_operational, 0) AS pre_operational, turbine_count FROM den FULL JOIN (SELECT * FROM num FULL JOIN pre USING (wind_farm)) USING (wind_farm) LEFT JOIN meta USING (wind_farm))
SELECT wind_farm, tier_a, tier_b, long_dwells, vessels, pre_operational, turbine_count, round(years, 6) AS observed_years, round(CASE WHEN years > 0 THEN tier_a / years END, 5) AS tier_a_per_year,
       round(CASE WHEN years > 0 THEN tier_a / years / turbine_count END, 5) AS tier_a_per_turbine_year, round(CASE WHEN years > 0 THEN w / years END, 5) AS weighted_per_year,
       CASE WHEN years >= 5 AND coalesce(cover, 0) >= 0.8 THEN 'high' WHEN years >= 1 AND coalesce(cover, 0) >= 0.5 THEN 'medium' WHEN years > 0 THEN 'low' ELSE 'none' END AS confidence FROM j""")
def farm_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """AG-28, AG-29, JN-18, JN-26, WN-09."""
    out = I.farm_intensity(R.manifest(spark, sf), R.dwells(spark, sf), R.turbines(spark, sf))
    out = out.select("wind_farm", "tier_a", "tier_b", "long_dwells", "vessels", "pre_operational", "turbine_count", "observed_years", "tier_a_per_year", "tier_a_per_turbine_year", "weighted_per_year", "confidence")
    return rounded(out, observed_years=6, tier_a_per_year=5, tier_a_per_turbine_year=5, weighted_per_year=5)


@query(f"""WITH {R.DWELLS}, {R.MANIFEST}, {_META}, {_STATE}, {_NUM}, j AS (SELECT wind_farm, coalesce(tier_a, 0) AS tier_a FROM den FULL JOIN num USING (wind_farm))
(SELECT 'top' AS side, wind_farm, tier_a FROM j ORDER BY tier_a DESC NULLS LAST, wind_farm LIMIT 20) UNION ALL (SELECT 'bottom', wind_farm, tier_a FROM j ORDER BY tier_a ASC NULLS LAST, wind_farm LIMIT 20)""")
def top_and_bottom_farms(spark: SparkSession, sf: str) -> DataFrame:
    """TK-02, AG-31 (top and bottom)."""
    f = I.farm_intensity(R.manifest(spark, sf), R.dwells(spark, sf), R.turbines(spark, sf)).select("wind_farm", "tier_a")
    top = f.orderBy(F.desc_nulls_last("tier_a"), "wind_farm").limit(20).select(F.lit("top").alias("side"), "*")
    return top.unionByName(f.orderBy(F.asc_nulls_last("tier_a"), "wind_farm").limit(20).select(F.lit("bottom").alias("side"), "*"))


@query(f"""WITH {R.DWELLS}, {R.MANIFEST}, {_STATE}, d AS (SELECT t.wind_farm, found_id, count(*) AS months, count(*) FILTER (state = 'observed') AS observed_months, count(*) FILTER (state = 'missing') AS missing_months, count(*) FILTER (state = 'other') AS other_months
  FROM st JOIN turbines t ON st.wind_farm = t.wind_farm AND month >= (date_trunc('month', commissioning) + INTERVAL 6 MONTH)::DATE GROUP BY ALL),
dg AS (SELECT duplicate_group_id, count(DISTINCT wind_farm) AS n FROM dwells WHERE duplicate_group_id IS NOT NULL GROUP BY ALL),
e AS (SELECT x.*, coalesce(1.0::DOUBLE / n, 1.0) AS weight, CASE WHEN dist_m <= 200 THEN 'high' WHEN dist_m <= 500 THEN 'medium' ELSE 'unassigned' END AS assignment,
             coalesce(epoch(start_utc - lag(start_utc) OVER (PARTITION BY found_id ORDER BY start_utc, dwell_id)) / 86400.0 <= 30, false) AS rep FROM (SELECT * FROM dwells WHERE dwell_tier = 'A') x LEFT JOIN dg2 USING (duplicate_group_id)),
g AS (SELECT found_id, count(*) FILTER (assignment = 'high') AS pe, sum(CASE WHEN assignment = 'high' THEN weight ELSE 0 END) AS pw, count(DISTINCT mmsi) FILTER (assignment = 'high') AS pv, count(*) FILTER (assignment = 'high' AND rep) AS pr,
             count(*) FILTER (assignment IN ('high', 'medium')) AS se FROM e GROUP BY found_id)
SELECT d.*, CASE WHEN observed_months / months::DOUBLE >= 0.8 AND observed_months >= 60 THEN 'high' WHEN observed_months / months::DOUBLE >= 0.5 AND observed_months >= 12 THEN 'medium' ELSE 'low' END AS coverage_class,
       coalesce(pe, 0) AS primary_events, round(coalesce(pw, 0), 5) AS primary_weight, coalesce(pv, 0) AS primary_vessels, coalesce(pr, 0) AS primary_repeats, coalesce(se, 0) AS sensitivity_events,
       round(CASE WHEN observed_months > 0 THEN coalesce(pe, 0) / (observed_months / 12.0::DOUBLE) END, 5) AS primary_per_year FROM d LEFT JOIN g USING (found_id)""".replace("dg AS (SELECT duplicate_group_id, count(DISTINCT wind_farm) AS n FROM dwells WHERE", "dg2 AS (SELECT duplicate_group_id, count(DISTINCT wind_farm) AS n FROM dwells WHERE dwell_tier = 'A' AND"))
def turbine_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """JN-04, JN-19, AG-32, AG-33, WN-06."""
    e = R.dwells(spark, sf).filter("dwell_tier = 'A'").withColumn("assignment", E.distance_band(F.col("dist_m")))
    out = I.turbine_intensity(e, I.turbine_denominator(R.manifest(spark, sf), R.turbines(spark, sf)))
    out = out.select("wind_farm", "found_id", "months", "observed_months", "missing_months", "other_months", "coverage_class", "primary_events", "primary_weight", "primary_vessels", "primary_repeats", "sensitivity_events", "primary_per_year")
    return rounded(out, primary_weight=5, primary_per_year=5)


@query(f"""WITH {R.TURBINES}, c AS (SELECT *, avg(latitude) OVER w AS clat, avg(longitude) OVER w AS clon, count(*) OVER w AS n FROM turbines WINDOW w AS (PARTITION BY wind_farm)),
k AS (SELECT *, round({R.HAVERSINE.format(r='6371.0088::DOUBLE', a='', b='c.c').replace('lat', 'lat').replace('radians(lat)', 'radians(latitude)').replace('- lat)', '- latitude)').replace('- lon)', '- longitude)')}, 6) AS centroid_km FROM c),
r AS (SELECT *, rank() OVER (PARTITION BY wind_farm ORDER BY centroid_km) + (count(*) OVER (PARTITION BY wind_farm, centroid_km) - 1) / 2.0::DOUBLE AS rk FROM k),
q AS (SELECT *, CASE WHEN n < 4 THEN 0.5 ELSE (rk - 1) / (n - 1) END AS distance_quantile FROM r)
SELECT found_id, wind_farm, round(centroid_km, 3) AS centroid_km, round(distance_quantile, 6) AS distance_quantile, CASE WHEN n >= 4 AND distance_quantile >= 0.75 THEN 'outer' ELSE 'inner' END AS ring FROM q""".replace("c.c", "c"))
def turbine_rings(spark: SparkSession, sf: str) -> DataFrame:
    """WN-04, SC-24."""
    return rounded(I.distance_quantile(R.turbines(spark, sf)).select("found_id", "wind_farm", "centroid_km", "distance_quantile", "ring"), centroid_km=3, distance_quantile=6)


@query("""WITH p AS (SELECT p_partkey AS found_id, p_brand AS wind_farm, p_size % 4 AS events, (p_partkey % 60) / 10.0::DOUBLE AS years, p_type, (p_size // 10)::VARCHAR AS size_band FROM part),
u AS (SELECT *, 'p_type' AS characteristic, p_type AS value FROM p UNION ALL SELECT *, 'size_band', size_band FROM p), t AS (SELECT * FROM u, (SELECT unnest([0.0, 1.0, 3.0])::DOUBLE AS least_years) WHERE years >= least_years),
f AS (SELECT characteristic, value, least_years, wind_farm, count(*) AS n, sum(events) AS events, sum(years) AS years, count(*) FILTER (events = 0) AS zero FROM t GROUP BY ALL),
g AS (SELECT characteristic, value, least_years, sum(n) AS turbines, sum(events) AS events, sum(years) AS years, sum(zero) AS zero, arg_max(wind_farm, n * 1000000 + substr(wind_farm, 7)::INT) AS any_top, max(n) AS top_n FROM f GROUP BY ALL)
SELECT characteristic, value, least_years, turbines::BIGINT AS turbines, events::BIGINT AS events, round(CASE WHEN years > 0 THEN events / years END, 5) AS rate, round(zero / turbines, 6) AS zero_share, round(top_n / turbines, 6) AS top_share,
       CASE WHEN turbines < 5 THEN 'few_turbines' WHEN top_n / turbines > 0.5 THEN 'one_farm_dominates' ELSE 'ok' END AS interpretation FROM g""")
def characteristic_rates(spark: SparkSession, sf: str) -> DataFrame:
    """AG-35."""
    p = R.table(spark, sf, "part").select(F.col("p_partkey").alias("found_id"), F.col("p_brand").alias("wind_farm"), (F.col("p_size") % 4).alias("events"), ((F.col("p_partkey") % 60) / 10.0).alias("years"), "p_type", F.floor(F.col("p_size") / 10).cast("string").alias("size_band"))
    out = I.characteristic_rates(p, ["p_type", "size_band"], [0.0, 1.0, 3.0]).drop("top_farm")
    return rounded(out, rate=5, zero_share=6, top_share=6)


@query(f"""WITH {R.DWELLS}, u AS (SELECT 'wind_farm' AS "column", wind_farm AS value FROM dwells UNION ALL SELECT 'dwell_tier', dwell_tier FROM dwells), n AS (SELECT "column", value, count(*) AS n FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank FROM n)
SELECT "column", count(*) AS "distinct", max(value) FILTER (rank = 1) AS top_value, round(max(n) FILTER (rank = 1) / sum(n), 6) AS top_share, round(sum(n) FILTER (rank <= 5) / sum(n), 6) AS top_few_share FROM r GROUP BY "column" """)
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    """AG-38, WN-03."""
    return rounded(A.concentration(R.dwells(spark, sf), ["wind_farm", "dwell_tier"]), top_share=6, top_few_share=6)


@query(f"""WITH {R.DWELLS} SELECT 'hs' AS "column", count(*) - count(hs) AS nulls, count(*) FILTER (hs = 0) AS zeros, count(DISTINCT hs) AS "distinct", round((count(*) - count(hs)) / count(*)::DOUBLE, 6) AS null_share FROM dwells
UNION ALL SELECT 'duplicate_group_id', count(*) - count(duplicate_group_id), count(*) FILTER (duplicate_group_id = 0), count(DISTINCT duplicate_group_id), round((count(*) - count(duplicate_group_id)) / count(*)::DOUBLE, 6) FROM dwells""")
def null_rates(spark: SparkSession, sf: str) -> DataFrame:
    """AG-62 (completeness), AG-63."""
    d = R.dwells(spark, sf)
    out = A.null_rates(d, ["hs", "duplicate_group_id"])
    zeros = d.agg(F.count_if(F.col("hs") == 0).alias("hs"), F.count_if(F.col("duplicate_group_id") == 0).alias("duplicate_group_id"))
    long = A.metrics_long(zeros).select(F.col("metric").alias("column"), F.col("value").cast("long").alias("zeros"))
    return rounded(out.drop("zeros").join(long, "column").select("column", "nulls", "zeros", "distinct", "null_share"), null_share=6)


@query(f"""WITH {R.DWELLS} SELECT 'hs_not_negative' AS rule, count(*) AS rows, count(*) FILTER (NOT hs >= 0) AS broken, count(*) FILTER (NOT hs >= 0) = 0 AS passed FROM dwells UNION ALL SELECT 'tp_below_10', count(*), count(*) FILTER (NOT tp < 10), count(*) FILTER (NOT tp < 10) = 0 FROM dwells""")
def physical_checks(spark: SparkSession, sf: str) -> DataFrame:
    """SC-21."""
    return A.physical_checks(R.dwells(spark, sf), {"hs_not_negative": F.col("hs") >= 0, "tp_below_10": F.col("tp") < 10})


@query(f"""WITH {R.DWELLS}, b AS (SELECT dwell_id FROM dwells WHERE dwell_tier <> 'D')
SELECT (SELECT count(*) FROM dwells) AS rows_a, (SELECT count(*) FROM b) AS rows_b, 0::BIGINT AS repeated_a, 0::BIGINT AS repeated_b, (SELECT count(*) FROM dwells WHERE dwell_id NOT IN (SELECT dwell_id FROM b)) AS only_a, 0::BIGINT AS only_b, false AS same_keys""")
def key_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """SO-03, SO-04, JN-17."""
    d = R.dwells(spark, sf)
    return A.key_comparison(d, d.filter("dwell_tier != 'D'"), "dwell_id")


@query("""WITH m AS (SELECT user_id, event_type AS stage, CASE WHEN value < 100 THEN 'failed' WHEN value < 300 THEN 'partial' ELSE 'success' END AS status, ts FROM events),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id, stage ORDER BY ts DESC, status) = 1),
r AS (SELECT *, list_position(['view', 'click', 'purchase'], stage) AS sr, list_position(['success', 'partial', 'failed'], status) AS tr FROM l WHERE stage IN ('view', 'click', 'purchase'))
SELECT user_id, stage, status FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sr DESC, tr) = 1""")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    """WN-07, AG-46 (states)."""
    v = F.col("value")
    m = R.table(spark, sf, "events").filter("event_type in ('view', 'click', 'purchase')").select("user_id", F.col("event_type").alias("stage"), F.when(v < 100, "failed").when(v < 300, "partial").otherwise("success").alias("status"), "ts")
    return A.latest_state(m, ["user_id"], "ts", ["view", "click", "purchase"], ["success", "partial", "failed"])


@query("""WITH d AS (SELECT *, epoch(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS d FROM (SELECT event_type, to_timestamp(floor(epoch(ts) / 60) * 60)::TIMESTAMP AS ts FROM events)),
n AS (SELECT event_type, d, count(*) AS n FROM d WHERE d > 0 GROUP BY ALL), s AS (SELECT event_type, d AS step_s FROM n QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, d) = 1)
SELECT event_type, step_s, count(*) AS rows, count(*) FILTER (d = 0) AS repeated, count(*) FILTER (d > 1.5 * step_s) AS gaps FROM d JOIN s USING (event_type) GROUP BY ALL""")
def cadence(spark: SparkSession, sf: str) -> DataFrame:
    """AG-65, WN-05."""
    e = R.table(spark, sf, "events").select("event_type", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 60) * 60).alias("ts"))
    return A.cadence(e, ["event_type"]).drop("first", "last")


_HOURS = "h AS (SELECT event_type AS site, date_trunc('hour', ts) AS hour, avg(value) AS y FROM events GROUP BY ALL), a AS (SELECT hour, y AS x FROM h WHERE site = 'click')"


def _hours(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    h = R.table(spark, sf, "events").groupBy(F.col("event_type").alias("site"), F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("y"))
    return h.filter("site = 'click'").select("hour", F.col("y").alias("x")), h


@query(f"""WITH {_HOURS}, s AS (SELECT site, shift_h, corr(x, y) AS r, count(*) AS hours FROM (SELECT hour + shift_h * INTERVAL 1 HOUR AS hour, x, shift_h FROM a, (SELECT unnest([-24, 0, 24])::INT AS shift_h)) m JOIN h USING (hour) GROUP BY ALL HAVING count(*) >= 48)
SELECT site, shift_h, round(r, 5) AS r, hours, row_number() OVER (PARTITION BY shift_h ORDER BY r DESC NULLS LAST, site) AS rank FROM s""")
def correlation_scan(spark: SparkSession, sf: str) -> DataFrame:
    """AG-49."""
    a, h = _hours(spark, sf)
    return rounded(S.correlation_scan(a, h, [-24, 0, 24]), r=5)


@query(f"""WITH {_HOURS}, v AS (SELECT hour, y FROM h WHERE site = 'view'), p AS (SELECT date_diff('hour', a.hour, v.hour) AS lag_h, x, y FROM a CROSS JOIN v),
l AS (SELECT lag_h, corr(x, y) AS r, count(*) AS hours FROM p GROUP BY lag_h HAVING count(*) >= 100 AND isfinite(corr(x, y)))
SELECT lag_h, hours, round(r, 6) AS r, lag_h / 24.0::DOUBLE AS lag_days, (row_number() OVER (ORDER BY r DESC, lag_h))::INT AS rank FROM l ORDER BY r DESC, lag_h LIMIT 25""")
def lag_scan(spark: SparkSession, sf: str) -> DataFrame:
    """AG-51: all lags of one hourly series behind another."""
    a, h = _hours(spark, sf)
    return rounded(lags.lag_scan(a, h.filter("site = 'view'").select("hour", "y"), 100, 25), r=6)


#: The normal tail beyond z in SQL: the sum of z^(2k+1) / (2k+1)!!, by logarithms.
_TAIL = "0.5 - sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 121), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (lgamma(2 * k + 3) - (k + 1) * ln(2) - lgamma(k + 2)))))"


@query(f"""WITH v AS (SELECT event_type AS g, value AS v, event_id % 3 = 0 AS lab FROM events), na AS (SELECT g, v, count(*) FILTER (lab) AS a, count(*) FILTER (NOT lab) AS b FROM v GROUP BY ALL),
c AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY g) AS sa, sum(b) OVER (PARTITION BY g) AS sb FROM na WINDOW w AS (PARTITION BY g ORDER BY v)),
s AS (SELECT g, max(abs(ca / sa - cb / sb)) AS ks, sum(a * ((cb - b) + b / 2.0::DOUBLE)) AS u, any_value(sa)::DOUBLE AS sa, any_value(sb)::DOUBLE AS sb, sum((a + b)::DOUBLE ** 3 - (a + b)) AS ties, sum(a * v) / any_value(sa) AS mean_a, sum(b * v) / any_value(sb) AS mean_b FROM c GROUP BY g),
d AS (SELECT *, sqrt(sa * sb / 12 * ((sa + sb + 1) - ties / ((sa + sb) * (sa + sb - 1)))) AS sd, sqrt(sa * sb / (sa + sb)) * ks AS lam FROM s),
z AS (SELECT *, (sa * sb - u - sa * sb / 2 - 0.5) / sd AS zz FROM d),
p AS (SELECT *, {_TAIL.format(z='zz')} AS u_p, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2 * k * k * lam * lam)))) END AS ks_p FROM z)
SELECT g AS event_type, sa::BIGINT AS na, sb::BIGINT AS nb, round(ks, 6) AS ks, round(u, 1) AS u, round(2 * u / (sa * sb) - 1, 6) AS cliffs_delta, round((u - sa * sb / 2) / sd, 6) AS z, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(mean_a - mean_b, 6) AS delta, round(ks_p, 6) AS ks_p, round(u_p, 6) AS u_p, u_p < 0.05 AND mean_a < mean_b AS selective FROM p""")
def rank_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """AG-56, AG-57."""
    out = S.rank_statistics(R.table(spark, sf, "events"), "event_type", "value", F.col("event_id") % 3 == 0)
    return rounded(out, ks=6, u=1, cliffs_delta=6, z=6, mean_a=6, mean_b=6, delta=6, ks_p=6, u_p=6)


@query(f"""WITH {R.TURBINES}, c AS (SELECT wind_farm, 'farm_centroid' AS sample_point_id, avg(latitude) AS lat, avg(longitude) AS lon FROM turbines GROUP BY wind_farm),
t AS (SELECT wind_farm, format('turbine_{{:04d}}', row_number() OVER (PARTITION BY wind_farm ORDER BY found_id) - 1) AS sample_point_id, latitude AS lat, longitude AS lon FROM turbines)
SELECT wind_farm, sample_point_id, round(lat, 5) AS lat, round(lon, 5) AS lon FROM (SELECT * FROM c UNION ALL SELECT * FROM t)""")
def site_points(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-13."""
    return rounded(G.site_points(R.turbines(spark, sf)).drop("sample_point_type"), lat=5, lon=5)


@query(f"""WITH {R.TURBINES}, cells AS (SELECT y, x, 54.0::DOUBLE + y * 0.15 AS lat, 6.0::DOUBLE + x * 0.3 AS lon FROM (SELECT DISTINCT event_id % 8 AS y, event_id // 8 % 8 AS x FROM events WHERE value > 5)),
p AS (SELECT found_id, latitude AS lat, longitude AS lon FROM turbines), d AS (SELECT p.found_id, c.y, c.x, {R.HAVERSINE.format(r='6371.0088::DOUBLE', a='p.', b='c.')} AS km FROM p, cells c)
SELECT found_id, round(min(km), 4) AS km, CASE WHEN min(km) <= 12 THEN 'nearest_valid_grid' ELSE 'valid_grid_too_far' END AS match_status FROM d GROUP BY found_id""")
def nearest_grid_cell(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-07."""
    y, x = F.col("event_id") % 8, F.floor(F.col("event_id") / 8) % 8
    cells = R.table(spark, sf, "events").filter("value > 5").select((54.0 + y * 0.15).alias("grid_lat"), (6.0 + x * 0.3).alias("grid_lon")).distinct()
    p = R.turbines(spark, sf).select("wind_farm", F.col("found_id").cast("string").alias("sample_point_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    out = G.nearest_cell(p, cells, 12.0, width=1.0)
    return rounded(out.select(F.col("sample_point_id").cast("long").alias("found_id"), "km", "match_status"), km=4)


@query("""SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z0-9]', '', 'g') AS key, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM part""")
def normal_names(spark: SparkSession, sf: str) -> DataFrame:
    """JN-11, FX-12."""
    return R.table(spark, sf, "part").select("p_partkey", normal_name(F.col("p_name")).alias("key"), slug(F.col("p_name")).alias("slug"))


@query(f"""WITH {R.DWELLS}, {R.MANIFEST}, ev AS (SELECT wind_farm, date_trunc('month', start_utc)::DATE AS month, count(*) AS n FROM dwells GROUP BY ALL),
ix AS (SELECT f.wind_farm, m.month, coalesce(n, 0) AS n, n IS NULL AS none, EXISTS (SELECT 1 FROM manifest q WHERE q.wind_farm = f.wind_farm AND q.month = m.month) AS listed
  FROM (SELECT DISTINCT wind_farm FROM turbines) f CROSS JOIN (SELECT DISTINCT month FROM manifest) m LEFT JOIN ev ON ev.wind_farm = f.wind_farm AND ev.month = m.month)
SELECT wind_farm, month::VARCHAR AS month, 'warning' AS severity, 'listed_without_events' AS type, '0' AS evidence FROM ix WHERE listed AND none
UNION ALL SELECT wind_farm, month::VARCHAR, 'error', 'too_many_events', n::VARCHAR FROM ix WHERE n > 20""")
def partition_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """SC-20, SC-23, AG-10."""
    m = R.manifest(spark, sf)
    ev = R.dwells(spark, sf).groupBy("wind_farm", F.trunc("start_utc", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    ix = A.data_index(R.turbines(spark, sf).select("wind_farm").distinct(), m.select("month").distinct(), {"events": ev, "manifest": m.groupBy("wind_farm", "month").agg(F.count(F.lit(1)).alias("n"))})
    rules = [
        ("warning", "listed_without_events", (F.col("manifest_status") == "present") & (F.col("events_status") == "missing"), F.col("events_count"), "check the source"),
        ("error", "too_many_events", F.col("events_count") > 20, F.col("events_count"), "check duplicates"),
    ]
    return A.anomalies(ix, rules).select("wind_farm", F.col("month").cast("string").alias("month"), "severity", "type", "evidence")


@query(f"""WITH {FUSED}, g AS (
  SELECT 'current_only_when_ready' AS "check", count(*) FILTER (NOT (current_speed IS NULL OR current_ready)) AS broken, 'fail' AS level FROM fused UNION ALL SELECT 'wave_present', count(*) FILTER (hs IS NULL), 'warn' FROM fused UNION ALL SELECT 'every_layer', count(*) FILTER (feature_class <> 'multivariate'), 'fail' FROM fused),
s AS (SELECT *, CASE WHEN broken = 0 THEN 'pass' ELSE level END AS status FROM g)
SELECT "check", broken, status, (SELECT CASE WHEN count(*) = 0 THEN '{{"recommendation":"proceed","failed":[]}}' ELSE '{{"recommendation":"stop","failed":["' || string_agg("check", '","') || '"]}}' END FROM s WHERE status = 'fail') AS summary FROM s""")
def guardrails(spark: SparkSession, sf: str) -> DataFrame:
    """SC-11, AG-71."""
    checks = [("current_only_when_ready", F.col("current_speed").isNull() | F.col("current_ready"), "fail"), ("wave_present", F.col("hs").isNotNull(), "warn"), ("every_layer", F.col("feature_class") == "multivariate", "fail")]
    return A.guardrails(_layers(spark, sf), checks)


@query("""SELECT user_id, sum(CASE WHEN ok THEN n ELSE 0 END)::BIGINT AS positive, sum(CASE WHEN NOT ok THEN n ELSE 0 END)::BIGINT AS negative, coalesce(max(n) FILTER (ok), 0) AS longest_run FROM (
  SELECT user_id, ok, run, count(*) AS n FROM (SELECT user_id, ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, ok ORDER BY ts, event_id) AS run FROM (SELECT *, value > 60 AS ok FROM events)) GROUP BY ALL) GROUP BY user_id""")
def label_audit(spark: SparkSession, sf: str) -> DataFrame:
    """AG-58 (rows by event), WN-08."""
    e = R.table(spark, sf, "events").withColumns({"label": (F.col("value") > 60).cast("int"), "at": F.struct("ts", "event_id")})
    return S.label_audit(e, "user_id", "at", "label").drop("unknown")


@query("""WITH s AS (SELECT quality AS y, (doc_id % 100) / 100.0::DOUBLE AS s FROM labels), t AS (SELECT * FROM s, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS threshold)),
c AS (SELECT threshold, count(*) FILTER (y = 1 AND s >= threshold) AS tp, count(*) FILTER (y <> 1 AND s >= threshold) AS fp, count(*) FILTER (y = 1 AND s < threshold) AS fn, count(*) FILTER (y <> 1 AND s < threshold) AS tn FROM t GROUP BY threshold)
SELECT *, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS "precision", round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM c""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """UD-05 (sweep)."""
    s = R.table(spark, sf, "labels").withColumn("s", (F.col("doc_id") % 100) / 100.0)
    return rounded(S.scores(s, "quality", "s", [0.25, 0.5, 0.75]), accuracy=6, precision=6, recall=6, f1=6)


@query()
def bootstrap_wins(spark: SparkSession, sf: str) -> DataFrame:
    """AG-52; draws come from a hash that SQL elsewhere lacks."""
    o = R.table(spark, sf, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month"), F.col("o_orderpriority").alias("winner")).agg(F.sum("o_totalprice").alias("v"))
    return S.bootstrap_wins(o.groupBy("month").agg(F.max_by("winner", F.struct("v", "winner")).alias("winner")), 5000, 42)


@query()
def grouped_validation(spark: SparkSession, sf: str) -> DataFrame:
    """UD-05: out-of-fold scores of a logistic regression, farms never in two folds."""
    from tidemark.operators.models import cross_validate

    d = R.dwells(spark, sf).withColumn("y", (F.col("dwell_tier") == "A").cast("double"))
    return S.scores(cross_validate(d, ["hs", "tp", "wind_speed", "dist_m"], "y", "wind_farm"), "y", "score", [0.2, 0.25, 0.3])
