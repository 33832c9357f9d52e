"""Observation-aware intervention rates of farms and turbines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import share

#: Statuses of an observed month and of a missing one.
OBSERVED = ["success", "success_no_ais_in_bbox"]
MISSING = ["skipped_missing_source", "failed"]
PHASES = ["pre_operational", "commissioning_ramp_up", "steady_operational", "unknown_phase"]


def lifecycle_phase(month: Column, first: Column, steady: Column) -> Column:
    """Phase of a month: before commissioning, ramp-up, steady, or unknown without dates."""
    return F.when(first.isNull() | steady.isNull() | month.isNull(), PHASES[3]).when(month < first, PHASES[0]).when(month < steady, PHASES[1]).otherwise(PHASES[2])


def operational_metadata(turbines: DataFrame, ramp_up_months: int = 6) -> DataFrame:
    """wind_farm, turbine_count, first and last commissioning month, steady start."""
    m = F.trunc("commissioning", "MM")
    out = turbines.groupBy("wind_farm").agg(F.count(F.lit(1)).alias("turbine_count"), F.min(m).alias("first_month"), F.max(m).alias("last_month"))
    return out.withColumn("steady_start", F.add_months("last_month", ramp_up_months))


def manifest_months(manifest: DataFrame) -> DataFrame:
    """One row for each farm and month: the set of statuses, and whether it is observed, missing or other. An observed zero is observed."""
    s = manifest.groupBy("wind_farm", "month").agg(F.collect_set("status").alias("statuses"))
    has = lambda names: F.arrays_overlap("statuses", F.array(*map(F.lit, names)))
    state = F.when(has(OBSERVED), "observed").when(has(MISSING), "missing").otherwise("other")
    return s.withColumn("state", state)


def denominator(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """Farm months by state and phase, observed years, coverage share, first and last observed month."""
    m = manifest_months(manifest).join(metadata, "wind_farm", "left")
    m = m.withColumn("phase", lifecycle_phase(F.col("month"), F.col("first_month"), F.col("steady_start")))
    seen = F.col("state") == "observed"
    out = m.groupBy("wind_farm").agg(
        F.count(F.lit(1)).alias("months"),
        F.count_if(seen).alias("observed_months"),
        F.count_if(F.col("state") == "missing").alias("missing_months"),
        F.count_if(F.col("state") == "other").alias("other_months"),
        *(F.count_if(seen & (F.col("phase") == p)).alias(f"observed_{p}") for p in PHASES),
        F.min(F.when(seen, F.col("month"))).alias("first_observed"),
        F.max(F.when(seen, F.col("month"))).alias("last_observed"),
    )
    return out.withColumns({"observed_years": F.col("observed_months") / 12.0, "coverage_share": share(F.col("observed_months"), F.col("months"))})


def duplicate_weight(events: DataFrame, group: str = "duplicate_group_id", farm: str = "wind_farm") -> DataFrame:
    """events with weight = 1 / distinct farms of their duplicate group; 1 without a group."""
    n = events.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(farm).alias("__n"))
    # most events may have no group, and a join would put those into one task
    spread = F.when(F.col(group).isNull(), F.pmod(F.xxhash64(*events.columns), F.lit(4096))).otherwise(0).cast("int")
    n = n.withColumn("__spread", F.least("__n", F.lit(0)).cast("int"))  # 0; as a constant it would leave the join's keys
    return events.withColumn("__spread", spread).join(n, [group, "__spread"], "left").withColumn("weight", F.coalesce(1.0 / F.col("__n"), F.lit(1.0))).select(*events.columns, "weight")


def numerators(events: DataFrame, metadata: DataFrame, long_min: float = 120.0) -> DataFrame:
    """Farm counts of tier A and B dwells, long ones, vessels, phases and duplicate-adjusted sums; pre-operational rows apart."""
    e = events.join(F.broadcast(metadata), "wind_farm", "left")  # a row for each farm; events would gather in the farms' tasks
    e = e.withColumn("phase", lifecycle_phase(F.trunc("start_utc", "MM"), F.col("first_month"), F.col("steady_start")))
    counted = e.filter(F.col("phase") != "pre_operational")
    w = duplicate_weight(counted)
    a = F.col("dwell_tier") == "A"
    out = w.groupBy("wind_farm").agg(
        F.count_if(a).alias("tier_a"), F.count_if(F.col("dwell_tier") == "B").alias("tier_b"), F.count_if(a & (F.col("duration_min") >= long_min)).alias("long_dwells"),
        F.count_distinct(F.when(a, F.col("mmsi"))).alias("vessels"), F.sum(F.when(a, F.col("weight")).otherwise(0.0)).alias("tier_a_weighted"),
        *(F.count_if(a & (F.col("phase") == p)).alias(f"tier_a_{p}") for p in PHASES[1:]),
    )
    before = e.filter(F.col("phase") == "pre_operational").groupBy("wind_farm").agg(F.count(F.lit(1)).alias("pre_operational"))
    return out.join(before, "wind_farm", "full").na.fill(0)


def farm_intensity(manifest: DataFrame, events: DataFrame, turbines: DataFrame, long_min: float = 120.0, ramp_up_months: int = 6) -> DataFrame:
    """Rates per observed year and turbine for every farm of the manifest or the events, with a confidence class and a use."""
    meta = operational_metadata(turbines, ramp_up_months)
    out = denominator(manifest, meta).join(numerators(events, meta, long_min), "wind_farm", "full").join(meta.select("wind_farm", "turbine_count"), "wind_farm", "left")
    counts = [c for c, t in out.dtypes if c != "turbine_count" and (t in ("bigint", "int") or c in ("tier_a_weighted", "observed_years"))]
    out = out.na.fill(0, counts)
    rate = share(F.col("tier_a"), F.col("observed_years"))
    years, cover = F.col("observed_years"), F.coalesce("coverage_share", F.lit(0.0))
    cls = F.when((years >= 5) & (cover >= 0.8), "high").when((years >= 1) & (cover >= 0.5), "medium").when(years > 0, "low").otherwise("none")
    use = F.when(cls == "high", "parameter").when(cls == "medium", "sensitivity").when(cls == "low", "context_only").otherwise("exclude")
    return out.withColumns(
        {
            "tier_a_per_year": rate,
            "tier_a_per_turbine_year": share(rate, F.col("turbine_count")),
            "weighted_per_year": share(F.col("tier_a_weighted"), years),
            "confidence": cls,
            "recommended_use": use,
        }
    )


def turbine_denominator(manifest: DataFrame, turbines: DataFrame, ramp_up_months: int = 6) -> DataFrame:
    """Months of each turbine's steady window by state, the observed share and a coverage class."""
    m = manifest_months(manifest).join(turbines.select("wind_farm", "found_id", F.add_months(F.trunc("commissioning", "MM"), ramp_up_months).alias("steady_start")), "wind_farm")
    m = m.filter(F.col("month") >= F.col("steady_start"))
    out = m.groupBy("wind_farm", "found_id").agg(F.count(F.lit(1)).alias("months"), *(F.count_if(F.col("state") == s).alias(f"{s}_months") for s in ("observed", "missing", "other")))
    part = share(F.col("observed_months"), F.col("months"))
    cls = F.when((part >= 0.8) & (F.col("observed_months") >= 60), "high").when((part >= 0.5) & (F.col("observed_months") >= 12), "medium").otherwise("low")
    return out.withColumns({"observed_share": part, "coverage_class": cls})


def repeat_visits(events: DataFrame, days: int = 30) -> DataFrame:
    """events with repeat_visit: another event at the turbine at most so many days before."""
    w = Window.partitionBy("found_id").orderBy("start_utc", "dwell_id")
    gap = (F.unix_micros("start_utc") - F.unix_micros(F.lag("start_utc").over(w))) / 86400e6
    return events.withColumn("repeat_visit", F.coalesce(gap <= days, F.lit(False)))


def turbine_intensity(events: DataFrame, denominators: DataFrame) -> DataFrame:
    """Turbine rates with assignments of high confidence (primary) and of high and medium (sensitivity)."""
    w = repeat_visits(duplicate_weight(events))
    scopes = {"primary": F.col("assignment") == "high", "sensitivity": F.col("assignment").isin("high", "medium")}
    aggs = [x for n, s in scopes.items() for x in (F.count_if(s).alias(f"{n}_events"), F.sum(F.when(s, F.col("weight")).otherwise(0.0)).alias(f"{n}_weight"), F.count_distinct(F.when(s, F.col("mmsi"))).alias(f"{n}_vessels"), F.count_if(s & F.col("repeat_visit")).alias(f"{n}_repeats"))]
    out = denominators.join(w.groupBy("found_id").agg(*aggs), "found_id", "left")
    out = out.na.fill(0, [c for c in out.columns if c.split("_")[0] in scopes])
    return out.withColumn("primary_per_year", share(F.col("primary_events"), F.col("observed_months") / 12.0))


def distance_quantile(turbines: DataFrame) -> DataFrame:
    """Turbines with the distance from their farm's centroid, its quantile in the farm and whether they are in the outer ring.

    The quantile is (average rank - 1) / (n - 1), 0.5 for fewer than 4
    turbines; the outer quarter of farms of at least 4 is the outer ring.
    """
    from tidemark.functions import geo

    farm = Window.partitionBy("wind_farm")
    t = turbines.withColumns({"__lat": F.avg("latitude").over(farm), "__lon": F.avg("longitude").over(farm), "n": F.count(F.lit(1)).over(farm)})
    t = t.withColumn("centroid_km", F.round(geo.haversine(F.col("latitude"), F.col("longitude"), F.col("__lat"), F.col("__lon"), geo.EARTH_KM), 6)).drop("__lat", "__lon")
    ties = F.count(F.lit(1)).over(Window.partitionBy("wind_farm", "centroid_km"))
    rank = F.rank().over(farm.orderBy("centroid_km")) + (ties - 1) / 2
    q = F.when(F.col("n") < 4, 0.5).otherwise((rank - 1) / (F.col("n") - 1))
    return t.withColumn("distance_quantile", q).withColumn("ring", F.when((F.col("n") >= 4) & (F.col("distance_quantile") >= 0.75), "outer").otherwise("inner"))


def sea_basin(country: Column, lon: Column) -> Column:
    """Basin of a country, for some by longitude."""
    c = F.lower(F.trim(country))
    return (
        F.when(c.isin("netherlands", "belgium", "united kingdom", "norway", "france"), "north_sea")
        .when(c.isin("sweden", "finland", "poland", "estonia", "latvia", "lithuania"), "baltic_sea")
        .when(c.isin("germany", "denmark") & lon.isNotNull(), F.when(lon < 9.5, "north_sea").otherwise("baltic_sea"))
        .otherwise("unknown")
    )


def band(c: Column, edges: list[float], unit: str) -> Column:
    """Text band of a number: below the first edge, between edges, from the last on; unknown for null."""
    out = F.when(c.isNull(), "unknown").when(c < edges[0], f"<{edges[0]:g}{unit}")
    for a, b in zip(edges, edges[1:]):
        out = out.when(c < b, f"{a:g}-{b:g}{unit}")
    return out.otherwise(f">={edges[-1]:g}{unit}")


def characteristic_rates(turbines: DataFrame, characteristics: list[str], thresholds: list[float]) -> DataFrame:
    """Rates of every value of every characteristic at every least exposure, in one groupBy over unpivoted rows.

    turbines have events, years, wind_farm. Also the share without events and
    of the dominant farm, and a flag for reading them.
    """
    long = turbines.select("found_id", "wind_farm", "events", "years", F.explode(F.array(*(F.struct(F.lit(c).alias("characteristic"), F.col(c).cast("string").alias("value")) for c in characteristics))).alias("x")).select("*", "x.*").drop("x")
    rows = long.withColumn("least_years", F.explode(F.array(*map(F.lit, thresholds)))).filter(F.col("years") >= F.col("least_years"))
    key = ["characteristic", "value", "least_years"]
    by_farm = rows.groupBy(*key, "wind_farm").agg(F.count(F.lit(1)).alias("n"), F.sum("events").alias("events"), F.sum("years").alias("years"), F.count_if(F.col("events") == 0).alias("zero"))
    out = by_farm.groupBy(*key).agg(F.sum("n").alias("turbines"), F.sum("events").alias("events"), F.sum("years").alias("years"), F.sum("zero").alias("zero"), F.max_by("wind_farm", F.struct("n", "wind_farm")).alias("top_farm"), F.max("n").alias("top_n"))
    rate = share(F.col("events"), F.col("years"))
    flag = F.when(F.col("turbines") < 5, "few_turbines").when(F.col("top_n") / F.col("turbines") > 0.5, "one_farm_dominates").otherwise("ok")
    return out.select(*key, "turbines", "events", rate.alias("rate"), share(F.col("zero"), F.col("turbines")).alias("zero_share"), "top_farm", share(F.col("top_n"), F.col("turbines")).alias("top_share"), flag.alias("interpretation"))
