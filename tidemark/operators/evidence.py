"""Metocean evidence of events: candidates, agreement, confidence and fusion. Missing is never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import angles, geo
from tidemark.functions.values import normal_name, reasons
from tidemark.operators.timejoin import one_to_one

#: The order of sources, agreement limits (Hs in m, Tp in s) and the weights of a candidate's quality.
SOURCE_ORDER = ["nora3", "nws", "baltic"]
STRONG, MODERATE = (0.15, 0.75), (0.35, 1.50)
W_VARIABLE, W_TEMPORAL, W_SPATIAL, W_DOMAIN = 0.40, 0.30, 0.20, 0.10
SHALLOW_FACTOR, UNBRACKETED_FACTOR = 0.85, 0.80


def source_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), c)


def nearest_point(events: DataFrame, points: DataFrame, farm: str = "wind_farm", event_id: str = "event_id") -> DataFrame:
    """events with their farm's nearest site point and how it was chosen.

    An event with a place takes the nearest point (ties to the smaller id);
    without one its farm's `farm_centroid` point, else the farm's first; a
    farm without points gives nothing. Farms join by normalized names.

    What an event takes depends on its farm and place alone, so each farm's
    places are compared once with its points' places, and the events get
    their place's answer.
    """
    p = points.select(normal_name(F.col(farm)).alias("__f"), "sample_point_id", "sample_point_type", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    kind = F.col("sample_point_type") == "farm_centroid"
    # of a farm's points at one place the smallest id counts, for events with a place; centroids count apart for those without
    p = p.groupBy("__f", "p_lat", "p_lon", F.coalesce(kind, F.lit(False)).alias("__centre")).agg(F.min_by(F.struct("sample_point_id", "sample_point_type"), "sample_point_id").alias("__p")).select("__f", "p_lat", "p_lon", "__p.*")
    km = geo.haversine(F.col("__y"), F.col("__x"), F.col("p_lat"), F.col("p_lon"), geo.EARTH_KM)
    placed = F.col("centroid_lat").isNotNull() & F.col("centroid_lon").isNotNull()
    rank = F.struct(F.when(F.col("__y").isNotNull(), km).otherwise(F.when(kind, 0.0).otherwise(1.0)), F.col("sample_point_id"))
    at = events.withColumns({"__f": normal_name(F.col(farm)), "__y": F.when(placed, F.col("centroid_lat")), "__x": F.when(placed, F.col("centroid_lon"))})
    spots = at.select("__f", "__y", "__x").filter("__f is not null").distinct()
    best = spots.join(p, "__f").groupBy("__f", "__y", "__x").agg(F.min_by(F.struct("sample_point_id", "sample_point_type", km.alias("km")), rank).alias("b"))
    best = best.select(*(F.col(c).alias(f"__of{c}") for c in ("__f", "__y", "__x")), "b")
    out = at.join(best, (F.col("__f") == F.col("__of__f")) & F.col("__y").eqNullSafe(F.col("__of__y")) & F.col("__x").eqNullSafe(F.col("__of__x")), "left")
    method = F.when(F.col("b").isNull(), "missing_farm").when(placed, "nearest_point").when(F.col("b.sample_point_type") == "farm_centroid", "farm_centroid").otherwise("first_point")
    return out.select(*events.columns, F.col("b.sample_point_id").alias("sample_point_id"), F.when(placed, F.col("b.km")).alias("point_km"), method.alias("assignment_method"))


def distance_band(m: Column) -> Column:
    return F.when(m <= 200, "high").when(m <= 500, "medium").otherwise("unassigned")


def agreement(hs_abs: Column, tp_abs: Column) -> Column:
    within = lambda l: (hs_abs <= l[0]) & (tp_abs <= l[1])  # noqa: E741,E731
    return F.when(hs_abs.isNull() | tp_abs.isNull(), "insufficient").when(within(STRONG), "strong").when(within(MODERATE), "moderate").otherwise("weak")


def pairwise(candidates: DataFrame, key: str = "dwell_id") -> DataFrame:
    """All pairs of an event's sources in source order with differences; an event has a handful of sources at most."""
    c = candidates.withColumn("rank", source_rank(F.col("source")))
    a, b = c.alias("a"), c.alias("b")
    hs, tp = F.col("a.hs") - F.col("b.hs"), F.col("a.tp") - F.col("b.tp")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.rank") < F.col("b.rank"))).select(
        F.col(f"a.{key}").alias(key), F.col("a.source").alias("source_a"), F.col("b.source").alias("source_b"), hs.alias("hs_diff"), tp.alias("tp_diff"),
        angles.difference(F.col("a.direction"), F.col("b.direction")).alias("direction_diff"), agreement(F.abs(hs), F.abs(tp)).alias("agreement")
    )


def metric_summary(a: Column, b: Column) -> list[Column]:
    """Aggregates over pairs of values: count, r2 (null if constant), rmse, mae and bias of the difference."""
    both = a.isNotNull() & b.isNotNull()
    d = F.when(both, a - b)
    return [
        F.count(d).alias("n"),
        F.pow(F.nanvl(F.corr(F.when(both, a), F.when(both, b)), F.lit(None).cast("double")), 2).alias("r2"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d)).alias("mae"),
        F.avg(d).alias("bias"),
    ]


def pair_metrics(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """metric_summary of the columns a and b for each key, with median_abs and p95_abs, exact quantiles of the absolute difference."""
    from tidemark.operators.stats import with_quantiles

    out = pairs.groupBy(*keys).agg(*metric_summary(F.col(a), F.col(b)))
    return with_quantiles(out, pairs.withColumn("__d", F.abs(F.col(a) - F.col(b))), keys, {"__d": {"median_abs": 0.5, "p95_abs": 0.95}})


def completeness(*columns: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in columns), F.lit(0)) / len(columns)


def quality_score(c: dict[str, Column]) -> Column:
    """Candidate quality from completeness, time gap (min), distance (km), domain; shallow and unbracketed reduce it."""
    ladder = lambda x, steps: _ladder(x, steps)
    temporal = ladder(c["gap_min"], [(30, 1.0), (60, 0.8), (180, 0.5)]) * F.when(c["bracketed"], 1.0).otherwise(UNBRACKETED_FACTOR)
    spatial = ladder(c["km"], [(2, 1.0), (5, 0.8), (10, 0.6), (25, 0.3)])
    score = W_VARIABLE * c["completeness"] + W_TEMPORAL * temporal + W_SPATIAL * spatial + W_DOMAIN * F.when(c["in_domain"], 1.0).otherwise(0.0)
    return score * F.when(c["shallow"], SHALLOW_FACTOR).otherwise(1.0)


def _ladder(x: Column, steps: list[tuple[float, float]]) -> Column:
    out = None
    for limit, value in steps:
        out = F.when(x <= limit, value) if out is None else out.when(x <= limit, value)
    return F.coalesce(out.otherwise(0.0), F.lit(0.0))


def event_confidence(candidates: DataFrame, key: str = "dwell_id") -> DataFrame:
    """One row for each event: the chosen source, weighted values, ranges and class A to D with a reason.

    candidates have source, hs, tp, direction, quality and shallow. A source's
    disagreement is its mean scaled difference from the others; the least
    disagreement wins, then the best quality, then source order. Weights are
    quality / (1 + disagreement); a mean whose weights are all 0 is null.
    Ranges are 0 for one source and null for none.
    """
    valid = candidates.filter((F.col("hs") >= 0) & (F.col("tp") > 0)).withColumn("rank", source_rank(F.col("source")))
    o = valid.select(F.col(key).alias("__k"), F.col("source").alias("__s"), F.col("hs").alias("__hs"), F.col("tp").alias("__tp"))
    diff = F.abs(F.col("hs") - F.col("__hs")) / STRONG[0] + F.abs(F.col("tp") - F.col("__tp")) / STRONG[1]
    scored = valid.join(o, (F.col(key) == F.col("__k")) & (F.col("source") != F.col("__s")), "left").groupBy(key, "source", "rank", "hs", "tp", "quality", "shallow").agg(F.coalesce(F.avg(diff), F.lit(0.0)).alias("disagreement"))
    w = F.col("quality") / (1 + F.col("disagreement"))
    span = lambda c: F.max(c) - F.min(c)
    got = scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_sources"),
        F.min_by("source", F.struct("disagreement", -F.col("quality"), "rank")).alias("source"),
        F.max("quality").alias("quality"),
        F.when(F.sum(w) > 0, F.sum(w * F.col("hs")) / F.sum(w)).alias("hs"),
        F.when(F.sum(w) > 0, F.sum(w * F.col("tp")) / F.sum(w)).alias("tp"),
        span("hs").alias("hs_range"),
        span("tp").alias("tp_range"),
        F.max("shallow").alias("any_shallow"),
    )
    agree = agreement(F.col("hs_range"), F.col("tp_range"))
    cls = (
        F.when(F.col("n_sources").isNull(), "D")
        .when((F.col("n_sources") >= 2) & (agree == "strong") & ~F.col("any_shallow"), "A")
        .when((F.col("n_sources") >= 2) & agree.isin("strong", "moderate"), "B")
        .otherwise("C")
    )
    why = F.when(cls == "D", "no_valid_source").when(cls == "A", "sources_agree").when(cls == "B", "sources_nearly_agree").when(F.col("n_sources") == 1, "single_source").otherwise("sources_disagree")
    events = candidates.select(key).distinct()
    return events.join(got, key, "left").withColumns({"n_sources": F.coalesce("n_sources", F.lit(0)), "confidence": cls, "confidence_reason": why})


def wind_confidence(speed: Column, sin: Column, cos: Column) -> tuple[Column, Column]:
    """Class and missing reason of wind evidence: A speed and direction, B speed, C out of range, D missing."""
    norm = F.hypot(sin, cos)
    ok = speed.between(0, 75)
    cls = F.when(speed.isNull(), "D").when(~ok, "C").when(norm.between(0.5, 1.05), "A").otherwise("B")
    why = F.when(speed.isNull(), "wind_speed_missing").when(~ok, "wind_speed_out_of_range").when(norm.isNull(), "wind_direction_missing").when(~norm.between(0.5, 1.05), "wind_direction_inconsistent")
    return cls, why


def current_confidence(speed: Column, km: Column, bracketed: Column, gap_min: Column, missing: Column) -> Column:
    """A: at most 10 km, bracketed, gap at most 60 min, missing at most 5 %; B: one of gap and missing fails; C: other values; D: none."""
    near, tight, full = km <= 10, gap_min <= 60, missing <= 0.05
    return F.when(speed.isNull(), "D").when(near & bracketed & tight & full, "A").when(near & bracketed & (tight | full), "B").otherwise("C")


def choose_source(*sources: tuple[str, Column]) -> Column:
    """Name of the first source whose value is there, else missing."""
    return F.coalesce(*(F.when(v.isNotNull(), F.lit(n)) for n, v in sources), F.lit("missing"))


def fuse(dwell: DataFrame, wave: DataFrame, wind: DataFrame, current: DataFrame, keys: list[str] = ["dwell_id"]) -> DataFrame:  # noqa: B006
    """One row for each event with the layers' values, masks, a feature class and missing reasons.

    Layers are joined one to one (a repeated key fails). Values whose class
    is not good enough become null: currents below B, wind directions below A.
    """
    out = one_to_one(one_to_one(one_to_one(dwell, wave, keys), wind, keys), current, keys)
    good_current = F.coalesce(F.col("current_confidence").isin("A", "B"), F.lit(False))
    wave_ready = F.coalesce(F.col("wave_confidence").isin("A", "B", "C"), F.lit(False)) & F.col("hs").isNotNull() & F.col("tp").isNotNull()
    wind_ready = F.coalesce(F.col("wind_confidence").isin("A", "B"), F.lit(False)) & F.col("wind_speed").isNotNull()
    current_ready = good_current & F.col("current_speed").isNotNull()
    out = out.withColumns({"wave_ready": wave_ready, "wind_ready": wind_ready, "current_ready": current_ready})
    every = F.col("wave_ready") & F.col("wind_ready") & F.col("current_ready")
    feature = F.when(every, "multivariate").when(F.col("wave_ready") & F.col("wind_ready"), "wave_wind").when(F.col("wave_ready"), "wave_only").when(F.col("wind_ready"), "wind_only").otherwise("none")
    return out.withColumns(
        {
            "current_speed": F.when(F.col("current_ready"), F.col("current_speed")),
            "wind_direction": F.when(F.col("wind_confidence") == "A", F.col("wind_direction")),
            "feature_class": feature,
            "missing_reason": reasons((~F.col("wave_ready"), "wave_not_ready"), (~F.col("wind_ready"), "wind_not_ready"), (~F.col("current_ready"), "current_not_ready")),
            "source_domain": F.concat(F.lit("wave="), F.coalesce("wave_source", F.lit("missing")), F.lit("; wind="), F.when(F.col("wind_ready"), "wind").otherwise("missing"), F.lit("; current="), F.when(F.col("current_ready"), "current").otherwise("missing")),
        }
    )


def depth_flags(depth: Column, km: Column) -> dict[str, Column]:
    """Depth flags, shallow water and coastal complexity of a candidate."""
    d = {f"depth_le_{n}m": F.coalesce(depth <= n, F.lit(False)) for n in (1, 5, 10)}
    return d | {"shallow": d["depth_le_10m"], "coastal_complexity": d["depth_le_10m"] | F.coalesce(km > 5, F.lit(False))}


def provenance_gate(candidates: DataFrame, label: str = "provenance", value: str = "current_speed") -> DataFrame:
    """candidates, failing in the task that meets a made-up value: fallback, simulated and legacy rows must carry none."""
    banned = F.lower(label).rlike("^(fallback|simulated|legacy)") & F.col(value).isNotNull()
    return candidates.withColumn(value, F.when(banned, F.raise_error(F.lit("a banned provenance carries values"))).otherwise(F.col(value)))


def operational_label(status: Column, duration_min: Column, dist_m: Column) -> Column:
    """Label of a vessel event from turbine status, minutes and metres."""
    near = (dist_m < 100) & (duration_min >= 15)
    return F.when(status.isNull(), "unknown").when(status.isin(3, 4) & near, "service").when(status.isin(1, 2, 5) & near, "downtime_visit").when((status == 0) & near, "inspection").otherwise("passing")
