"""Summaries, comparisons and gates over events, layers and rates; all are one or two groupings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.values import share
from tidemark.operators import audit, intensity
from tidemark.operators.stats import quantiles, with_quantiles
from tidemark.plans.lineage import cut

#: Metres by which a boundary's p95 must move to be material, and reach of station roles in km.
MATERIAL_M = 0.1
ROLES = [(5, "on_site"), (25, "near"), (75, "regional"), (150, "background")]


def source_quality(candidates: DataFrame, source: str = "source", columns: tuple[str, ...] = ("km", "gap_min", "samples")) -> DataFrame:
    """For each source: candidates, p50 and p95 of distance, gap and samples, and how many are unbracketed or shallow."""
    out = candidates.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("bracketed")).alias("unbracketed"), F.count_if("shallow").alias("shallow"))
    return with_quantiles(out, candidates, [source], {c: {f"{c}_p50": 0.5, f"{c}_p95": 0.95} for c in columns})


def threshold_counts(df: DataFrame, value: str, thresholds: list[float], subsets: dict[str, Column]) -> DataFrame:
    """For each named subset and threshold: rows with a value, those above it and their share, in one pass."""
    one = df.agg(*(x for s, cond in subsets.items() for x in (F.count(F.when(cond, F.col(value))).alias(f"{s}|n"), *(F.count_if(cond & (F.col(value) > t)).alias(f"{s}|{i}") for i, t in enumerate(thresholds)))))
    rows = F.array(*(F.struct(F.lit(s).alias("subset"), F.lit(float(t)).alias("threshold"), F.col(f"{s}|n").alias("rows"), F.col(f"{s}|{i}").alias("above")) for s in subsets for i, t in enumerate(thresholds)))
    return one.select(F.explode(rows).alias("x")).select("x.*", share(F.col("x.above"), F.col("x.rows")).alias("above_share"))


def boundary_delta(base: DataFrame, variant: DataFrame) -> DataFrame:
    """Two boundaries (bin, n, p95) side by side: the change of p95 and whether it is material."""
    b = variant.select("bin", F.col("n").alias("n_variant"), F.col("p95").alias("p95_variant"))
    out = base.select("bin", "n", "p95").join(b, "bin", "full").withColumn("delta", F.col("p95_variant") - F.col("p95"))
    return out.withColumn("material", F.coalesce(F.abs("delta") >= MATERIAL_M, F.lit(False)))


def delta_summary(deltas: DataFrame) -> DataFrame:
    """One row: bins with both boundaries, mean and largest absolute change, material bins, and whether any is."""
    d = F.abs(F.col("delta"))
    return deltas.agg(F.count("delta").alias("bins"), F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"), F.count_if("material").alias("material_bins"), F.coalesce(F.bool_or("material"), F.lit(False)).alias("material"))


def ramp_up_sensitivity(manifest: DataFrame, events: DataFrame, turbines: DataFrame, ramp_up: list[int], long_min: float = 120.0) -> DataFrame:
    """Farm intensities for several ramp-up lengths, one row for each farm and length."""
    out = None
    for m in ramp_up:  # a handful of parameters
        one = intensity.farm_intensity(manifest, events, turbines, long_min, m).withColumn("ramp_up_months", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def outliers(df: DataFrame, value: str, q: float = 0.9) -> DataFrame:
    """Rows whose value is above the table's own quantile."""
    limit = quantiles(df, [], value, {"limit": q})
    return df.crossJoin(F.broadcast(limit)).filter(F.col(value) > F.col("limit"))


def exposure_comparison(turbines: DataFrame, scopes: list[float]) -> DataFrame:
    """Outer-ring against inner turbines in each scope of least observed years, with a sample class.

    turbines have ring, events and years. rate is events per turbine year;
    the class is strong with at least 30 turbines and 100 years in the
    group, moderate with 10 and 30, else thin.
    """
    rows = turbines.withColumn("least_years", F.explode(F.array(*(F.lit(float(s)) for s in scopes)))).filter(F.col("years") >= F.col("least_years"))
    out = rows.groupBy("least_years", F.col("ring").alias("group")).agg(F.count(F.lit(1)).alias("turbines"), F.sum("events").alias("events"), F.sum("years").alias("years"), F.count_if(F.col("events") == 0).alias("without_events"))
    cls = F.when((F.col("turbines") >= 30) & (F.col("years") >= 100), "strong").when((F.col("turbines") >= 10) & (F.col("years") >= 30), "moderate").otherwise("thin")
    return out.withColumns({"rate": share(F.col("events"), F.col("years")), "sample_class": cls})


def matched_strata(turbines: DataFrame, stratum: list[str], group: str, a: str, b: str) -> DataFrame:
    """Strata in which both groups have turbines: rates of either and their ratio."""
    out = turbines.filter(F.col(group).isin(a, b)).groupBy(*stratum).agg(
        *(f(F.when(F.col(group) == g, F.col(c))).alias(f"{n}_{c}") for n, g in (("a", a), ("b", b)) for c, f in (("events", F.sum), ("years", F.sum), ("found_id", F.count)))
    )
    out = out.filter((F.col("a_found_id") > 0) & (F.col("b_found_id") > 0)).withColumnsRenamed({"a_found_id": "a_turbines", "b_found_id": "b_turbines"})
    rate = lambda n: share(F.col(f"{n}_events"), F.col(f"{n}_years"))
    return out.withColumns({"a_rate": rate("a"), "b_rate": rate("b")}).withColumn("ratio", share(F.col("a_rate"), F.col("b_rate")))


def pooled_ratio(strata: DataFrame) -> DataFrame:
    """One row: matched strata, and the ratio of rates pooled over them, each weighed as its years allow (Mantel-Haenszel)."""
    total = F.col("a_years") + F.col("b_years")
    up, down = F.col("a_events") * F.col("b_years") / total, F.col("b_events") * F.col("a_years") / total
    return strata.filter(total > 0).agg(F.count(F.lit(1)).alias("strata"), F.sum("a_events").alias("a_events"), F.sum("b_events").alias("b_events"), share(F.sum(up), F.sum(down)).alias("pooled_ratio"))


def without_dominant_farms(turbines: DataFrame, group: str, most: float = 0.5) -> DataFrame:
    """Turbines but for those of farms that hold more than a share `most` of their group's events."""
    farm = turbines.groupBy(group, "wind_farm").agg(F.sum("events").alias("__e"))
    whole = farm.groupBy(group).agg(F.sum("__e").alias("__all"))
    big = farm.join(whole, group).filter(F.col("__e") > most * F.col("__all")).select(group, "wind_farm")
    return turbines.join(big, [group, "wind_farm"], "left_anti")


def depth_summary(points: DataFrame, keys: list[str], depth: str = "depth") -> DataFrame:
    """Points of each key: with a depth, least, p10, median and largest depth, counts at most 1, 5 and 10 m deep, complete provenance."""
    d = F.col(depth)
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.count(depth).alias("with_depth"), F.min(depth).alias("min"), F.percentile(depth, 0.1).alias("p10"), F.percentile(depth, 0.5).alias("median"), F.max(depth).alias("max"),
        *(F.count_if(d <= m).alias(f"le_{m}m") for m in (1, 5, 10)), F.avg(F.col("complete").cast("int")).alias("provenance_share"),
    )


def event_totals(events: DataFrame, registry: DataFrame) -> DataFrame:
    """(metric, value) rows: events, vessels, farms, events of each class, and vessels of the registry without events."""
    classes = ["Transfer", "Extended", "Stationary/Construction"]
    one = events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("mmsi").alias("vessels"), F.count_distinct("wind_farm").alias("farms"), *(F.count_if(F.col("event_class") == c).alias(f"class_{c}") for c in classes))
    idle = registry.select("mmsi").distinct().join(events.select("mmsi").distinct(), "mmsi", "left_anti").agg(F.count(F.lit(1)).alias("registry_without_events"))
    return audit.metrics_long(one.crossJoin(F.broadcast(idle)))


def atlas(events: DataFrame, tiers: list[str]) -> DataFrame:
    """Each farm's dwells by tier (a column each), median duration, and the number without duplicates: unflagged ones and distinct groups."""
    out = events.groupBy("wind_farm").agg(
        *(F.count_if(F.col("dwell_tier") == t).alias(f"tier_{t}") for t in tiers), F.percentile("duration_min", 0.5).alias("median_min"),
        (F.count_if(F.col("duplicate_group_id").isNull()) + F.count_distinct("duplicate_group_id")).alias("deduplicated"),
    )
    return out


def comparator_delta(events: DataFrame, comparator: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the median of events less that of a comparator table."""
    every = events.select(key).distinct()
    return with_quantiles(with_quantiles(every, events, [key], {value: {"median": 0.5}}), comparator, [key], {value: {"comparator": 0.5}}).withColumn("delta", F.col("median") - F.col("comparator"))


def monthly_ranks(pairs: DataFrame, least: int = 24) -> DataFrame:
    """Correlation of x and y of each site and month of (site, hour, x, y), and its rank in the month."""
    out = pairs.groupBy("site", F.date_trunc("month", "hour").alias("month")).agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("hours")).filter(F.col("hours") >= least)
    out = out.withColumn("r", F.nanvl("r", F.lit(None).cast("double")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(F.desc_nulls_last("r"), "site")))


def sector_correlations(pairs: DataFrame, sector: Column, least: int = 24) -> DataFrame:
    """Correlation in each wind sector, and the sector's share of the site's hours (its wind rose)."""
    n = pairs.groupBy("site", sector.alias("sector")).agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("hours"))
    whole = F.sum("hours").over(Window.partitionBy("site"))
    return n.withColumn("rose_share", F.col("hours") / whole).withColumn("r", F.when(F.col("hours") >= least, F.nanvl("r", F.lit(None).cast("double"))))


def curve_fit(binned: DataFrame, curve: DataFrame, asset: str, least_bins: int = 12) -> DataFrame:
    """Fit of each asset's binned curve (wind, power) to a curve given at the same bins: MAE, RMSE, R2, rated speed and plateau.

    Rated speed is the least wind at 98 % of the asset's largest power; the
    plateau is the mean power from there on.
    """
    top = binned.groupBy(asset).agg(F.max("power").alias("top"))
    met = binned.join(curve.select("wind", F.col("power").alias("given")), "wind").join(top, asset)
    e = F.col("power") - F.col("given")
    high = F.col("power") >= 0.98 * F.col("top")
    first = met.groupBy(asset).agg(F.min(F.when(high, F.col("wind"))).alias("rated"))
    out = met.join(first, asset).groupBy(asset, "rated").agg(
        F.count(F.lit(1)).alias("bins"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop("power") * F.count("power"))).alias("r2"), F.avg(F.when(F.col("wind") >= F.col("rated"), F.col("power"))).alias("plateau"),
    )
    return out.filter(F.col("bins") >= least_bins)


def viability(audit_rows: DataFrame, least_events: int = 5, least_positive: int = 100, most_top3: float = 0.6, least_share: float = 0.01, most_unknown: float = 0.5) -> DataFrame:
    """Five gates (gate, value, passed) over a label audit of events (positive, negative, unknown).

    Events with a positive row, positive rows, the share of positives in the
    top three events, the share of positives among known rows, and the share
    of unknown rows.
    """
    ranked = audit_rows.orderBy(F.desc_nulls_last("positive")).limit(3).agg(F.sum("positive").alias("top3"))
    one = audit_rows.agg(F.count_if(F.col("positive") > 0).alias("events"), F.sum("positive").alias("p"), F.sum("negative").alias("n"), F.sum("unknown").alias("u")).crossJoin(ranked)
    p, n, u = F.col("p"), F.col("n"), F.col("u")
    gates = [
        ("positive_events", F.col("events").cast("double"), lambda v: v >= least_events), ("positive_rows", p.cast("double"), lambda v: v >= least_positive),
        ("top3_share", share(F.col("top3"), p), lambda v: v <= most_top3), ("positive_share", share(p, p + n), lambda v: v >= least_share), ("unknown_share", share(u, p + n + u), lambda v: v <= most_unknown),
    ]
    rows = F.array(*(F.struct(F.lit(g).alias("gate"), v.alias("value"), F.coalesce(ok(v), F.lit(False)).alias("passed")) for g, v, ok in gates))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def hourly_change(series: DataFrame, keys: list[str], speed: str, direction: str, most_speed: float = 0.5, most_turn: float = 45.0) -> DataFrame:
    """For each series the median and p95 change from hour to hour of speed and direction, and whether it is variable (p95 beyond a limit)."""
    from tidemark.functions.angles import difference

    w = Window.partitionBy(*keys).orderBy("hour")
    next_ = F.unix_seconds("hour") - F.unix_seconds(F.lag("hour").over(w)) == 3600
    d = series.withColumns({"ds": F.when(next_, F.abs(F.col(speed) - F.lag(speed).over(w))), "dd": F.when(next_, difference(F.col(direction), F.lag(direction).over(w)))})
    d = cut(d.select(*keys, "ds", "dd"))
    out = with_quantiles(d.groupBy(*keys).agg(F.count("ds").alias("steps")), d, keys, {c: {f"{n}_p50": 0.5, f"{n}_p95": 0.95} for c, n in (("ds", "speed"), ("dd", "turn"))})
    return out.withColumn("variable", F.coalesce((F.col("speed_p95") > most_speed) | (F.col("turn_p95") > most_turn), F.lit(False)))


def suitability(bracketed: DataFrame, native_min: float) -> DataFrame:
    """One row on a source at the scale of events: shares in the window, bracketed and with a gap within the native step, and a verdict.

    bracketed is the result of timejoin.bracketed. suitable: 80 % are in the
    window or bracketed within the step; partly: half are.
    """
    tight = F.col("bracketed") & F.coalesce(F.col("gap_min") <= native_min, F.lit(False))
    ok = F.coalesce((F.col("n_inside") > 0) | tight, F.lit(False))
    out = bracketed.agg(F.count(F.lit(1)).alias("events"), F.avg((F.col("n_inside") > 0).cast("int")).alias("in_window"), F.avg(F.col("bracketed").cast("int")).alias("bracketed"), F.avg(tight.cast("int")).alias("tight"), F.avg(ok.cast("int")).alias("usable"))
    return out.withColumn("verdict", F.when(F.col("usable") >= 0.8, "suitable").when(F.col("usable") >= 0.5, "partly").otherwise("unsuitable"))


def answerability(completeness: DataFrame, questions: dict[str, tuple[list[str], float]]) -> DataFrame:
    """For each question its needed columns, the largest null share among them and the answer: yes, limited (under half null) or no.

    completeness has column and null_share; a column that it lacks counts as null.
    """
    spark = completeness.sparkSession
    rows = [(q, c, float(most)) for q, (columns, most) in questions.items() for c in columns]
    need = spark.createDataFrame(rows, "question string, column string, most double")
    met = need.join(completeness.select("column", "null_share"), "column", "left").groupBy("question", "most").agg(F.count(F.lit(1)).alias("columns"), F.max(F.coalesce("null_share", F.lit(1.0))).alias("worst"))
    return met.select("question", "columns", "worst", F.when(F.col("worst") <= F.col("most"), "yes").when(F.col("worst") < 0.5, "limited").otherwise("no").alias("answerable"))


def grid_coverage(points: DataFrame, cells: DataFrame) -> DataFrame:
    """For each farm: points inside the field's box, points with a valid cell near, and the share covered.

    points is the result of gridded.nearest_cell; cells the valid cells, whose
    box is one scalar aggregate.
    """
    box = cells.agg(F.min("grid_lat").alias("a"), F.max("grid_lat").alias("b"), F.min("grid_lon").alias("c"), F.max("grid_lon").alias("d"))
    inside = F.col("lat").between(F.col("a"), F.col("b")) & F.col("lon").between(F.col("c"), F.col("d"))
    near = F.col("match_status") == "nearest_valid_grid"
    out = points.crossJoin(F.broadcast(box)).groupBy("wind_farm").agg(F.count(F.lit(1)).alias("points"), F.count_if(inside).alias("inside"), F.count_if(near).alias("near"), F.count_if(inside & near).alias("covered"))
    return out.withColumn("covered_share", F.col("covered") / F.col("points"))


def layer_validation(base: DataFrame, layer: DataFrame, key: str, cls: str, gap: str, km: str) -> DataFrame:
    """(metric, value) rows on a layer against its base: rows kept, repeated and lost keys, rows of each class, quantiles of gap and distance."""
    n = layer.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    keys = base.select(key).distinct().join(n, key, "full")
    lost = keys.agg(F.count_if(F.col("__n").isNull()).alias("lost_keys"), F.count_if(F.col("__n") > 1).alias("repeated_keys"))
    rows = base.agg(F.count(F.lit(1)).alias("base_rows"))
    one = layer.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(cls) == c).alias(f"class_{c}") for c in "ABCD"))
    one = with_quantiles(one, layer, [], {c: {f"{c}_p50": 0.5, f"{c}_p95": 0.95} for c in (gap, km)})
    return audit.metrics_long(one.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(lost)))


def version_comparison(v1: DataFrame, v0: DataFrame, key: str, supported: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """Events of an older version in the newer one's classes: supported (its source is the same and the class good), questionable, or missing."""
    met = v0.select(key, F.col("source").alias("source_v0")).join(v1.select(key, F.col("source").alias("source_v1"), "confidence"), key, "left")
    state = F.when(F.col("confidence").isNull() | (F.col("confidence") == "D"), "missing").when((F.col("source_v0") == F.col("source_v1")) & F.col("confidence").isin(*supported), "supported").otherwise("questionable")
    return met.groupBy("source_v0", state.alias("state")).agg(F.count(F.lit(1)).alias("events"))


def claim_checks(df: DataFrame, claims: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """For each claim (scope, support, least share): rows in scope, supporting rows, their share, and whether the claim may be made."""
    one = df.agg(*(x for n, (scope, support, _) in claims.items() for x in (F.count_if(scope).alias(f"{n}|a"), F.count_if(scope & support).alias(f"{n}|b"))))
    rows = F.array(*(F.struct(F.lit(n).alias("claim"), F.col(f"{n}|a").alias("rows"), F.col(f"{n}|b").alias("support"), F.lit(float(least)).alias("least")) for n, (_, _, least) in claims.items()))
    part = share(F.col("support"), F.col("rows"))
    out = one.select(F.explode(rows).alias("x")).select("x.*").withColumn("support_share", part)
    return out.withColumn("status", F.when(F.col("support_share") >= F.col("least"), "allowed").when(F.col("rows") > 0, "limited").otherwise("not_allowed"))


def backbone_gate(series: DataFrame, keys: list[str], bounds: dict[str, tuple[float, float]], minutes: int = 10, most_days: float = 32.0) -> DataFrame:
    """For each series: nulls, values out of bounds, times off the grid, missing and repeated rows, a span too long, and whether all is well."""
    nulls = sum((F.col(c).isNull().cast("int") for c in bounds), F.lit(0))
    out_ = sum((F.coalesce(~F.col(c).between(a, b), F.lit(False)).cast("int") for c, (a, b) in bounds.items()), F.lit(0))
    t = F.unix_seconds("ts")
    got = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("ts").alias("times"), F.sum(nulls).alias("nulls"), F.sum(out_).alias("out_of_bounds"), F.count_if(t % (minutes * 60) != 0).alias("off_grid"),
        (F.floor((F.max(t) - F.min(t)) / (minutes * 60)) + 1).alias("expected"), ((F.max(t) - F.min(t)) / 86400).alias("days"),
    )
    ok = (F.col("nulls") == 0) & (F.col("out_of_bounds") == 0) & (F.col("off_grid") == 0) & (F.col("rows") == F.col("expected")) & (F.col("times") == F.col("rows")) & (F.col("days") <= most_days)
    return got.withColumn("passed", ok)


def length_class(length: Column) -> Column:
    """Class of a vessel's length in metres."""
    return F.when(length.isNull() | (length <= 0), "unknown").when(length < 30, "small").when(length < 80, "medium").when(length < 150, "large").otherwise("very_large")


def type_alias(kind: Column, aliases: dict[str, list[str]]) -> Column:
    """The first alias one of whose words a ship type holds, in any case; other, or unknown for none."""
    low = F.lower(F.trim(kind))
    out = F.when(low.isNull() | (low == ""), "unknown")
    for name, parts in aliases.items():
        out = out.when(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(low, p)), name)
    return out.otherwise("other")


def top_vessels(events: DataFrame, top: int = 10) -> DataFrame:
    """The vessels with most minutes of dwell: mmsi, minutes, events, name and ship_type (the smallest that isn't empty), length; ties to the smaller mmsi."""
    said = lambda c: F.min(F.when(F.trim(c) != "", F.col(c))).alias(c)
    of = events.groupBy("mmsi").agg(F.sum("duration_min").alias("minutes"), F.count(F.lit(1)).alias("events"), said("name"), said("ship_type"), F.max("length").alias("length"))
    return of.orderBy(F.desc_nulls_last("minutes"), "mmsi").limit(top)


def disagreement_examples(confidence: DataFrame, key: str, k: int = 25) -> DataFrame:
    """The k events whose sources differ most in wave height, then in period, nulls last; ties to the smaller key."""
    return confidence.orderBy(F.desc_nulls_last("hs_range"), F.desc_nulls_last("tp_range"), key).limit(k)


def event_bundle(events: DataFrame, registry: DataFrame, suspects: Callable[[DataFrame], DataFrame], jumps: DataFrame, top: int = 10) -> DataFrame:
    """An event audit as (section, item, value) rows.

    Sections: counts, classes, farms (events each), top_vessels (the `top`
    vessels by minutes of dwell), duration quantiles, suspects and jumps by reason.
    """
    row = lambda section, item, value: [F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("double").alias("value")]
    counts = audit.metrics_long(events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("mmsi").alias("vessels"), F.sum("duration_min").alias("minutes")))
    spread = audit.distribution(events, ["duration_min"]).select(F.expr("stack(5, 'min', min, 'p25', p25, 'median', median, 'p75', p75, 'max', max) as (item, value)"))
    vessels = events.groupBy("mmsi").agg(F.sum("duration_min").alias("n")).orderBy(F.desc("n"), "mmsi").limit(top)
    of = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    parts = [
        counts.select(*row("counts", F.col("metric"), F.col("value"))), of(events, "event_class").select(*row("classes", F.col("event_class"), F.col("n"))), of(events, "wind_farm").select(*row("farms", F.col("wind_farm"), F.col("n"))),
        vessels.select(*row("top_vessels", F.col("mmsi"), F.col("n"))), spread.select(*row("duration_min", F.col("item"), F.col("value"))),
        of(suspects(registry), "suspect_reason").select(*row("suspects", F.col("suspect_reason"), F.col("n"))), of(jumps, "reason").select(*row("jumps", F.col("reason"), F.col("n"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def roc_pr_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """One row: ROC-AUC (ties count half) and average precision, from scores counted once each.

    Scores are range-partitioned and only each partition's totals are summed
    outside, so no task sorts all rows.
    """
    from tidemark.operators.stats import running_counts

    y = F.col(label) == 1
    n = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy((-F.col(score)).alias("s")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q"))
    r = running_counts(n, [], "s", ["p", "q"])
    total = n.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    m = r.crossJoin(F.broadcast(total))
    below = F.col("nq") - F.col("run_q")  # negatives with a smaller score
    auc = share(F.sum(F.col("p") * (below + F.col("q") / 2)), F.first("np") * F.first("nq"))
    ap = share(F.sum(F.col("p") * F.col("run_p") / (F.col("run_p") + F.col("run_q"))), F.first("np"))
    return m.agg(F.first("np").alias("positive"), F.first("nq").alias("negative"), auc.alias("roc_auc"), ap.alias("average_precision"))
