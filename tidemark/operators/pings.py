"""Vessel position pings: cleaning, matching to turbines, dwell events, vessel registry.

Pings have mmsi, ts, lat, lon, sog and optionally name, ship_type, length,
draught; turbines have found_id, wind_farm, latitude, longitude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.values import number, timestamp
from tidemark.operators.scan import segments
from tidemark.plans.lineage import cut

#: Names that say nothing, and the limits of event classes in minutes.
UNKNOWN = ["", "unknown", "undefined", "unknown value", "nan"]
TRANSFER_BELOW, EXTENDED_TO = 720, 1440


def typed(raw: DataFrame) -> DataFrame:
    """Text columns of a ping file as numbers and UTC times; what can't be read is null."""
    return raw.select(
        F.col("mmsi").try_cast("long").alias("mmsi"),
        timestamp(F.col("ts")).alias("ts"),
        *(number(F.col(c)).alias(c) for c in ("lat", "lon", "sog")),
        *(c for c in ("name", "ship_type") if c in raw.columns),
        *(number(F.col(c)).alias(c) for c in ("length", "draught") if c in raw.columns),
    )


def reject_reason(box: tuple[float, float, float, float] | None = None, max_sog: float | None = None) -> Column:
    """Why a ping is left out, the first rule that fails, or null. box: min lat, max lat, min lon, max lon, ends included."""
    lat, lon = F.col("lat"), F.col("lon")
    why = F.when(lat.isNull() | lon.isNull() | ~lat.between(-90, 90) | ~lon.between(-180, 180), "bad_lat_lon")
    if box:
        why = why.when(~(lat.between(box[0], box[1]) & lon.between(box[2], box[3])), "outside_region")
    if max_sog is not None:
        why = why.when(F.col("sog").isNull(), "bad_sog").when(F.col("sog") > max_sog, "above_max_sog")
    return why


def filter_pings(pings: DataFrame, box: tuple[float, float, float, float] | None = None, max_sog: float | None = None) -> DataFrame:
    return pings.filter(reject_reason(box, max_sog).isNull())


def reject_counts(pings: DataFrame, *by: str, box: tuple[float, float, float, float] | None = None, max_sog: float | None = None) -> DataFrame:
    """Rows seen, kept and left out for each reason, and the share kept, in one pass."""
    n = lambda r: F.count_if(F.col("__why") == r).alias(r)
    out = pings.withColumn("__why", reject_reason(box, max_sog)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("__why").isNull()).alias("kept"), n("bad_lat_lon"), n("bad_sog"), n("outside_region"), n("above_max_sog")
    )
    return out.withColumn("retention_pct", F.round(F.when(F.col("seen") > 0, F.col("kept") * 100.0 / F.col("seen")), 4))


def slice_rows(df: DataFrame, farms: list[str] | None = None, start: str | None = None, end: str | None = None, ts: str = "start_utc") -> DataFrame:
    """Rows of some farms from start on and before end; what is None does not filter."""
    tests = [F.col("wind_farm").isin(farms) if farms is not None else None, F.col(ts) >= F.lit(start).cast("timestamp") if start else None, F.col(ts) < F.lit(end).cast("timestamp") if end else None]
    for t in tests:
        df = df if t is None else df.filter(t)
    return df


def farm_boxes(turbines: DataFrame, buffer_nm: float) -> DataFrame:
    """wind_farm and its box, widened by nautical miles; longitudes by more towards the poles."""
    box = turbines.groupBy("wind_farm").agg(*(f(c).alias(n) for c, a in (("latitude", "lat"), ("longitude", "lon")) for f, n in ((F.min, f"min_{a}"), (F.max, f"max_{a}"))))
    dlat = F.lit(buffer_nm / 60.0)
    dlon = F.lit(buffer_nm) / (60.0 * F.greatest(F.cos(F.radians((F.col("min_lat") + F.col("max_lat")) / 2)), F.lit(0.01)))
    return box.select("wind_farm", (F.col("min_lat") - dlat).alias("min_lat"), (F.col("max_lat") + dlat).alias("max_lat"), (F.col("min_lon") - dlon).alias("min_lon"), (F.col("max_lon") + dlon).alias("max_lon"))


def in_any_box(pings: DataFrame, boxes: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pings inside any box, once each: a semi join on the grid cells that a box covers, then the box itself."""
    covered = boxes.select("*", F.explode(F.sequence(geo.cell(F.col("min_lat"), cell), geo.cell(F.col("max_lat"), cell))).alias("cy")).select(
        "*", F.explode(F.sequence(geo.cell(F.col("min_lon"), cell), geo.cell(F.col("max_lon"), cell))).alias("cx")
    )
    b = covered.select(*(F.col(c).alias(f"__{c}") for c in ("cy", "cx", "min_lat", "max_lat", "min_lon", "max_lon")))
    near = (geo.cell(F.col("lat"), cell) == F.col("__cy")) & (geo.cell(F.col("lon"), cell) == F.col("__cx"))
    inside = F.col("lat").between(F.col("__min_lat"), F.col("__max_lat")) & F.col("lon").between(F.col("__min_lon"), F.col("__max_lon"))
    return pings.join(b, near & inside, "left_semi")


def stationary(pings: DataFrame, below: float = 0.5) -> DataFrame:
    return pings.filter((F.col("sog") < below) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def track_speed(pings: DataFrame) -> DataFrame:
    """Pings with implied_knots from the vessel's previous place; null at its first ping and without time between."""
    w = Window.partitionBy("mmsi").orderBy("ts", "lat", "lon")
    nm = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"), geo.EARTH_NM)
    hours = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 3600e6
    return pings.withColumn("implied_knots", F.when(hours > 0, nm / hours))


def clean_track(pings: DataFrame, max_knots: float = 60.0) -> DataFrame:
    """track_speed without what is faster than max_knots. Our own definition."""
    return track_speed(pings).filter(F.col("implied_knots").isNull() | (F.col("implied_knots") <= max_knots))


def cleaning_report(pings: DataFrame, max_knots: float = 60.0) -> DataFrame:
    """For each vessel: pings, those removed by clean_track, their share, and the largest implied speed kept and removed."""
    k = F.col("implied_knots")
    fast = F.coalesce(k > max_knots, F.lit(False))
    out = track_speed(pings).groupBy("mmsi").agg(F.count(F.lit(1)).alias("pings"), F.count_if(fast).alias("removed"), F.max(F.when(~fast, k)).alias("max_kept"), F.max(F.when(fast, k)).alias("max_removed"))
    return out.withColumn("removed_share", F.col("removed") / F.col("pings"))


def match_turbines(pings: DataFrame, turbines: DataFrame, within_m: float = 100.0, cell: float = 0.002) -> DataFrame:
    """Every pair of a ping and a turbine closer than within_m, with dist_m.

    An equi-join on grid cells, the turbine side repeated into the cells that
    its surroundings touch (more columns of them towards the poles), so
    nothing is compared beyond them.
    """
    t = turbines.select("found_id", "wind_farm", F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"), F.explode(geo.around(F.col("latitude"), F.col("longitude"), cell, within_m)).alias("c"))
    t = t.select("found_id", "wind_farm", "t_lat", "t_lon", F.col("c.cy").alias("cy"), F.col("c.cx").alias("cx"))
    p = pings.withColumns({"cy": geo.cell(F.col("lat"), cell), "cx": geo.turned(F.col("lon"), cell)})
    dist = geo.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    return p.join(t, ["cy", "cx"]).withColumn("dist_m", dist).filter(F.col("dist_m") < within_m).drop("cy", "cx", "t_lat", "t_lon")


#: Turbines in the surroundings of one cell up to which their distances are columns, compared in generated code; more are an array.
COLUMNS = 4


def match_nearest(pings: DataFrame, turbines: DataFrame, within_m: float = 100.0, cell: float = 0.002) -> DataFrame:
    """Each ping with a turbine closer than within_m: the nearest one, ties to the smaller found_id, and dist_m.

    Turbines are gathered by cell first, as many as stand in its
    surroundings, so a ping meets one row; no window and no state, which
    serves streams too. Of turbines at one place only that with the smallest
    found_id can be nearest. The most that one cell has is counted
    beforehand; where it is small, distances are columns of their own.
    """
    near = turbines.groupBy("latitude", "longitude").agg(F.min(F.struct("found_id", "wind_farm")).alias("t")).select("latitude", "longitude", "t.*")
    near = near.withColumn("c", F.explode(geo.around(F.col("latitude"), F.col("longitude"), cell, within_m)))
    near = near.groupBy(F.col("c.cy").alias("cy"), F.col("c.cx").alias("cx")).agg(F.collect_list(F.struct("latitude", "longitude", "found_id", "wind_farm")).alias("__t"))
    most = near.agg(F.max(F.size("__t"))).first()[0] or 0
    dist = lambda t: F.struct(geo.haversine(F.col("lat"), F.col("lon"), t["latitude"], t["longitude"]).alias("d"), t["found_id"].alias("f"), t["wind_farm"].alias("w"))
    if most <= COLUMNS:
        own = [F.get("__t", F.lit(i)).alias(f"__t{i}") for i in range(max(1, most))]
        near = near.select("cy", "cx", *own)
        each = [F.when(F.col(f"__t{i}").isNotNull(), dist(F.col(f"__t{i}"))) for i in range(max(1, most))]
        best = each[0] if len(each) == 1 else F.least(*each)
    else:
        best = F.array_min(F.transform("__t", dist))
    p = pings.withColumns({"cy": geo.cell(F.col("lat"), cell), "cx": geo.turned(F.col("lon"), cell)}).join(near, ["cy", "cx"])
    found = p.withColumn("__b", best).filter(F.col("__b.d") < within_m)
    return found.select(*pings.columns, F.col("__b.f").alias("found_id"), F.col("__b.w").alias("wind_farm"), F.col("__b.d").alias("dist_m"))


def nearest_only(matches: DataFrame) -> DataFrame:
    """The nearest turbine of each vessel and time; ties to the smaller found_id."""
    w = Window.partitionBy("mmsi", "ts").orderBy("dist_m", "found_id")
    return matches.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def vessel_metadata(pings: DataFrame) -> DataFrame:
    """name, ship_type (most frequent), length and draught (largest) of each mmsi.

    Pings are read once and counted by vessel and texts; what follows works
    on those few rows.
    """
    sizes = [F.max(c).alias(c) for c in ("length", "draught")]
    counts = pings.groupBy("mmsi", "name", "ship_type").agg(F.count(F.lit(1)).alias("n"), *sizes)
    texts = F.explode(F.array(F.struct(F.lit("name").alias("c"), F.col("name").alias("v")), F.struct(F.lit("ship_type").alias("c"), F.col("ship_type").alias("v"))))
    each = counts.select("mmsi", "n", "length", "draught", texts.alias("x")).groupBy("mmsi", F.col("x.c").alias("c"), F.col("x.v").alias("v")).agg(F.sum("n").alias("n"), *sizes)
    known = F.col("v").isNotNull() & ~F.lower(F.trim("v")).isin(UNKNOWN)
    best = lambda c: F.min_by("v", F.when(known & (F.col("c") == c), F.struct(-F.col("n"), F.col("v")))).alias(c)
    return each.groupBy("mmsi").agg(*sizes, best("name"), best("ship_type")).select("mmsi", "length", "draught", "name", "ship_type")


def sessions(pings: DataFrame, gap_minutes: float = 30.0, *split: str, key: str = "mmsi", ts: str = "ts") -> DataFrame:
    """event_id, a running number for each key: new at the first ping, after a longer gap, or when a split column changes.

    A segmented scan over range partitions (scan.segments): the pings of one
    vessel are in many tasks when they are many.
    """
    def opens(before: Column) -> Column:
        new = F.unix_micros(ts) - F.unix_micros(before[ts]) > gap_minutes * 60e6
        for c in split:
            new = new | ~F.col(c).eqNullSafe(before[c])
        return new

    return segments(cut(pings), [key], [ts, *split], opens, "event_id")


def event_class(minutes: Column) -> Column:
    return F.when(minutes < TRANSFER_BELOW, "Transfer").when(minutes <= EXTENDED_TO, "Extended").otherwise("Stationary/Construction")


def dwell_events(pings: DataFrame, turbines: DataFrame, gap_minutes: float = 30.0, least_minutes: float = 15.0) -> DataFrame:
    """Dwell events from pings: slow pings near a turbine, sessionized for each vessel.

    One row for mmsi and event_id with wind_farm, found_id, start, end,
    ping_count, mean_sog, min_dist, duration_min and event_class; shorter
    events than least_minutes go. Sessions are found by range partitions of
    the matched pings, which are written first.
    """
    at = sessions(nearest_only(match_nearest(stationary(pings), turbines)), gap_minutes, "found_id")
    out = at.groupBy("mmsi", "event_id", "wind_farm", "found_id").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("ping_count"), F.avg("sog").alias("mean_sog"), F.min("dist_m").alias("min_dist")
    )
    out = out.withColumn("duration_min", (F.unix_micros("end") - F.unix_micros("start")) / 60e6)
    return out.filter(F.col("duration_min") >= least_minutes).withColumn("event_class", event_class(F.col("duration_min")))


def fleet_registry(events: DataFrame, metadata: DataFrame) -> DataFrame:
    """Vessels of each farm: total and median minutes, events, size, and whether a crew vessel is likely."""
    out = events.join(metadata, "mmsi", "left").groupBy("mmsi", "name", "ship_type", "wind_farm").agg(
        F.sum("duration_min").alias("total_min"), F.median("duration_min").alias("median_min"), F.count(F.lit(1)).alias("n_events"), F.max("length").alias("length"), F.max("draught").alias("draught")
    )
    likely = F.col("length").between(10, 40) & (F.col("median_min") < 120)
    return out.withColumn("probable_ctv", F.coalesce(likely, F.lit(False)))


def candidate_vessels(pings: DataFrame, turbines: DataFrame, farm: str, below: float = 1.0) -> DataFrame:
    """mmsi and its slow pings within 100 m of one farm's turbines."""
    near = match_nearest(pings.filter(F.col("sog") < below), turbines.filter(F.col("wind_farm") == farm))
    return nearest_only(near).groupBy("mmsi").agg(F.count(F.lit(1)).alias("pings"))


def slow_in_box(pings: DataFrame, box: tuple[float, float, float, float], below: float) -> DataFrame:
    """mmsi with count and mean place of its slow pings in a box."""
    kept = filter_pings(pings, box).filter(F.col("sog") < below)
    return kept.groupBy("mmsi").agg(F.count(F.lit(1)).alias("pings"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def zones(pings: DataFrame, turbines: DataFrame, asset_m: float = 200.0, farm_m: float = 500.0, context_m: float = 5000.0) -> DataFrame:
    """Pings with the nearest turbine's dist_m, its farm and zone: asset, farm, context or null. Farms are their turbines' surroundings."""
    near = match_nearest(pings, turbines, context_m, cell=0.1)
    w = Window.partitionBy("mmsi", "ts").orderBy("dist_m", "found_id")
    near = near.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    d = F.col("dist_m")
    return near.withColumn("zone", F.when(d <= asset_m, "asset").when(d <= farm_m, "farm").otherwise("context"))


def tiered_dwells(pings: DataFrame, turbines: DataFrame, gap_minutes: float = 30.0) -> DataFrame:
    """Dwells of tiers A to D from zones, speeds and durations; our own reading of the published tiers.

    A: asset zone, at most 1 kn, 20 min; B: inside the farm, at most 1 kn,
    30 min; C: inside, over 1 to 3 kn, 20 min; D: context, at most 1 kn, 30 min.
    """
    slow, zone = F.col("sog") <= 1, F.col("zone")
    tier = F.when(slow & (zone == "asset"), "A").when(slow & (zone == "farm"), "B").when((F.col("sog") <= 3) & zone.isin("asset", "farm") & ~slow, "C").when(slow & (zone == "context"), "D")
    at = sessions(zones(pings, turbines).withColumn("dwell_tier", tier).filter("dwell_tier is not null"), gap_minutes, "wind_farm", "dwell_tier")
    out = at.groupBy("mmsi", F.col("event_id").alias("dwell_id"), "wind_farm", "dwell_tier").agg(F.min("ts").alias("start_utc"), F.max("ts").alias("end_utc"), F.count(F.lit(1)).alias("pings"), F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"))
    out = out.withColumn("duration_min", (F.unix_micros("end_utc") - F.unix_micros("start_utc")) / 60e6)
    return out.filter(F.col("duration_min") >= F.when(F.col("dwell_tier").isin("A", "C"), 20).otherwise(30))


def farm_visits(pings: DataFrame, turbines: DataFrame, gap_minutes: float = 60.0) -> DataFrame:
    """Stays in a farm's 5 km context, parted by time gaps and changes of farm; our own definition."""
    at = sessions(zones(pings, turbines), gap_minutes, "wind_farm")
    out = at.groupBy("mmsi", F.col("event_id").alias("visit_id"), "wind_farm").agg(F.min("ts").alias("enter"), F.max("ts").alias("leave"), F.count(F.lit(1)).alias("pings"), F.min("dist_m").alias("closest_m"))
    return out.withColumn("quality", F.when(F.col("pings") < 3, "sparse").otherwise("ok"))


def impossible_jumps(events: DataFrame, max_knots: float = 45.0) -> DataFrame:
    """Successive events of a vessel that overlap, move in no time or need more than max_knots; with lat, lon."""
    w = Window.partitionBy("mmsi").orderBy("start", "end")
    nm = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"), geo.EARTH_NM)
    hours = (F.unix_micros("start") - F.unix_micros(F.lag("end").over(w))) / 3600e6
    out = events.withColumns({"nm": nm, "hours": hours, "previous_end": F.lag("end").over(w)})
    why = F.when(F.col("hours") < 0, "overlap").when((F.col("hours") == 0) & (F.col("nm") > 0), "moved_in_no_time").when(F.col("nm") / F.col("hours") > max_knots, "too_fast")
    return out.withColumn("reason", why).filter("reason is not null")


def suspect_vessels(registry: DataFrame, keywords: tuple[str, ...] = ("fishing", "pleasure", "sailing")) -> DataFrame:
    """Vessels whose type, or length outside 5 to 180 m, speaks against service at turbines."""
    from tidemark.functions.values import reasons

    kind, length = F.lower(F.coalesce("ship_type", F.lit(""))), F.col("length")
    why = reasons(*((kind.contains(k), f"type_{k}") for k in keywords), (F.col("ship_type").isNull(), "type_missing"), (length.isNull(), "length_missing"), (length < 5, "length_below_5"), (length > 180, "length_above_180"))
    return registry.withColumn("suspect_reason", why).filter("suspect_reason != ''")
