"""Farm footprints, requirements, recommendations and acquisition plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.values import loose_date, reasons
from tidemark.plans.lineage import cut


def hulls(turbines: DataFrame) -> DataFrame:
    """wind_farm, its mean place and its convex hull in metres on the tangent plane there, as an array of (x, y), counter-clockwise.

    A farm's turbines are one pandas group; they are few (a farm has
    hundreds), and a single turbine's hull is one point.
    """
    import pandas as pd

    def hull(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import math

        lat0, lon0 = float(pdf.latitude.mean()), float(pdf.longitude.mean())
        pts = sorted({(math.radians(lon - lon0) * math.cos(math.radians(lat0)) * 6_371_000.0, math.radians(lat - lat0) * 6_371_000.0) for lat, lon in zip(pdf.latitude, pdf.longitude)})

        def half(points: list) -> list:
            out: list = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out

        ring = half(pts)[:-1] + half(pts[::-1])[:-1] if len(pts) > 1 else pts
        return pd.DataFrame([(key[0], lat0, lon0, [{"x": x, "y": y} for x, y in ring])], columns=["wind_farm", "lat0", "lon0", "hull"])

    return turbines.filter("latitude is not null and longitude is not null").select("wind_farm", "latitude", "longitude").groupBy("wind_farm").applyInPandas(hull, "wind_farm string, lat0 double, lon0 double, hull array<struct<x: double, y: double>>")


def hull_distance(lat: Column, lon: Column) -> Column:
    """Metres from a point to the hull of its row (lat0, lon0, hull); 0 inside."""
    px, py = geo.tangent(lat, lon, F.col("lat0"), F.col("lon0"))
    ring = F.col("hull")
    ahead = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, F.slice(ahead, F.lit(1), F.size(ring)), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, a).alias("b")))
    apart = F.array_min(F.transform(edges, lambda e: geo.segment_distance(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))
    left = F.forall(edges, lambda e: (e["b"]["x"] - e["a"]["x"]) * (py - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (px - e["a"]["x"]) >= 0)
    return F.when(left & (F.size(ring) > 2), 0.0).otherwise(apart)


def hull_zones(pings: DataFrame, turbines: DataFrame, asset_m: float = 200.0, farm_m: float = 500.0, context_m: float = 5000.0) -> DataFrame:
    """Pings with their nearest turbine's farm, dist_m, hull_m (metres to the farm's hull, 0 inside) and zone.

    asset: within asset_m of the turbine; farm: within farm_m of the hull;
    context: within context_m of it; null beyond. A place with no turbine
    within twice context_m is in no farm's reach. Hulls are a row for each farm.
    """
    from tidemark.operators.pings import match_nearest

    near = match_nearest(pings, turbines, 2 * context_m, cell=0.1)
    met = near.join(hulls(turbines), "wind_farm").withColumn("hull_m", hull_distance(F.col("lat"), F.col("lon"))).drop("lat0", "lon0", "hull")
    zone = F.when(F.col("dist_m") <= asset_m, "asset").when(F.col("hull_m") <= farm_m, "farm").when(F.col("hull_m") <= context_m, "context")
    return met.withColumn("zone", zone)


def nearest_neighbours(turbines: DataFrame, rings_m: tuple[float, ...] = (5_000.0, 50_000.0)) -> DataFrame:
    """found_id, nearest and km: each turbine's nearest other one of its farm (ties to the smaller found_id); a farm's only turbine has none.

    Turbines meet those of the cells within a ring; who has none there goes
    on to the next ring, and at last to the whole farm. So pairs grow with
    the turbines that stand close, not with the square of a farm.
    """
    t = turbines.select("found_id", "wind_farm", "latitude", "longitude")
    other = t.select(F.col("found_id").alias("nearest"), "wind_farm", F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon"))
    km = geo.haversine(F.col("latitude"), F.col("longitude"), F.col("b_lat"), F.col("b_lon"), geo.EARTH_KM)
    best = lambda met: met.filter("found_id != nearest").withColumn("km", km)
    least = lambda met: met.groupBy("found_id").agg(F.min_by("nearest", F.struct("km", "nearest")).alias("nearest"), F.min("km").alias("km"))
    left, out = t, None
    for reach in rings_m:
        width = reach / 100_000
        a = left.withColumn("c", F.explode(geo.around(F.col("latitude"), F.col("longitude"), width, reach))).select("*", "c.cy", "c.cx").drop("c")
        b = other.withColumns({"cy": geo.cell(F.col("b_lat"), width), "cx": geo.turned(F.col("b_lon"), width)})
        found = cut(least(best(a.join(b, ["wind_farm", "cy", "cx"])).filter(F.col("km") * 1000 <= reach)))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select("found_id"), "found_id", "left_anti")
    return out.unionByName(least(best(left.join(other, "wind_farm"))))


def requirements(turbines: DataFrame, buffer_deg: float = 0.25, study_start: str = "2000-01-01") -> DataFrame:
    """Each farm's start of operation (commissioning, else operation date, else the study's start, which asks for a review) and padded box."""
    start = F.coalesce(F.min(loose_date(F.col("commissioning").cast("string"))), F.lit(study_start).cast("date"))
    out = turbines.groupBy("wind_farm").agg(
        F.count(F.lit(1)).alias("turbines"), start.alias("operation_start"), F.max(F.col("commissioning").isNull()).alias("needs_review"),
        (F.min("latitude") - buffer_deg).alias("min_lat"), (F.max("latitude") + buffer_deg).alias("max_lat"), (F.min("longitude") - buffer_deg).alias("min_lon"), (F.max("longitude") + buffer_deg).alias("max_lon"),
    )
    return out


def only_in_events(events: DataFrame, turbines: DataFrame) -> DataFrame:
    """Farms of events that no turbine belongs to, by normalized name."""
    from tidemark.functions.values import normal_name

    have = turbines.select(normal_name(F.col("wind_farm")).alias("__k")).distinct()
    return events.select("wind_farm").distinct().withColumn("__k", normal_name(F.col("wind_farm"))).join(have, "__k", "left_anti").drop("__k")


def degree_tiles(boxes: DataFrame) -> DataFrame:
    """wind_farm and the number of one-degree tiles that its box touches."""
    y = F.sequence(F.floor("min_lat"), F.floor("max_lat"))
    x = F.sequence(F.floor("min_lon"), F.floor("max_lon"))
    t = boxes.withColumn("ty", F.explode(y)).withColumn("tx", F.explode(x))
    return t.groupBy("wind_farm").agg(F.count_distinct("ty", "tx").alias("tiles"))


def recommend(farm_years: DataFrame, least_events: int = 10, stress_events: int = 3) -> DataFrame:
    """Farm years with a recommendation yes, stress_test_only or no, and why.

    farm_years have events, valid_waves, median_depth and in_domain.
    """
    enough, some = F.col("events") >= least_events, F.col("events") >= stress_events
    shallow = F.coalesce(F.col("median_depth") <= 5, F.lit(False))
    why = reasons((~F.col("in_domain"), "outside_domain"), (~enough, "few_events"), (F.col("valid_waves") == 0, "no_valid_waves"), (shallow, "shallow"))
    verdict = F.when(F.col("in_domain") & enough & (F.col("valid_waves") > 0) & ~shallow, "yes").when(F.col("in_domain") & some, "stress_test_only").otherwise("no")
    return farm_years.withColumns({"recommendation": verdict, "reason": why})


#: The current product's domain (west, east, south, north) and the longitude east of which it is masked; limits of a farm year at scale; bytes of an hourly row as it comes and as it is kept.
DOMAIN, MASKED_EAST = (-19.89, 13.0, 40.07, 65.0), 10.0
SCALE = {"events": 10, "tier_a": 3, "context": 50, "shallow_share": 0.5, "processed_mb": 250.0}
RAW_BYTES, KEPT_BYTES = 64.0, 4_498_964 / 500_688


def depth_shares(points: DataFrame, keys: list[str], depth: str = "depth", shallow_m: float = 10.0) -> DataFrame:
    """Sample points of each key: sample_points, shallow_share (of those with a depth, at most shallow_m), and the exact p10 and median depth."""
    from tidemark.operators.stats import with_quantiles

    out = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_points"), F.coalesce(F.avg((F.col(depth) <= shallow_m).cast("int")), F.lit(0.0)).alias("shallow_share"))
    return with_quantiles(out, points, keys, {depth: {"p10_depth": 0.1, "median_depth": 0.5}})


def scale_plan(farm_years: DataFrame) -> DataFrame:
    """farm_years with region, domain, shallow_warning, rows of a year's hours, raw_mb and processed_mb, runtime class, recommendation (yes, stress_test_only, no) and reason.

    farm_years have country, min_lon, max_lon, min_lat, max_lat, year, events,
    tier_a, sample_points and shallow_share.
    """
    c = {n: F.col(n) for n in farm_years.columns}
    west, east, south, north = DOMAIN
    country, middle = F.lower(F.coalesce(c["country"], F.lit(""))), (c["min_lon"] + c["max_lon"]) / 2
    region = (
        F.when(c["max_lon"] > MASKED_EAST, "baltic_or_transition").when(country.contains("united kingdom") | country.contains("ireland"), "uk_irish_shelf")
        .when(country.isin("germany", "netherlands", "belgium", "denmark"), F.when(middle < 9.0, "southern_north_sea").otherwise("north_sea_transition")).when(country == "france", "channel_or_biscay").otherwise("north_west_shelf")
    )
    inside = (c["min_lon"] >= west) & (c["max_lon"] <= east) & (c["min_lat"] >= south) & (c["max_lat"] <= north)
    domain = F.when(~inside, "outside").when(c["max_lon"] > MASKED_EAST, "masked_or_boundary").otherwise("inside")
    share = F.coalesce(c["shallow_share"], F.lit(0.0))
    warning = F.when(share >= 0.8, "severe").when(share > 0.5, "dominated").when(share >= 0.2, "moderate").when(share > 0, "some").otherwise("none")
    hours = F.datediff(F.make_date(c["year"] + 1, F.lit(1), F.lit(1)), F.make_date(c["year"], F.lit(1), F.lit(1))) * 24
    rows = (F.greatest(c["sample_points"], F.lit(0)) * hours).cast("long")
    size = lambda b: F.round(rows * b / 1e6, 3)
    runtime = F.when(rows < 1_000_000, "small").when(rows < 5_000_000, "medium").otherwise("large")
    out = farm_years.withColumns({"region": region, "domain": domain, "shallow_warning": warning, "rows": rows, "raw_mb": size(RAW_BYTES), "processed_mb": size(KEPT_BYTES), "runtime": runtime})
    ok, enough, tier_a = F.col("domain") == "inside", F.col("events") >= SCALE["events"], F.col("tier_a") >= SCALE["tier_a"]
    context, sampled, small, shallow = F.col("events") >= SCALE["context"], F.col("sample_points") > 0, F.col("processed_mb") <= SCALE["processed_mb"], share > SCALE["shallow_share"]
    base = ok & enough & sampled & small
    verdict = F.when(base & tier_a & ~shallow, "yes").when(base & (shallow | context), "stress_test_only").otherwise("no")
    why = reasons((~ok, "domain"), (~enough, "few_events"), (~tier_a & context, "few_tier_a_but_many_events"), (~tier_a & ~context, "few_tier_a"), (shallow, "shallow"), (~small, "too_large"), (~sampled, "no_points"))
    return out.withColumns({"recommendation": verdict, "reason": why})


def top_recommended(farm_years: DataFrame, n: int | None) -> DataFrame:
    """The n recommended farm years with most events, or all; never those for stress tests."""
    ok = farm_years.filter("recommendation = 'yes'")
    return ok if n is None else ok.orderBy(F.desc("events"), "wind_farm", "year").limit(n)


def interaction_cases(df: DataFrame, pairs: list[tuple[str, str]], q: float = 0.9) -> DataFrame:
    """For pairs of columns, rows where both are at or above their own quantile."""
    from tidemark.operators.stats import with_quantiles

    names = list(dict.fromkeys(c for p in pairs for c in p))
    limits = with_quantiles(df.sparkSession.range(1).drop("id"), df, [], {c: {f"__{c}": q} for c in names})
    one = df.crossJoin(F.broadcast(limits)).agg(*(F.count_if((F.col(a) >= F.col(f"__{a}")) & (F.col(b) >= F.col(f"__{b}"))).alias(f"{a}+{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f"{a}+{b}").alias("case"), F.col(f"{a}+{b}").alias("rows")) for a, b in pairs))).alias("x")).select("x.*")


def attribute_lists(turbines: DataFrame, columns: list[str]) -> DataFrame:
    """Each farm's turbines and the distinct values of some columns, sorted and joined."""
    lists = (F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "; ").alias(c) for c in columns)
    return turbines.groupBy("wind_farm").agg(F.count(F.lit(1)).alias("turbines"), *lists)


def event_points(events: DataFrame, turbines: DataFrame, mode: str) -> DataFrame:
    """Events with the place that stands for them: their own, that of the nearest turbine (found_id), or the farm's mean, with a status."""
    if mode == "event":
        lat, lon, out = F.col("centroid_lat"), F.col("centroid_lon"), events
    elif mode == "asset":
        out = events.join(turbines.select("found_id", F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon")), "found_id", "left")
        lat, lon = F.col("__lat"), F.col("__lon")
    elif mode == "farm":
        out = events.join(turbines.groupBy("wind_farm").agg(F.avg("latitude").alias("__lat"), F.avg("longitude").alias("__lon")), "wind_farm", "left")
        lat, lon = F.col("__lat"), F.col("__lon")
    else:
        raise ValueError(mode)
    return out.select(*events.columns, lat.alias("point_lat"), lon.alias("point_lon"), F.when(lat.isNull() | lon.isNull(), "unresolved").otherwise(mode).alias("point_status"))
