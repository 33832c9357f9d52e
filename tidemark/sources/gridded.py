"""Long-form gridded fields (time, grid_lat, grid_lon, values): nearest valid cells and point series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo


def site_points(turbines: DataFrame) -> DataFrame:
    """One farm_centroid (mean) and a turbine_0000... for each turbine of a farm."""
    from pyspark.sql import Window

    c = turbines.groupBy("wind_farm").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")).select("wind_farm", F.lit("farm_centroid").alias("sample_point_id"), F.lit("farm_centroid").alias("sample_point_type"), "lat", "lon")
    n = F.row_number().over(Window.partitionBy("wind_farm").orderBy("found_id")) - 1
    t = turbines.select("wind_farm", F.format_string("turbine_%04d", n).alias("sample_point_id"), F.lit("turbine").alias("sample_point_type"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return c.unionByName(t)


def valid_cells(field: DataFrame, value: str, first_steps: int = 8) -> DataFrame:
    """Cells with any finite value in the first time steps of the field."""
    early = field.select("ts").distinct().orderBy("ts").limit(first_steps)
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    return field.join(F.broadcast(early), "ts", "left_semi").filter(ok).select("grid_lat", "grid_lon").distinct()


def check_site_points(points: DataFrame, turbines: DataFrame) -> DataFrame:
    """points, failing in a task when a farm has not one centroid and a point for each turbine, or repeats a point."""
    want = turbines.groupBy("wind_farm").agg((F.count(F.lit(1)) + 1).alias("want"))
    have = points.groupBy("wind_farm").agg(F.count(F.lit(1)).alias("have"), F.count_distinct("sample_point_id").alias("ids"))
    met = want.join(have, "wind_farm", "full")
    why = F.when(F.col("have").isNull(), "a farm has no points").when(F.col("want").isNull(), "a farm has no turbines").when(F.col("ids") < F.col("have"), "a point is repeated").when(F.col("want") != F.col("have"), "a farm's points do not match its turbines")
    ok = met.select("wind_farm", F.when(why.isNotNull(), F.raise_error(why)).otherwise(F.lit(1)).alias("__ok"))
    return points.join(ok, "wind_farm", "full").filter("__ok = 1").select(*points.columns)


def nearest_cell(points: DataFrame, cells: DataFrame, max_km: float = 25.0, width: float = 0.5, keys: tuple[str, ...] = ("wind_farm", "sample_point_id"), checked: bool = True, in_box: bool = False) -> DataFrame:
    """points with the nearest cell within max_km, its distance and a status.

    Cells are those of any grid, regular or curvilinear, as a list. Points
    meet the cells of the 3 x 3 grid squares around them; a square must be
    at least max_km wide, in longitude up to the latitude where width degrees
    are that far. no_valid_grid_within_search: no cell there. With cells that
    were not checked for values the status is nearest_unchecked; with in_box,
    points outside the box of all cells are outside_grid. A place is compared
    once, however many points are there.
    """
    p = points.select("lat", "lon").distinct().withColumn("__c", F.explode(geo.neighbours(F.col("lat"), F.col("lon"), width)))
    p = p.select("lat", "lon", F.col("__c.cy").alias("cy"), F.col("__c.cx").alias("cx"))
    c = cells.select("grid_lat", "grid_lon", geo.cell(F.col("grid_lat"), width).alias("cy"), geo.cell(F.col("grid_lon"), width).alias("cx"))
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("grid_lat"), F.col("grid_lon"), geo.EARTH_KM)
    best = p.join(c, ["cy", "cx"]).withColumn("km", km).groupBy("lat", "lon").agg(F.min(F.struct("km", "grid_lat", "grid_lon")).alias("b")).select("lat", "lon", "b.*")
    out = points.join(best, ["lat", "lon"], "left").select(*keys, *(c for c in points.columns if c not in keys), "km", "grid_lat", "grid_lon")
    status = F.when(F.col("km").isNull(), "no_valid_grid_within_search").when(F.col("km") <= max_km, "nearest_valid_grid" if checked else "nearest_unchecked").otherwise("valid_grid_too_far")
    if in_box:
        box = cells.agg(F.min("grid_lat").alias("__a"), F.max("grid_lat").alias("__b"), F.min("grid_lon").alias("__c"), F.max("grid_lon").alias("__d"))
        out = out.crossJoin(F.broadcast(box))  # one row
        status = F.when(~(F.col("lat").between(F.col("__a"), F.col("__b")) & F.col("lon").between(F.col("__c"), F.col("__d"))), "outside_grid").otherwise(status)
    return out.withColumn("match_status", status).drop("__a", "__b", "__c", "__d")


def surface_level(field: DataFrame) -> DataFrame:
    """Of each cell and time the level whose depth is nearest to 0."""
    values = [c for c in field.columns if c not in ("ts", "grid_lat", "grid_lon", "depth")]
    return field.groupBy("ts", "grid_lat", "grid_lon").agg(F.min_by(F.struct("depth", *values), F.struct(F.abs("depth"), "depth")).alias("x")).select("ts", "grid_lat", "grid_lon", "x.*")


def point_series(field: DataFrame, points: DataFrame) -> DataFrame:
    """Series of the cells that points were given (nearest_cell); points without one have no rows."""
    own = points.filter("match_status = 'nearest_valid_grid'").select("wind_farm", "sample_point_id", "grid_lat", "grid_lon", "km")
    return field.join(own, ["grid_lat", "grid_lon"])


def depth_assignment(points: DataFrame, payloads: DataFrame, step: float = 1 / 480) -> DataFrame:
    """Depth of each point from cached payloads (key, payload JSON with avg and smoothed), positive down, with a status."""
    from tidemark.functions.values import cache_key

    keyed = points.withColumn("key", cache_key(F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon")))
    x = F.from_json("payload", "avg double, smoothed double")
    out = keyed.join(payloads.select("key", "payload", F.lit(True).alias("asked")), "key", "left").withColumn("x", x)
    depth = F.abs(F.coalesce("x.avg", "x.smoothed"))
    status = F.when(F.col("asked").isNull(), "source_request_failed").when(F.col("payload").isNull(), "source_payload_missing").when(depth.isNull(), "source_depth_missing").otherwise("ok")
    return out.select(*points.columns, depth.alias("water_depth_m"), geo.snap(F.col("lat"), step).alias("grid_lat"), geo.snap(F.col("lon"), step).alias("grid_lon"), status.alias("depth_status"))


def depth_references(assigned: DataFrame, payloads: DataFrame, source: str, version: str) -> DataFrame:
    """Depth assignments with where they come from: source, version, the field used (avg, smoothed), and the distance of the snapped cell in metres."""
    from tidemark.functions.values import cache_key

    key = cache_key(F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon"))
    x = F.from_json("payload", "avg double, smoothed double")
    used = payloads.select("key", F.when(x["avg"].isNotNull(), "avg").when(x["smoothed"].isNotNull(), "smoothed").alias("depth_field"))
    out = assigned.withColumn("key", key).join(used, "key", "left")
    return out.withColumns({"depth_source": F.lit(source), "depth_version": F.lit(version), "snap_m": geo.haversine(F.col("lat"), F.col("lon"), F.col("grid_lat"), F.col("grid_lon"))})


def materialization_plan(field: DataFrame, points: DataFrame, existing: DataFrame, variables: list[str]) -> DataFrame:
    """For each farm's field: variables present and missing, time range, step, years, expected rows, and whether it is ready or there already.

    field has wind_farm, ts, grid_lat, grid_lon and some of the variables;
    existing has wind_farm and year of what was made before.
    """
    have = [v for v in variables if v in field.columns]
    per = field.groupBy("wind_farm").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("ts").alias("times"), F.array_sort(F.collect_set(F.year("ts"))).alias("years"),
        *(F.max(F.col(v).isNotNull()).alias(f"__{v}") for v in have),
    )
    n = points.groupBy("wind_farm").agg(F.count(F.lit(1)).alias("points"))
    done = existing.groupBy("wind_farm").agg(F.array_sort(F.collect_set("year")).alias("done"))
    out = per.join(n, "wind_farm", "left").join(done, "wind_farm", "left")
    present = F.array_compact(F.array(*(F.when(F.col(f"__{v}"), F.lit(v)) for v in have))) if have else F.expr("cast(array() as array<string>)")
    step = (F.unix_seconds("last") - F.unix_seconds("first")) / 3600.0 / F.nullif(F.col("times") - 1, F.lit(0))
    out = out.withColumns({"present": present, "step_h": step, "expected_rows": F.col("times") * F.coalesce("points", F.lit(0)), "left_years": F.array_except("years", F.coalesce("done", F.expr("cast(array() as array<int>)")))})
    out = out.withColumn("missing", F.array_except(F.array(*map(F.lit, variables)), F.col("present")))
    state = F.when(F.col("points").isNull(), "blocked_no_points").when(F.size("missing") > 0, "blocked_missing_variables").when(F.size("left_years") == 0, "done").otherwise("ready")
    return out.withColumn("state", state).drop(*(f"__{v}" for v in have))


def blocked_rows(points: DataFrame, source: str, year: int, reason: str, values: list[str]) -> DataFrame:
    """One row of nulls with the reason for each site point of an unavailable source."""
    return points.select("wind_farm", "sample_point_id", F.lit(source).alias("source"), F.lit(year).alias("year"), *(F.lit(None).cast("double").alias(v) for v in values), F.lit(reason).alias("missing_reason"))


def candidate_sites(files: DataFrame, turbines: DataFrame) -> DataFrame:
    """Sites found in cache file names (column file): place, nearest farm centroid and the months covered."""
    from tidemark.functions.values import file_fields

    lat, lon, year, month = file_fields(F.col("file"))
    sites = files.select(lat.alias("lat"), lon.alias("lon"), F.format_string("%04d-%02d", year, month).alias("month")).filter("lat is not null")
    sites = sites.groupBy("lat", "lon").agg(F.array_sort(F.collect_set("month")).alias("months"))
    farms = turbines.groupBy("wind_farm").agg(F.avg("latitude").alias("f_lat"), F.avg("longitude").alias("f_lon"))
    # a site per cache file and a centroid per farm: both are short lists of names
    km = geo.haversine(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon"), geo.EARTH_KM)
    met = sites.crossJoin(F.broadcast(farms)).withColumn("km", km)
    return met.groupBy("lat", "lon", "months").agg(F.min_by("wind_farm", F.struct("km", "wind_farm")).alias("nearest_farm"), F.min("km").alias("km"))
