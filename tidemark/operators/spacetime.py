"""Joins in space and time with explicit reasons for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.functions.values import midpoint
from tidemark.operators.reports import ROLES
from tidemark.operators.timejoin import asof_nearest, bracketed, months
from tidemark.sources.gridded import nearest_cell


def station_roles(stations: DataFrame, points: DataFrame, width: float = 1.0) -> DataFrame:
    """For each station (station, lat, lon) and farm within 150 km: its nearest site point, the distances to it and to the farm's centroid, and the station's role.

    Distances depend on places alone, so places of stations and of a farm's
    points are compared once each, however many stations or points share one;
    the stations get their place's answers. Places of stations are repeated
    into the cells within reach, so only near pairs meet; roles follow the
    distance to the nearest point.
    """
    reach = ROLES[-1][0]
    spots = stations.select(F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).filter("s_lat is not null and s_lon is not null").distinct()
    s = spots.withColumn("c", F.explode(geo.around(F.col("s_lat"), F.col("s_lon"), width, reach * 1000.0))).select("s_lat", "s_lon", "c.cy", "c.cx")
    p = points.groupBy("wind_farm", "lat", "lon").agg(F.min("sample_point_id").alias("sample_point_id"))
    p = p.withColumns({"cy": geo.cell(F.col("lat"), width), "cx": geo.turned(F.col("lon"), width)})
    met = p.join(s, ["cy", "cx"]).withColumn("km", geo.haversine(F.col("s_lat"), F.col("s_lon"), F.col("lat"), F.col("lon"), geo.EARTH_KM)).filter(F.col("km") <= reach)
    best = met.groupBy("s_lat", "s_lon", "wind_farm").agg(F.min(F.struct("km", "sample_point_id")).alias("b"))
    centre = points.groupBy("wind_farm").agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    role = F.coalesce(*(F.when(F.col("b.km") <= km, F.lit(name)) for km, name in ROLES))
    near = best.join(centre, "wind_farm").select(
        "s_lat", "s_lon", "wind_farm", "b.sample_point_id", "b.km", geo.haversine(F.col("s_lat"), F.col("s_lon"), F.col("c_lat"), F.col("c_lon"), geo.EARTH_KM).alias("centroid_km"), role.alias("role")
    )
    out = stations.select("station", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")).distinct().join(near, ["s_lat", "s_lon"])
    return out.select("station", "wind_farm", "sample_point_id", "km", "centroid_km", "role")


def event_field(events: DataFrame, field: DataFrame, event_id: str = "event_id", max_km: float = 25.0, tolerance_min: float = 90.0, width: float = 1.0) -> DataFrame:
    """Each event with the field (ts, grid_lat, grid_lon, hs, tp, tm) of the nearest cell and of the time nearest to its middle.

    hs must be there for a cell to count; tp falls back to tm. Returns
    event_id, km, gap_s, hs, tp, period_field and missing_reason: no_place,
    bad_window, outside_grid, no_cell_in_reach, no_time_in_tolerance or
    no_value.
    """
    cells = field.filter(F.col("hs").isNotNull()).select("grid_lat", "grid_lon").distinct()
    placed = events.select(event_id, F.col("lat"), F.col("lon"), "start", "end")
    at = nearest_cell(placed.filter("lat is not null and lon is not null"), cells, max_km, width, (event_id,), in_box=True)
    at = at.select(event_id, "km", "match_status", *(F.when(F.col("match_status") == "nearest_valid_grid", F.col(c)).alias(c) for c in ("grid_lat", "grid_lon")))
    sound = F.col("start").isNotNull() & (F.col("end") >= F.col("start"))
    out = placed.join(at, event_id, "left").withColumn("ts", F.when(sound, midpoint(F.col("start"), F.col("end"))))
    ready = out.filter("grid_lat is not null and ts is not null").select(event_id, "grid_lat", "grid_lon", "ts")
    got = asof_nearest(ready, field, ["grid_lat", "grid_lon"], ["hs", "tp", "tm"], tolerance_min * 60)
    out = out.drop("grid_lat", "grid_lon").join(got.select(event_id, "hs", "tp", "tm", "gap_s"), event_id, "left")
    why = (
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), "no_place").when(F.col("ts").isNull(), "bad_window").when(F.col("match_status") == "outside_grid", "outside_grid")
        .when(F.col("match_status") != "nearest_valid_grid", "no_cell_in_reach").when(F.col("gap_s").isNull(), "no_time_in_tolerance").when(F.col("hs").isNull(), "no_value")
    )
    used = F.when(F.col("tp").isNotNull(), "tp").when(F.col("tm").isNotNull(), "tm")
    return out.select(event_id, "km", "gap_s", "hs", F.coalesce("tp", "tm").alias("tp"), used.alias("period_field"), why.alias("missing_reason"))


def month_sources(windows: DataFrame, files: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Every month that a window (start, end) touches with the source files of that month, matched by the yyyy_MM in their names (column file)."""
    token = F.regexp_extract("file", r"(\d{4}_\d{2})(?!\d)", 1)
    have = files.select(token.alias("token")).filter("token != ''").groupBy("token").agg(F.count(F.lit(1)).alias("files"))
    out = months(windows.select(event_id, "start", "end"), "start", "end").withColumn("token", F.date_format("month", "yyyy_MM"))
    return out.join(have, "token", "left").select(event_id, "month", F.coalesce("files", F.lit(0)).alias("files"), F.when(F.col("files") > 0, "available").otherwise("missing").alias("status"))


def partition_candidates(events: DataFrame, manifest: DataFrame, samples: DataFrame, value: str, accepted: tuple[str, ...] = ("complete",), event_id: str = "event_id") -> DataFrame:
    """One candidate for each event from the accepted (wind_farm, year) partitions of an archive; what has none says why.

    manifest: wind_farm, year, status, points; samples: wind_farm, ts and the
    value. Reasons: bad_window, no_partition, partition_not_accepted,
    no_points, unreadable_rows (no value in the whole partition),
    not_bracketed, values_missing (none in the samples taken).
    """
    year = F.year(midpoint(F.col("start"), F.col("end")))
    own = events.withColumn("year", F.when(F.col("start").isNotNull() & (F.col("end") >= F.col("start")), year))
    kept = samples.withColumn("year", F.year("ts"))
    readable = kept.groupBy("wind_farm", "year").agg(F.count(value).alias("values"))
    met = own.join(manifest.select("wind_farm", "year", "status", "points"), ["wind_farm", "year"], "left").join(readable, ["wind_farm", "year"], "left")
    why = (
        F.when(F.col("year").isNull(), "bad_window").when(F.col("status").isNull(), "no_partition").when(~F.col("status").isin(*accepted), "partition_not_accepted")
        .when(F.coalesce("points", F.lit(0)) == 0, "no_points").when(F.coalesce("values", F.lit(0)) == 0, "unreadable_rows")
    )
    met = met.withColumn("missing_reason", why)
    got = bracketed(met.filter("missing_reason is null").select(event_id, "wind_farm", "start", "end"), samples, ["wind_farm"], value, event_id)
    out = met.join(got.select(event_id, "value", "method", F.col("missing_reason").alias("__why")), event_id, "left")
    reason = F.coalesce("missing_reason", F.when(F.col("value").isNull(), F.when(F.col("__why") == "values_missing", "values_missing").otherwise("not_bracketed")))
    return out.select(event_id, "value", F.coalesce("method", F.lit("not_assigned")).alias("method"), reason.alias("missing_reason"))


def rounded_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("wind_farm",), places: int = 6) -> DataFrame:
    """left with right's columns where the keys and both coordinates, rounded to so many places, are equal; right holds a place once."""
    at = lambda df: df.withColumns({"__y": F.round("latitude", places), "__x": F.round("longitude", places)})
    other = at(right).drop("latitude", "longitude").dropDuplicates([*keys, "__y", "__x"])
    return at(left).join(other, [*keys, "__y", "__x"], "left").drop("__y", "__x")
