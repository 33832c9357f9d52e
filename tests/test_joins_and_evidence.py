import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import angles, geo, values
from tidemark.operators import audit as A
from tidemark.operators import envelope as V
from tidemark.operators import evidence as E
from tidemark.operators import models as M
from tidemark.operators import timejoin as J
from tidemark.sources import files, gridded

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_nearest_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, at(10)), (2, at(60))], "k long, ts timestamp").withColumn("g", F.lit(1))
    right = spark.createDataFrame([(1, at(5), "a"), (1, at(15), "b"), (1, at(80), "c")], "g int, ts timestamp, v string")
    got = {r.k: (r.v, r.gap_s) for r in J.asof_nearest(left, right, ["g"], ["v"], 600).collect()}
    assert got == {1: ("a", 300.0), 2: (None, None)}
    late = {r.k: r.v for r in J.asof_nearest(left, right, ["g"], ["v"], 600, tie="later").collect()}
    assert late[1] == "b"
    plan = J.asof_nearest(left, right, ["g"], ["v"], 600)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_window_mean_or_nearest_or_a_reason(spark):
    ev = spark.createDataFrame([(1, "x", at(0), at(60)), (2, "x", at(200), at(210)), (3, "x", at(900), at(910)), (4, "x", at(10), at(0))], "event_id long, f string, start timestamp, end timestamp")
    sm = spark.createDataFrame([("x", at(0), 1.0), ("x", at(60), 3.0), ("x", at(190), 7.0), ("x", at(30), None)], "f string, ts timestamp, v double")
    got = {r.event_id: (r.value, r.n_samples, r.method, r.missing_reason) for r in J.window_or_nearest(ev, sm, ["f"], "v", 1800).collect()}
    assert got == {1: (2.0, 2, "window", None), 2: (7.0, 1, "nearest", None), 3: (None, 0, None, "no_samples_in_tolerance"), 4: (None, 0, None, "bad_window")}


def test_a_repeated_layer_key_fails(spark):
    base = spark.createDataFrame([(1,), (2,)], "k long")
    layer = spark.createDataFrame([(1, 5), (1, 6)], "k long, v int")
    with pytest.raises(Exception, match="repeats a key"):
        J.one_to_one(base, layer, ["k"]).collect()
    assert sorted(r.v or 0 for r in J.one_to_one(base, layer.limit(1), ["k"]).collect()) == [0, 5]


def test_directions_pass_through_north(spark):
    r = spark.range(1).select(angles.interpolate(F.lit(350.0), F.lit(10.0), F.lit(0.5)).alias("a"), angles.difference(F.lit(350.0), F.lit(10.0)).alias("b"), angles.sector(F.lit(340.0)).alias("c"), angles.direction(F.lit(0.0), F.lit(0.0)).alias("d")).first()
    assert min(r.a, 360 - r.a) < 1e-6 and r.b == 20.0 and r.c == "N" and r.d is None


def test_projection_and_values(spark):
    x, y = geo.utm(F.lit(54.0), F.lit(9.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y"), values.number(F.lit(" 1,5 ")).alias("n"), values.number(F.lit("NaN")).alias("z"), values.loose_date(F.lit("2020-05")).alias("d"), values.lag_text(F.lit(-8785)).alias("l"), values.share(F.lit(1), F.lit(0)).alias("s"), values.normal_name(F.lit("Ünter Öst-1")).alias("m")).first()
    assert abs(r.x - 500000) < 1e-3 and abs(r.y - 5983600) < 2000
    assert (r.n, r.z, str(r.d), r.l, r.s, r.m) == (1.5, None, "2020-05-01", "-1y 1d 1h", None, "unterost1")


def test_confidence_of_one_and_no_source(spark):
    c = spark.createDataFrame([(1, "nws", 1.0, 5.0, 0.9, False), (2, "nws", None, 5.0, 0.9, False)], "dwell_id long, source string, hs double, tp double, quality double, shallow boolean")
    got = {r.dwell_id: (r.confidence, r.hs_range, r.hs) for r in E.event_confidence(c).collect()}
    assert got == {1: ("C", 0.0, 1.0), 2: ("D", None, None)}


def test_banned_provenance_fails(spark):
    c = spark.createDataFrame([("simulated_tide", 1.0)], "provenance string, current_speed double")
    with pytest.raises(Exception, match="provenance"):
        E.provenance_gate(c).collect()


def test_nearest_point_falls_back(spark):
    ev = spark.createDataFrame([(1, "Farm A", 54.0, 7.0), (2, "farm-a", None, None), (3, "none", 54.0, 7.0)], "event_id long, wind_farm string, centroid_lat double, centroid_lon double")
    pts = spark.createDataFrame([("farm_a", "p1", "turbine", 54.0, 7.0), ("farm_a", "c", "farm_centroid", 54.5, 7.0)], "wind_farm string, sample_point_id string, sample_point_type string, lat double, lon double")
    got = {r.event_id: (r.sample_point_id, r.assignment_method) for r in E.nearest_point(ev, pts).collect()}
    assert got == {1: ("p1", "nearest_point"), 2: ("c", "farm_centroid"), 3: (None, "missing_farm")}


def test_spot_checks_are_even_and_empty_columns_go(spark):
    df = spark.range(101).withColumn("none", F.lit(None).cast("int"))
    assert sorted(r.id for r in A.spot_checks(df, ["id"], 5).collect()) == [0, 25, 50, 75, 100]
    assert A.drop_empty_columns(df).columns == ["id"]


def test_surface_lists_unobserved_bins(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (None,)], "hs double")
    got = {(r.hs_left, r.rows, r.null_rows, r.outside_rows) for r in V.occupancy_surface(df, V.Surface((V.Axis("hs", (0, 1, 2)),))).collect()}
    assert got == {(0.0, 1, 1, 1), (1.0, 0, 1, 1)}


def test_no_group_is_in_two_folds(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 7)
    folds = M.assign_folds(df, "g", 3)
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert M.usable_features(["hs", "status_mean", "event_id", "tp"]) == ["hs", "tp"]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 2020, 1), ("b", 2021, 2)], "wind_farm string, year int, v int")
    root = str(tmp_path / "arc")
    files.write_archive(df, root)
    files.write_archive(df.union(spark.createDataFrame([("c", 2022, 3)], df.schema)), root, spark.read.parquet(root))
    assert spark.read.parquet(root).count() == 3
    assert files.read_archive(spark, root, df.filter("v = 1")).count() == 1
    with pytest.raises(Exception):
        files.write(df, root)
    m = str(tmp_path / "m")
    assert files.append_manifest(spark, m, df) == 1 and files.append_manifest(spark, m, df) == 2
    assert files.register(spark, {"good_view": {"path": root}, "lost": {"path": str(tmp_path / "no"), "required": False}}) == ["good_view"]
    assert "good_view" in files.views(spark)
    with pytest.raises(ValueError):
        files.register(spark, {"bad name": {"path": root}})


def test_surface_level_and_depths(spark):
    f = spark.createDataFrame([(at(0), 54.0, 7.0, 5.0, 1.0), (at(0), 54.0, 7.0, -0.5, 2.0)], "ts timestamp, grid_lat double, grid_lon double, depth double, u double")
    assert gridded.surface_level(f).first().u == 2.0
    p = spark.createDataFrame([("a", "p", 54.0, 7.0)], "wind_farm string, sample_point_id string, lat double, lon double")
    key = p.select(values.cache_key(F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon")).alias("key"))
    got = gridded.depth_assignment(p, key.withColumn("payload", F.lit('{"avg": null, "smoothed": -12.5}'))).first()
    assert (got.water_depth_m, got.depth_status) == (12.5, "ok")


def test_nearest_point_compares_places_once(spark):
    """20,000 events and 20,000 points at few places: pairs of them all would take minutes."""
    import time

    k = F.col("id")
    ev = spark.range(20_000).select(k.alias("event_id"), F.lit("a").alias("wind_farm"), F.when(k % 4 != 0, 54.0 + k % 5 * 0.01).alias("centroid_lat"), F.lit(7.0).alias("centroid_lon"))
    pts = spark.range(20_000).select(F.lit("a").alias("wind_farm"), F.format_string("p%05d", k).alias("sample_point_id"), F.when(k == 7, "farm_centroid").otherwise("turbine").alias("sample_point_type"), (54.0 + k % 5 * 0.01).alias("lat"), F.lit(7.0).alias("lon"))
    start = time.time()
    got = {(r.at, r.sample_point_id, r.assignment_method): r.n for r in E.nearest_point(ev, pts).groupBy(F.when(F.col("centroid_lat").isNotNull(), k5(F.col("event_id"))).alias("at"), "sample_point_id", "assignment_method").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(i, f"p0000{i}", "nearest_point"): 3000 for i in range(5)} | {(None, "p00007", "farm_centroid"): 5000}
    assert time.time() - start < 40


def test_station_roles_compare_places_once(spark):
    """20,000 stations and 20,000 points at few places: pairs of them all would take minutes."""
    import time

    from tidemark.operators import spacetime as W

    k = F.col("id")
    st = spark.range(20_000).select(k.alias("station"), (54.0 + k % 5 * 0.01).alias("lat"), F.lit(7.0).alias("lon"))
    pts = spark.range(20_000).select(F.lit("a").alias("wind_farm"), F.format_string("p%05d", k).alias("sample_point_id"), (54.0 + k % 5 * 0.01).alias("lat"), F.lit(7.0).alias("lon"))
    start = time.time()
    got = {(r.at, r.sample_point_id, r.km, r.role): r.n for r in W.station_roles(st, pts).groupBy(k5(F.col("station")).alias("at"), "sample_point_id", "km", "role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(i, f"p0000{i}", 0.0, "on_site"): 4000 for i in range(5)}
    assert time.time() - start < 40


def k5(c):
    return c % 5
