import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import evidence as E
from tidemark.operators import farms as M
from tidemark.operators import matrix as X
from tidemark.operators import stats as S

T0 = dt.datetime(2024, 1, 31, 20)


def test_hull_and_distance(spark):
    rows = [(i, "a", lat, lon) for i, (lat, lon) in enumerate([(54.0, 7.0), (54.0, 7.1), (54.1, 7.1), (54.1, 7.0), (54.05, 7.05)])] + [(9, "b", 55.0, 8.0), (10, "c", None, 8.0)]
    h = M.hulls(spark.createDataFrame(rows, "found_id int, wind_farm string, latitude double, longitude double"))
    got = {r.wind_farm: len(r.hull) for r in h.collect()}
    assert got == {"a": 4, "b": 1}
    at = h.select("wind_farm", M.hull_distance(F.lit(54.05), F.lit(7.05)).alias("d"), M.hull_distance(F.lit(53.99), F.lit(7.05)).alias("e"), M.hull_distance(F.lit(55.01), F.lit(8.0)).alias("f"))
    d = {r.wind_farm: r for r in at.collect()}
    assert d["a"].d == 0 and abs(d["a"].e - 1112) < 5 and abs(d["b"].f - 1112) < 5


def test_spline_meets_knots_and_a_month_edge(spark):
    knots = [("p", T0 + dt.timedelta(hours=h), float(np.sin(h / 2))) for h in range(9)]
    df = spark.createDataFrame(knots, "k string, ts timestamp, v double")
    got = {r.ts: r.v for r in X.spline(df, "k", "v").collect()}
    assert len(got) == 8 * 6 + 1
    for _, ts, v in knots:
        assert abs(got[ts] - v) < 1e-9
    mid = T0 + dt.timedelta(hours=2, minutes=30)
    assert abs(got[mid] - np.sin(1.25)) < 0.03
    one = spark.createDataFrame([("p", T0, 1.0)], "k string, ts timestamp, v double")
    assert [r.v for r in X.spline(one, "k", "v").collect()] == [1.0]


def test_recommendations(spark):
    fy = spark.createDataFrame([("a", 2020, 50, 9, 30.0, True), ("b", 2020, 5, 9, 30.0, True), ("c", 2020, 50, 9, 3.0, False)], "wind_farm string, year int, events int, valid_waves int, median_depth double, in_domain boolean")
    got = {r.wind_farm: (r.recommendation, r.reason) for r in M.recommend(fy).collect()}
    assert got == {"a": ("yes", ""), "b": ("stress_test_only", "few_events"), "c": ("no", "outside_domain; shallow")}
    assert [r.wind_farm for r in M.top_recommended(M.recommend(fy), 5).collect()] == ["a"]


def test_best_power_curve(spark):
    binned = spark.createDataFrame([("x", w + 0.25, (w + 0.25) / 25) for w in np.arange(4, 20, 0.5).tolist()], "asset string, wind double, power double")
    curves = spark.createDataFrame([("flat", 0.0, 0.5), ("flat", 30.0, 0.5), ("line", 0.0, 0.0), ("line", 25.0, 1.0)], "curve string, wind double, power double")
    r = S.best_curve(binned, curves, "asset").first()
    assert r.curve == "line" and r.mae < 1e-9 and r.bins == 32


def test_wind_and_current_classes(spark):
    c, why = E.wind_confidence(F.col("s"), F.col("a"), F.col("b"))
    df = spark.createDataFrame([(1, 5.0, 0.6, 0.8), (2, 5.0, None, None), (3, 90.0, 0.6, 0.8), (4, None, 0.6, 0.8)], "i int, s double, a double, b double")
    assert [(r.c, r.w) for r in df.orderBy("i").select(c.alias("c"), why.alias("w")).collect()] == [("A", None), ("B", "wind_direction_missing"), ("C", "wind_speed_out_of_range"), ("D", "wind_speed_missing")]


def test_grid_plans_and_sites(spark):
    from tidemark.sources import gridded as G

    field = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h), 54.0, 7.0, 1.0, None) for h in range(3)], "wind_farm string, ts timestamp, grid_lat double, grid_lon double, hs double, tp double")
    points = spark.createDataFrame([("a", "p1"), ("a", "p2")], "wind_farm string, sample_point_id string")
    none = spark.createDataFrame([], "wind_farm string, year int")
    r = G.materialization_plan(field, points, none, ["hs", "tp"]).first()
    assert (r.state, r.present, r.missing, r.expected_rows, r.step_h, r.years) == ("blocked_missing_variables", ["hs"], ["tp"], 6, 1.0, [2024])
    assert G.materialization_plan(field, points, none, ["hs"]).first().state == "ready"
    assert G.materialization_plan(field, points, spark.createDataFrame([("a", 2024)], "wind_farm string, year int"), ["hs"]).first().state == "done"
    assert [r.hs for r in G.blocked_rows(points, "nws", 2020, "no source", ["hs"]).collect()] == [None, None]
    files = spark.createDataFrame([("s_54.01_7.01_2024_02.csv",), ("s_54.01_7.01_2023_12.csv",), ("other",)], "file string")
    t = spark.createDataFrame([("a", 54.0, 7.0), ("b", 60.0, 7.0)], "wind_farm string, latitude double, longitude double")
    s = G.candidate_sites(files, t).collect()
    assert [(r.nearest_farm, r.months) for r in s] == [("a", ["2023-12", "2024-02"])]
    series = G.point_series(field, points.limit(1).selectExpr("wind_farm", "sample_point_id", "54.0D as grid_lat", "7.0D as grid_lon", "1.0D as km", "'nearest_valid_grid' as match_status").drop("wind_farm").withColumn("wind_farm", F.lit("a")))
    assert series.count() == 3
    assert G.valid_cells(field, "hs").count() == 1 and G.valid_cells(field, "tp").count() == 0


def test_events_without_a_group_are_spread(spark):
    """Rows with a null group must not meet in one task."""
    from tidemark.operators.intensity import duplicate_weight

    df = spark.range(3000).selectExpr("id", "if(id % 5 = 0, id div 50, null) as duplicate_group_id", "if(id % 2 = 0, 'a', 'b') as wind_farm")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = duplicate_weight(df)
        assert "__spread" in "".join(x.split("),")[0] for x in out._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:])
        assert {(r.wind_farm, r.weight) for r in out.filter("id % 5 != 0").collect()} == {("a", 1.0), ("b", 1.0)}
        assert {r.weight for r in out.filter("id % 5 = 0").collect()} == {0.5}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
