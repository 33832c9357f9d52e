"""Gates that fail, layouts, splines and sums against plain versions, and awkward small frames."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.values import normal_name
from tidemark.operators import evidence as E
from tidemark.operators import matrix as X
from tidemark.operators import models as U
from tidemark.operators import reports as Q
from tidemark.operators import spacetime as W
from tidemark.operators import stats as S
from tidemark.plans import lineage
from tidemark.sources import files, gridded

T0 = dt.datetime(2024, 1, 1)


def at(h):
    return T0 + dt.timedelta(hours=h)


def plain_spline(x, y, t):
    """Not-a-knot by solving for each interval's polynomial: values, slopes and curvatures meet, and third derivatives at the ends."""
    n = len(x) - 1
    a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
    row = 0
    for i in range(n):
        h = x[i + 1] - x[i]
        a[row, 4 * i], b[row] = 1, y[i]
        a[row + 1, 4 * i : 4 * i + 4], b[row + 1] = [1, h, h**2, h**3], y[i + 1]
        row += 2
        if i < n - 1:
            a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 5] = [0, 1, 2 * h, 3 * h**2], -1
            a[row + 1, 4 * i : 4 * i + 4], a[row + 1, 4 * i + 6] = [0, 0, 2, 6 * h], -2
            row += 2
    for i, j in ((0, 1), (n - 2, n - 1)):
        a[row, 4 * i + 3], a[row, 4 * j + 3] = 1, -1
        row += 1
    c = np.linalg.solve(a, b).reshape(n, 4)
    i = np.clip(np.searchsorted(x, t, "right") - 1, 0, n - 1)
    d = t - x[i]
    return c[i, 0] + c[i, 1] * d + c[i, 2] * d**2 + c[i, 3] * d**3


def test_spline_is_not_a_knot_across_months(spark):
    rng = np.random.default_rng(1)
    hours = np.arange(24 * 20, 24 * 41)
    y = rng.normal(size=len(hours))
    df = spark.createDataFrame([("p", at(int(h)), float(v)) for h, v in zip(hours, y)], "k string, ts timestamp, v double")
    got = X.spline(df, "k", "v").orderBy("ts").collect()
    t = np.array([(r.ts - T0).total_seconds() / 3600 for r in got])
    assert len(got) == (len(hours) - 1) * 6 + 1 and np.abs(np.array([r.v for r in got]) - plain_spline(hours.astype(float), y, t)).max() < 1e-9
    three = spark.createDataFrame([("p", at(h), float(h * h)) for h in (0, 1, 3)], "k string, ts timestamp, v double")
    assert all(abs(r.v - ((r.ts - T0).total_seconds() / 3600) ** 2) < 1e-9 for r in X.spline(three, "k", "v").collect())


def test_upscale_clips_to_events_and_turns_the_shorter_way(spark):
    hourly = spark.createDataFrame([("p", at(h), float(h), d) for h, d in ((0, 350.0), (1, 10.0), (2, 30.0))], "k string, ts timestamp, hs double, dir double")
    events = spark.createDataFrame([(7, "p", at(0.5), at(1.5)), (8, "q", at(0), at(1))], "event_id long, k string, start timestamp, end timestamp")
    got = {(r.event_id, r.ts): (r.hs, r.dir) for r in X.upscale(hourly, events, "k", ["hs"], ["dir"]).collect()}
    assert len([k for k in got if k[0] == 7]) == 7 and abs(got[7, at(0.5)][0] - 0.5) < 1e-9 and min(got[7, at(0.5)][1], 360 - got[7, at(0.5)][1]) < 1e-6
    assert all(v == (None, None) for k, v in got.items() if k[0] == 8)


def test_running_counts_over_many_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 3 else "b", float(i), int(rng.integers(5))) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(7)
    got = {(r.g, r.v): r.run_n for r in S.running_counts(df, ["g"], "v", ["n"]).collect()}
    for g in "ab":
        own = sorted(r for r in rows if r[0] == g)
        assert [got[g, v] for _, v, _ in own] == np.cumsum([n for *_, n in own]).tolist()


def test_rows_before_across_partitions(spark):
    rows = [(i % 2, i, f"v{i}") for i in range(200)]
    got = S.previous(spark.createDataFrame(rows, "k long, i long, v string"), ["k"], "i", ["v"]).collect()
    assert {r.i: r.before and r.before.v for r in got} == {i: f"v{i - 2}" if i > 1 else None for i in range(200)}


def test_layouts_with_mark_and_other_header_orders(spark, tmp_path):
    texts = {
        "a.csv": "﻿MMSI,# Timestamp,Longitude,Latitude,SOG\n1,01/01/2024 00:00:00,7.5,54.5,0.1\n",
        "b.csv": "time;lat;lon;mmsi\n2024-01-01 00:00:00;54,25;7,25;2\n",
        "c.csv": ",".join(["01/01/2024 00:10:00", "Class A", "3", "54.0", "7.0", *[""] * 17]) + "\n",
        "d.csv": ",".join(["01/01/2024 00:20:00", "Class A", "4", "54.0", "7.0", *[""] * 12]) + "\n",
        "e.csv": ",".join(["01/01/2024 00:30:00", "Class A", "5", "54.0", "7.0", *[""] * 20]) + "\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = {os.path.basename(r.file): (r.sep, r.header) for r in files.layouts(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": (",", True), "b.csv": (";", True), "c.csv": (",", False), "d.csv": (",", False), "e.csv": (",", False)}
    from tidemark.operators.pings import typed

    got = {r.mmsi: (r.lat, r.lon, r.ts) for r in typed(files.read_drifting(spark, str(tmp_path))).collect()}
    assert got == {1: (54.5, 7.5, T0), 2: (54.25, 7.25, T0), **{k: (54.0, 7.0, T0 + dt.timedelta(minutes=10 * (k - 2))) for k in (3, 4, 5)}}


def test_only_absent_sources_are_optional(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("not parquet")
    assert files.register(spark, {"t_absent": {"path": str(tmp_path / "none"), "required": False}}) == []
    with pytest.raises(Exception):
        files.register(spark, {"t_bad": {"path": str(tmp_path / "bad.parquet"), "required": False}})


def test_names_keep_letters_apart(spark):
    names = ["Rødsand", "Rdsand", "Kårehamn", "Strauß", "Stra", "Æbelø"]
    got = [r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select(normal_name(F.col("n")).alias("k")).collect()]
    assert got == ["rodsand", "rdsand", "karehamn", "strauss", "stra", "aebelo"]


def test_gates_fail_in_tasks(spark):
    made_up = spark.createDataFrame([("fallback_mean", 1.0), ("real", 2.0)], "provenance string, current_speed double")
    with pytest.raises(Exception, match="."):
        E.provenance_gate(made_up).collect()
    assert E.provenance_gate(made_up.filter("provenance = 'real'")).count() == 1
    t = spark.createDataFrame([(1, "a", 54.0, 7.0), (2, "a", 54.1, 7.0)], "found_id long, wind_farm string, latitude double, longitude double")
    points = gridded.site_points(t)
    assert gridded.check_site_points(points, t).count() == 3
    for wrong in (points.limit(2), points.unionByName(points.limit(1)), points.withColumn("wind_farm", F.lit("b"))):
        with pytest.raises(Exception, match="farm|point"):
            gridded.check_site_points(wrong, t).collect()


def test_auc_with_ties_and_one_class(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 20
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    r = Q.roc_pr_auc(df, "y", "s").first()
    p, n = s[y == 1], s[y == 0]
    want = ((p[:, None] > n[None]).sum() + (p[:, None] == n[None]).sum() / 2) / (len(p) * len(n))
    assert abs(r.roc_auc - want) < 1e-12 and 0 < r.average_precision < 1
    assert Q.roc_pr_auc(df.filter("y = 1"), "y", "s").first().roc_auc is None


def test_row_level_folds_flatter(spark):
    """Rows of a group are near copies, so a model that meets the group's other rows does better on them."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(40):
        y, x = int(rng.integers(2)), rng.normal(size=4)
        rows += [(g, g * 10 + i, float(y), *(float(v) for v in x + 0.01 * rng.normal(size=4))) for i in range(8)]
    df = spark.createDataFrame(rows, "g long, id long, y double, a double, b double, c double, d double")
    fold = U.assign_folds(df, "g", 3).select("g", "fold").distinct().collect()
    assert len(fold) == 40 and {r.fold for r in fold} == {0, 1, 2}
    got = {r.model: r.roc_auc for r in U.compare(df, ["a", "b", "c", "d"], "y", "g", "id").collect()}
    assert got.keys() == {"majority", "logistic", "forest", "logistic_row_level"} and got["logistic_row_level"] > got["logistic"]


def test_event_field_reasons(spark):
    field = spark.createDataFrame([(at(0), 54.0, 7.0, 1.0, None, 5.0), (at(0), 54.2, 7.2, 2.0, 6.0, 5.0), (at(6), 54.2, 7.2, None, 6.0, 5.0)], "ts timestamp, grid_lat double, grid_lon double, hs double, tp double, tm double")
    events = [(1, 54.01, 7.0, at(0), at(1)), (2, None, 7.0, at(0), at(1)), (3, 54.0, 7.0, at(1), at(0)), (4, 60.0, 7.0, at(0), at(1)), (5, 54.2, 7.2, at(3), at(3)), (6, 54.2, 7.2, at(6), at(6)), (7, 54.1, 7.1, at(0), at(0))]
    df = spark.createDataFrame(events, "event_id long, lat double, lon double, start timestamp, end timestamp")
    got = {r.event_id: (r.hs, r.tp, r.period_field, r.missing_reason) for r in W.event_field(df, field, max_km=5.0).collect()}
    assert got[1] == (1.0, 5.0, "tm", None)
    assert [got[k][3] for k in range(2, 8)] == ["no_place", "bad_window", "outside_grid", "no_time_in_tolerance", "no_value", "no_cell_in_reach"]


def test_zones_by_hull(spark):
    """A square of four turbines 2 km apart: zones follow the square, not the turbines."""
    from tidemark.operators.farms import hull_zones

    m = 1 / 111195
    k = float(1 / np.cos(np.radians(54.0)))
    t = spark.createDataFrame([(i, "a", 54.0 + y * m, 7.0 + x * m * k) for i, (x, y) in enumerate([(0, 0), (2000, 0), (2000, 2000), (0, 2000)])], "found_id long, wind_farm string, latitude double, longitude double")
    places = {"asset": (100, 100), "middle": (1000, 1000), "edge": (1000, -400), "beyond": (1000, -700), "far": (-5200, 1000), "none": (30_000, 0)}
    p = spark.createDataFrame([(n, 54.0 + y * m, 7.0 + x * m * k) for n, (x, y) in places.items()], "n string, lat double, lon double")
    got = {r.n: (r.zone, round(r.hull_m, -1)) for r in hull_zones(p, t).collect()}
    assert got == {"asset": ("asset", 0), "middle": ("farm", 0), "edge": ("farm", 400), "beyond": ("context", 700), "far": (None, 5200)}


def test_tables_of_a_block_go_with_it(spark):
    with lineage.spent(spark):
        path = lineage.scratch(spark)
        spark.range(3).write.parquet(path)
        assert lineage.cut(spark.range(5)).count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_empty_tables_give_empty_reports(spark):
    d = spark.createDataFrame([], "dwell_id long, mmsi long, wind_farm string, dwell_tier string, duration_min double, duplicate_group_id long, hs double, ring string, events long, years double")
    assert Q.atlas(d, ["A"]).count() == 0 and Q.exposure_comparison(d, [1]).count() == 0 and Q.outliers(d, "hs").count() == 0
    r = Q.threshold_counts(d, "hs", [1.0], {"all": F.lit(True)}).first()
    assert (r.rows, r.above, r.above_share) == (0, 0, None)


def test_observatory_rounds_evidence_by_exact_value(spark):
    """12.25 and 2.25 are ties that go to even; 45.65 and 42.35 lie just beside what they are written as."""
    from tidemark.operators.audit import observatory

    columns = "wind_farm string, year long, month long, target boolean, operational boolean, manifest_status string, raw_status string, raw_mb double, filtered_status string, filtered_rows long, visits_status string, visits long, dwells_status string, dwells long, tier_d long, duplicates long, weather_status string, weather_rows long, weather_missing double"
    row = ("a", 2024, 1, True, True, None, "exists", 1.0, "exists", 1, "exists", 4, "exists", 9, 0, 0, "joined", 1)
    df = spark.createDataFrame([(*row, 0.4565), (*row[:2], 2, *row[3:13], 2000, 1225, 847, *row[16:], 0.0)], columns)
    got = {(r.month, r.type): r.evidence for r in observatory(df).collect()}
    assert got == {(1, "many_dwells_a_visit"): f"{9 / 4:.1f}", (1, "weather_gaps"): f"{0.4565 * 100:.1f}%", (2, "many_dwells_a_visit"): "500.0", (2, "many_duplicates"): f"{847 / 2000 * 100:.1f}%", (2, "many_tier_d"): f"{1225 / 2000 * 100:.1f}%"}
    assert got[1, "many_dwells_a_visit"] == "2.2" and got[2, "many_tier_d"] == "61.3%"
