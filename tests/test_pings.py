import math
from collections import Counter
import datetime as dt

import pytest

from tidemark.operators import pings as P
from tidemark.sources import files

T0 = dt.datetime(2024, 1, 1)
TURBINES = "found_id long, wind_farm string, latitude double, longitude double"
PINGS = "mmsi long, ts timestamp, lat double, lon double, sog double"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture()
def turbines(spark):
    return spark.createDataFrame([(1, "a", 54.0, 7.0), (2, "a", 54.0005, 7.0), (3, "b", 55.0, 8.0)], TURBINES)


def test_nearest_turbine_is_kept_and_the_limit_is_strict(spark, turbines):
    p = spark.createDataFrame([(1, at(0), 54.0002, 7.0, 0.1), (2, at(0), 54.01, 7.0, 0.1), (3, at(0), None, 7.0, 0.1)], PINGS)
    all_ = P.match_turbines(P.stationary(p), turbines)
    assert {(r.mmsi, r.found_id) for r in all_.collect()} == {(1, 1), (1, 2)}
    assert [(r.mmsi, r.found_id) for r in P.nearest_only(all_).collect()] == [(1, 1)]


def test_gaps_and_changes_of_turbine_split_and_short_events_go(spark, turbines):
    minutes = [0, 10, 25, 56, 57]  # 31 minutes split; the second part is too short
    p = spark.createDataFrame([(1, at(m), 54.0, 7.0, 0.1) for m in minutes], PINGS)
    (e,) = P.dwell_events(p, turbines).collect()
    assert (e.start, e.end, e.ping_count, e.duration_min, e.event_class) == (at(0), at(25), 3, 25.0, "Transfer")
    exact = spark.createDataFrame([(1, at(m), 54.0, 7.0, 0.1) for m in (0, 30)], PINGS)
    assert P.dwell_events(exact, turbines).count() == 1
    moved = spark.createDataFrame([(1, at(m), lat, 7.0, 0.1) for m, lat in ((0, 54.0), (16, 54.0), (20, 54.0005), (40, 54.0005))], PINGS)
    assert [r.found_id for r in P.dwell_events(moved, turbines).orderBy("start").collect()] == [1, 2]


def test_no_nested_loop_in_the_ping_match(spark, turbines):
    p = spark.createDataFrame([(1, at(0), 54.0, 7.0, 0.1)], PINGS)
    plan = P.dwell_events(p, turbines)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rejects_count_the_first_rule(spark):
    p = spark.createDataFrame([(1, at(0), 54.0, 7.0, 0.1), (1, at(1), None, 7.0, 9.0), (1, at(2), 60.0, 7.0, 9.0), (1, at(3), 54.0, 7.0, None), (1, at(4), 54.0, 7.0, 3.0)], PINGS)
    r = P.reject_counts(p, box=(53, 55, 6, 8), max_sog=2.0).first()
    assert (r.seen, r.kept, r.bad_lat_lon, r.outside_region, r.bad_sog, r.above_max_sog, r.retention_pct) == (5, 1, 1, 1, 1, 1, 20.0)


def test_boxes_keep_a_ping_once(spark, turbines):
    boxes = P.farm_boxes(turbines, 2.0).unionByName(P.farm_boxes(turbines, 3.0))
    p = spark.createDataFrame([(1, at(0), 54.03, 7.0, 0.1), (2, at(0), 57.0, 7.0, 0.1)], PINGS)
    assert [r.mmsi for r in P.in_any_box(p, boxes).collect()] == [1]


def test_text_rows_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# Timestamp;MMSI;Latitude;Longitude;SOG;Name\n01/02/2024 03:04:05;12;54,5;7.25;0,4;X\nbad;x;y;;;\n")
    (tmp_path / "b.csv").write_text(",".join(["01/02/2024 03:04:05", "Class A", "13", "54.0", "7.0", "s", "0", "0.2", *[""] * 14]) + "\n")
    raw = files.read_layouts(spark, [{"path": str(tmp_path / "a.csv"), "sep": ";"}, {"path": str(tmp_path / "b.csv"), "header": False}])
    rows = P.typed(raw).orderBy("mmsi").collect()
    assert [(r.mmsi, r.lat, r.sog) for r in rows] == [(None, None, None), (12, 54.5, 0.4), (13, 54.0, 0.2)]
    assert rows[1].ts == dt.datetime(2024, 2, 1, 3, 4, 5)
    with pytest.raises(ValueError):
        files.rename(spark.createDataFrame([(1,)], "x int"))


def test_tiers(spark, turbines):
    p = spark.createDataFrame([(1, at(m), 54.0, 7.0, 0.5) for m in (0, 10, 21)] + [(2, at(m), 54.02, 7.0, 0.5) for m in (0, 15, 31)], PINGS)
    assert {(r.mmsi, r.dwell_tier) for r in P.tiered_dwells(p, turbines).collect()} == {(1, "A"), (2, "D")}
    assert P.farm_visits(p, turbines).count() == 2


def test_matches_beyond_63_degrees_and_at_the_date_line(spark):
    places = [(1, 54.0, 7.0), (2, 70.0, 20.0), (3, 84.0, 20.0), (4, -70.0, 179.9999), (5, 0.0, -180.0)]
    turbines = spark.createDataFrame([(k, "a", la, lo) for k, la, lo in places], "found_id long, wind_farm string, latitude double, longitude double")
    metre = 1 / 111195
    rows = [(k, la, ((lo + m * metre / math.cos(math.radians(la))) + 180) % 360 - 180) for k, la, lo in places for m in (-95, -60, 0, 60, 95)]
    df = spark.createDataFrame(rows, "mmsi long, lat double, lon double")
    for match in (P.match_turbines, P.match_nearest):
        got = Counter(r.found_id for r in match(df, turbines).collect())
        assert got == {k: 5 for k, *_ in places}
