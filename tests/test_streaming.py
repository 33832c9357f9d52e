import datetime as dt
import os

import pytest

from tidemark.operators import pings as P
from tidemark.streaming import files, live

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "mmsi long, ts timestamp, lat double, lon double, sog double"


def run(spark, tmp_path, make, batches, name):
    """Feeds files one by one; returns what an append query of make(stream) wrote."""
    src = tmp_path / "in"
    src.mkdir()
    stream = live.new_files(spark, spark.createDataFrame([], SCHEMA).schema, str(src), 1)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for i, b in enumerate(batches):
            rows = [(m, T0 + dt.timedelta(minutes=t), lat, lon, s) for m, t, lat, lon, s in b]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src / f"b{i}"))
            for f in (src / f"b{i}").glob("part-*.parquet"):
                f.rename(src / f"{i}-{f.name}")
            q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


def test_sessions_close_as_in_batch(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 54.0, 7.0)], "found_id long, wind_farm string, latitude double, longitude double")
    first = [(1, m, 54.0, 7.0, 0.1) for m in (0, 10, 25, 56)]
    got = run(spark, tmp_path, lambda s: live.dwell_sessions(live.filtered(s, t), least_minutes=0), [first, [(2, 600, 54.0, 7.0, 0.1)], [(2, 601, 54.0, 7.0, 0.1)]], "s1")
    assert sorted((r.start, r.ping_count) for r in got if r.mmsi == 1) == [(T0, 3), (T0 + dt.timedelta(minutes=56), 1)]


def test_sessions_split_on_another_turbine_and_drop_short_ones(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 54.0, 7.0), (2, "a", 54.0004, 7.0)], "found_id long, wind_farm string, latitude double, longitude double")
    # 30 m from the first and 15 m from the second is the second's alone; order of arrival does not matter
    first = [(1, 20, 54.0, 7.0, 0.1), (1, 0, 54.0, 7.0, 0.1), (1, 30, 54.0003, 7.0, 0.1), (1, 50, 54.0003, 7.0, 0.1), (1, 55, 54.0, 7.0, 0.1)]
    batches = [first, [(2, 600, 54.0, 7.0, 0.1)], [(2, 601, 54.0, 7.0, 0.1)]]
    got = run(spark, tmp_path, lambda s: live.dwell_sessions(live.filtered(s, t)), batches, "s5")
    assert sorted((r.found_id, r.duration_min, r.ping_count) for r in got if r.mmsi == 1) == [(1, 20.0, 2), (2, 20.0, 2)]
    pings = spark.createDataFrame([(m, T0 + dt.timedelta(minutes=x), la, lo, s) for b in batches for m, x, la, lo, s in b], SCHEMA)
    batch = P.dwell_events(pings, t).collect()
    assert sorted((r.found_id, r.duration_min, r.ping_count) for r in batch) == [(1, 20.0, 2), (2, 20.0, 2)]


def test_late_rows_are_counted(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    for i, m in enumerate((0, 600, 601, 5)):
        spark.createDataFrame([(1, T0 + dt.timedelta(minutes=m), 54.0, 7.0, 1.0)], SCHEMA).coalesce(1).write.parquet(str(path / f"b{i}"))
        for f in (path / f"b{i}").glob("part-*.parquet"):
            f.rename(path / f"{i}-{f.name}")
    stream = live.new_files(spark, spark.createDataFrame([], SCHEMA).schema, str(path), 1)
    got, late = live.drain(live.hourly(stream, "sog"))
    assert late == 1 and [r.n for r in got.orderBy("hour").collect()][:1] == [1]


def test_duplicates_and_alerts(spark, tmp_path):
    batch = [(1, 0, 54.0, 7.0, 0.1), (1, 0, 54.0, 7.0, 0.1), (1, 10, 54.01, 7.0, 0.1)]
    got = run(spark, tmp_path, live.without_duplicates, [batch, [(1, 0, 54.0, 7.0, 0.1)]], "s2")
    assert len(got) == 2


def test_vessel_state_is_that_of_a_batch_whatever_the_files(spark, tmp_path):
    """Pings out of order, in several files and micro-batches; the last one moves the watermark on."""
    batches = [
        [(1, 30, 54.0, 7.0, 0.1), (1, 0, 54.0, 7.0, 0.1), (2, 5, 54.0, 7.0, 0.1)],
        [(1, 10, 56.0, 7.0, 0.1), (2, 5, 54.1, 7.0, 0.1), (1, 200, 54.0, 7.0, 0.1)],
        [(1, 155, 54.2, 7.0, 0.1), (2, 300, 54.0, 7.0, 0.1)],
        [(1, 900, 54.0, 7.0, 0.1)],
        [(3, 901, 54.0, 7.0, 0.1)],
    ]
    with live.keyed_state(spark):
        got = run(spark, tmp_path, live.vessel_state, batches, "s3")
    before, want = {}, []
    for m, t, lat in sorted((m, t, lat) for b in batches for m, t, lat, _, _ in b):
        if t < 841:
            p = before.get(m)
            hours = (t - p[0]) / 60 if p else 0
            knots = 60.04 * abs(lat - p[1]) / hours if p and 0 < hours <= 2 else None
            want.append((m, t, lat, knots, bool(knots and knots > 45)))
            before[m] = (t, lat)
    got = sorted((r.mmsi, (r.ts - T0).total_seconds() / 60, r.lat, r.implied_knots, r.alert) for r in got)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all((g[3] is None) == (w[3] is None) and (w[3] is None or abs(g[3] - w[3]) <= 0.002 * w[3]) for g, w in zip(got, want))
    assert sum(g[4] for g in got) == 2  # from 54 to 56 degrees and back in 10 and 20 minutes


#: Vessels on both sides of the edges of groups, one far off, one below zero, one without a number: five groups.
FLEET = [None, -1, *range(64), 2**40, 2**40 + 31]


def once(spark, tmp_path, make, rows, name):
    """Pings in two files, one run of the stream; its rows and the rows of state after each micro-batch."""
    spark.createDataFrame([(m, T0 + dt.timedelta(minutes=t), lat, lon, s) for m, t, lat, lon, s in rows], SCHEMA).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = live.new_files(spark, spark.createDataFrame([], SCHEMA).schema, str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect(), [p.stateOperators[0].numRowsTotal for p in q.recentProgress]


def test_vessels_of_neighbouring_numbers_share_a_row_of_state(spark, tmp_path):
    """Each vessel's speeds are its own, though a group of 32 is answered at once; the i-th vessel moves by i thousandths of a degree in ten minutes."""
    rows = [(m, 10 * k + i % 7, 54.0 + k * i / 1000, 7.0, 0.1) for i, m in enumerate(FLEET) for k in range(3)] + [(5, 900, 54.0, 7.0, 0.1)]
    with live.keyed_state(spark):
        got, state = once(spark, tmp_path, live.vessel_state, rows, "s7")
    assert state[0] == 5  # not one for each of 68 vessels
    assert len(got) == 3 * len(FLEET) and {r.mmsi for r in got} == set(FLEET)
    for i, m in enumerate(FLEET):
        own = sorted((r.ts, r.lat, r.implied_knots, r.alert) for r in got if r.mmsi == m)
        assert [r[:2] for r in own] == [(T0 + dt.timedelta(minutes=10 * k + i % 7), 54.0 + k * i / 1000) for k in range(3)]
        assert own[0][2:] == (None, False)
        assert all(abs(r[2] - 60.04 * i / 1000 * 6) <= 0.002 * max(r[2], 1) and r[3] == (i * 0.36024 > 45) for r in own[1:])


def test_sessions_of_vessels_of_neighbouring_numbers_are_their_own(spark, tmp_path):
    """One row of state for a group of up to 32 vessels, sessions as in a batch: gaps, another turbine, two pings at a time."""
    t = spark.createDataFrame([(1, "a", 54.0, 7.0), (2, "a", 54.0004, 7.0)], "found_id long, wind_farm string, latitude double, longitude double")
    rows = [(m, x + i % 5, 54.0003 if (x // 20 + i) % 4 == 0 else 54.0, 7.0, (x % 7) / 20) for i, m in enumerate(FLEET) for x in range(0, 200, 4 + i % 9) if not 80 < x < 80 + i]
    rows += [(m, x, 54.0003, 7.0, 0.3) for m, x, lat, _, _ in rows if x % 3 == 0 and lat == 54.0]
    got, state = once(spark, tmp_path, lambda s: live.dwell_sessions(live.filtered(s, t)), [*rows, (5, 900, 54.0, 7.0, 0.1)], "s8")
    assert state[0] == 5  # not one for each of 68 vessels
    batch = P.dwell_events(spark.createDataFrame([(m, T0 + dt.timedelta(minutes=x), la, lo, s) for m, x, la, lo, s in rows], SCHEMA), t).collect()
    own = lambda rs: sorted((str(r.mmsi), r.start, r.end, r.found_id, r.ping_count, round(r.mean_sog, 9), round(r.min_dist, 6), r.duration_min) for r in rs)
    assert len(batch) > 100 and {r.mmsi for r in batch} == {r.mmsi for r in got} and own(got) == own(batch)


def test_a_batch_that_fails_after_its_write_is_written_once(spark, tmp_path):
    src, root, log = (str(tmp_path / d) for d in ("in", "root", "log"))
    df = spark.range(90).selectExpr("id", "id % 3 as k")
    df.repartition(3).write.parquet(src)
    stream = lambda: live.new_files(spark, df.schema, src, 1)

    def fail(batch):
        if batch == 1:
            raise RuntimeError("the power went out")

    with pytest.raises(Exception, match="the power went out"):
        files.sink_once(stream(), root, log, fail).awaitTermination()
    assert (tmp_path / "root" / "data" / "batch_id=1").exists()
    assert files.committed(spark, root, df.schema).count() == 30  # batch 1 lies there and isn't committed
    files.sink_once(stream(), root, log).awaitTermination()
    assert sorted(r.id for r in files.committed(spark, root, df.schema).collect()) == list(range(90))
    before = sorted(p.name for p in (tmp_path / "root" / "ledger").glob("part-*"))
    files.sink_once(stream(), root, str(tmp_path / "new")).awaitTermination()  # every batch again
    assert sorted(p.name for p in (tmp_path / "root" / "ledger").glob("part-*")) == before
    assert sorted(r.id for r in files.committed(spark, root, df.schema).collect()) == list(range(90))


def test_only_stable_and_complete_files_are_consolidated(spark, tmp_path):
    folder, root = tmp_path / "cache", str(tmp_path / "out")
    folder.mkdir()

    def put(kind, place, text="x\n1\n", age=1000):
        f = folder / f"{kind}_{place}_2024.csv"
        f.write_text(text)
        os.utime(f, (1_700_000_000 - age,) * 2)

    for place in "abcde":
        put("wave", place), put("wind", place)
    put("wave", "f"), put("wind", "g"), put("wave", "h"), put("wind", "h", age=30), put("wave", "i"), put("wind", "i", text="")
    read = lambda s, paths: s.read.option("header", True).csv([p for own in paths.values() for p in own])
    go = lambda now=1_700_000_000, **o: files.consolidate_folder(spark, str(folder), r"^(wave|wind)_(\w)_(\d+)\.csv$", ["kind", "place", "year"], "kind", ["wave", "wind"], root, read, 120, now, batch_size=2, **o)
    assert go(max_batches=1) == {"eligible": 5, "already": 0, "fresh": 1, "incomplete": 3, "written": 2, "batches": 1}
    assert go() == {"eligible": 5, "already": 2, "fresh": 1, "incomplete": 3, "written": 3, "batches": 2}
    assert go() == {"eligible": 5, "already": 5, "fresh": 1, "incomplete": 3, "written": 0, "batches": 0}
    assert go(1_700_000_200) == {"eligible": 6, "already": 5, "fresh": 0, "incomplete": 3, "written": 1, "batches": 1}
    sets = files.ledger(spark, root, "place string, year string, batch_id long").collect()
    assert sorted((r.place, r.batch_id) for r in sets) == [("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3), ("h", 4)]
    assert files.committed(spark, root, "x string, batch_id int", "batch_id long").count() == 12
    with pytest.raises(ValueError):
        files.consolidate(None, root, [], read, 0)


def test_hourly_means(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: live.hourly(s, "sog"), [[(1, 0, 54.0, 7.0, 1.0), (1, 30, 54.0, 7.0, 3.0)], [(1, 300, 54.0, 7.0, 1.0)], [(1, 301, 54.0, 7.0, 1.0)]], "s4")
    assert [(r.hour, r.mean, r.n) for r in got][:1] == [(T0, 2.0, 2)]
    assert P.event_class is not None
