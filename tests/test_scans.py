"""Scans by range partitions, lag scans and rank statistics against plain versions."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lags, matrix, scan, stats, timejoin

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


@pytest.fixture(params=[1, 5])
def parts(request, spark):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def plain_bracket(start, end, samples):
    """samples: sorted (time, value or None)."""
    if start is None or end is None or end < start:
        return None, 0, False, None, "not_assigned", 1.0, "no_assignable_samples"
    mid = start + (end - start) / 2
    gap = min((abs((t - mid).total_seconds()) / 60 for t, _ in samples), default=None)
    inside = [v for t, v in samples if start <= t <= end]
    before, after = [t for t, _ in samples if t <= start], [t for t, _ in samples if t >= end]
    pair = bool(before and after)
    mean = lambda x: sum(x) / len(x) if x else None
    full = lambda t: [v for s, v in samples if s == t and v is not None]
    if inside:
        method, taken, value = "window", inside, mean([v for v in inside if v is not None])
    elif pair:
        edges = {before[-1], after[0]}
        method, taken = "bracket", [v for t, v in samples if t in edges]
        value = mean([m for t in (before[-1], after[0]) if (m := mean(full(t))) is not None])
    else:
        method, taken, value = "not_assigned", [], None
    missing = sum(v is None for v in taken) / len(taken) if taken else 1.0
    why = "no_assignable_samples" if not taken else "values_missing" if missing == 1 else "values_partially_missing" if missing > 0.05 else None
    return value, len(inside), pair, gap, method, missing, why


def test_brackets_at_any_distance(spark, parts):
    rng = np.random.default_rng(1)
    samples = [("a", T0 + int(h) * HOUR, None if rng.random() < 0.15 else float(rng.integers(0, 9))) for h in np.r_[rng.integers(0, 60, 40), rng.integers(3000, 3030, 30), 9000]]
    samples += [("b", T0 + 5 * HOUR, 1.0), (None, T0, 1.0), ("a", None, 1.0)]
    events = []
    for i in range(120):
        s = T0 + int(rng.integers(-50, 9100) if i % 2 else rng.integers(0, 60)) * HOUR
        events.append((i, ["a", "b", "c"][i % 3 if i % 4 else 0], s, s + int(rng.integers(-1, 30)) * HOUR if i % 9 else None))
    events += [(500, None, T0, T0 + HOUR), (501, "a", T0 + 100 * HOUR, T0 + 101 * HOUR), (502, "a", T0 + 100 * HOUR, T0 + 100 * HOUR)]
    e = spark.createDataFrame(events, "event_id long, k string, start timestamp, end timestamp")
    got = timejoin.bracketed(e, spark.createDataFrame(samples, "k string, ts timestamp, v double"), ["k"], "v").collect()
    assert len(got) == len(events)
    own = {k: sorted(((t, v) for c, t, v in samples if c == k and t), key=lambda x: x[0]) for k in "abc"}
    for r in got:
        _, k, s, t = next(x for x in events if x[0] == r.event_id)
        want = plain_bracket(s if k else None, t, own.get(k, []))
        assert tuple(r)[2:4] == want[1:3] and tuple(r)[5] == want[4] and r.missing_reason == want[6], (r, want)
        for x, y in ((r.value, want[0]), (r.gap_min, want[3]), (r.missing_fraction, want[5])):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), (r, want)
    assert next(r for r in got if r.event_id == 501).method == "bracket"  # months lie between


def test_segments_and_islands_of_one_key_over_many_partitions(spark, parts):
    rng = np.random.default_rng(2)
    minutes = np.cumsum(rng.choice([1, 2, 40], 300, p=[0.5, 0.4, 0.1]))
    rows = [(1 if i % 10 else None, T0 + dt.timedelta(minutes=int(m)), "xy"[int(rng.random() < 0.05)]) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, s string").repartition(7)
    got = sorted((r.k or 0, r.ts, r.s, r.n) for r in scan.segments(df, ["k"], ["ts", "s"], lambda b: (F.unix_seconds("ts") - F.unix_seconds(b["ts"]) > 1200) | (F.col("s") != b["s"]), "n").collect())
    want = []
    for k in (1, None):
        n, before = 0, None
        for _, t, s in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]):
            n += before is None or (t - before[0]).total_seconds() > 1200 or s != before[1]
            before = (t, s)
            want.append((k or 0, t, s, n))
    assert got == sorted(want)
    spans = timejoin.islands(df, ["k"], "ts", 1200).collect()
    assert sum(r.rows for r in spans) == 300 and all(r.first <= r.last for r in spans)
    assert scan.placed(df, ["k"], ["ts"]).select("__part").distinct().count() == parts


def test_scan_carries_over_empty_partitions(spark, parts):
    rows = [("a", i, float(i) if i in (3, 50) else None) for i in range(80)] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = {(r.k, r.t): (r.p, r.n, r.s) for r in scan.scan(df, ["k"], ["t"], last={"p": F.col("v")}, first={"n": F.col("v")}, sums={"s": F.col("t")}).collect()}
    for i in range(80):
        assert got["a", i] == (None if i < 3 else 3.0 if i < 50 else 50.0, 3.0 if i <= 3 else 50.0 if i <= 50 else None, i * (i + 1) // 2)
    assert got["b", 0] == (None, None, 0)


def test_interpolation_between_far_knots(spark, parts):
    knots = [("a", T0 + h * HOUR, v, m) for h, v, m in ((0, 1.0, None), (10, 3.0, "x"), (500, None, None), (1000, 102.0, "y"))]
    places = [("a", T0 + h * HOUR) for h in (-1, 0, 5, 10, 505, 1000, 1001)]
    got = timejoin.interpolate(spark.createDataFrame(places, "k string, ts timestamp"), spark.createDataFrame(knots, "k string, ts timestamp, v double, m string"), ["k"], ["v"], ["m"])
    got = [(r.v, r.m) for r in got.orderBy("ts").collect()]
    assert got == [(None, "x"), (1.0, "x"), (2.0, "x"), (3.0, "x"), (3.0 + 99 * 495 / 990, "x"), (102.0, "y"), (None, "y")]


def test_no_frame_is_open_ahead(spark):
    df = spark.range(10).selectExpr("id as t", "id % 2 as k", "cast(id as double) as v")
    plan = scan.scan(df, ["k"], ["t"], first={"n": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


# ---- lags


def plain_lags(x, y, least):
    out = []
    for lag in range(min(y) - max(x), max(y) - min(x) + 1):
        both = [(v, y[h + lag]) for h, v in x.items() if h + lag in y]
        if len(both) >= least:
            a, b = np.array(both).T
            if a.std() > 1e-9 and b.std() > 1e-9:
                out.append((lag, len(both), float(np.corrcoef(a, b)[0, 1])))
    return sorted(out, key=lambda r: (-round(r[2], 9), r[0]))


@pytest.mark.parametrize("block", [16, 64, 1024])
def test_all_lags(spark, block):
    rng = np.random.default_rng(3)
    base = np.cumsum(rng.normal(size=400))
    x = {h: float(1000 + base[h]) for h in range(50, 300) if rng.random() < 0.9}
    y = {h + 17: float(base[h] + rng.normal() / 5) for h in range(400) if rng.random() < 0.8}
    frame = lambda s, c: spark.createDataFrame([(T0 + h * HOUR, v) for h, v in s.items()] + [(None, 1.0), (T0, None)], f"hour timestamp, {c} double")
    got = lags.lag_scan(frame(x, "x"), frame(y, "y"), 40, 10_000, block).collect()
    want = plain_lags(x, y, 40)
    assert sorted((r.lag_h, r.hours) for r in got) == sorted(w[:2] for w in want)
    r_of = {w[0]: w[2] for w in want}
    assert max(abs(r.r - r_of[r.lag_h]) for r in got) < 1e-9
    assert [r.rank for r in sorted(got, key=lambda r: (-r.r, r.lag_h))] == list(range(1, len(want) + 1)) and got[0].lag_h == 17


def test_lags_of_constant_and_empty_series(spark):
    one = spark.createDataFrame([(T0 + h * HOUR, 5.0) for h in range(50)], "hour timestamp, x double")
    other = spark.createDataFrame([(T0 + h * HOUR, float(h % 7)) for h in range(50)], "hour timestamp, y double")
    assert lags.lag_scan(one, other, 10, 5, 16).count() == 0
    assert lags.lag_scan(one.limit(0), other, 10, 5, 16).count() == lags.lag_scan(one, other.limit(0), 10, 5, 16).count() == 0


# ---- rank statistics


def test_tails(spark):
    zs = [-9.0, -6.5, -3.0, -1.0, -0.1, 0.0, 0.3, 1.6448536269514722, 2.0, 5.9, 6.1, 9.0, 30.0, None]
    got = [r.p for r in spark.createDataFrame([(i, z) for i, z in enumerate(zs)], "i int, z double").orderBy("i").select(stats.normal_tail(F.col("z")).alias("p")).collect()]
    for z, p in zip(zs, got):
        want = None if z is None else math.erfc(z / math.sqrt(2)) / 2
        assert p == want or abs(p - want) < 1e-12 and (z < 5 or abs(p / want - 1) < 1e-6), (z, p, want)
    got = [r.p for r in spark.createDataFrame([(0.1,), (0.5,), (0.8275735551899077,), (1.3580986393225505,), (3.0,)], "x double").select(stats.kolmogorov_tail(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [1.0, 0.9639452436648751, 0.5, 0.05, 2 * math.exp(-18)], atol=1e-9)


def test_rank_statistics_with_ties(spark):
    rng = np.random.default_rng(4)
    rows = [("g", float(v), True) for v in rng.integers(0, 20, 80)] + [("g", float(v), False) for v in rng.integers(3, 24, 120)] + [("same", 1.0, i % 2 == 0) for i in range(10)] + [("one", 1.0, True)]
    got = {r.g: r for r in stats.rank_statistics(spark.createDataFrame(rows, "g string, v double, l boolean"), "g", "v", F.col("l")).collect()}
    a, b = (np.array([v for g, v, l in rows if g == "g" and l == side]) for side in (True, False))
    u = sum((x > b).sum() + (x == b).sum() / 2 for x in a)
    values, ties = np.unique(np.r_[a, b], return_counts=True)
    n = len(a) + len(b)
    sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - (ties**3 - ties).sum() / (n * (n - 1))))
    ks = max(abs((a <= v).mean() - (b <= v).mean()) for v in values)
    lam = math.sqrt(len(a) * len(b) / n) * ks
    r = got["g"]
    assert abs(r.u - u) < 1e-9 and abs(r.ks - ks) < 1e-12 and abs(r.delta - (a.mean() - b.mean())) < 1e-12
    assert abs(r.u_p - math.erfc((len(a) * len(b) / 2 - u - 0.5) / sd / math.sqrt(2)) / 2) < 1e-9
    assert abs(r.ks_p - 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))) < 1e-9
    assert r.selective and got["same"].u_p is None and not got["same"].selective and "one" not in got


# ---- upscale


def test_a_year_of_ten_minute_knots(spark):
    """Against one system over the whole year, solved by numpy's dense solver in overlapping windows far from its edges."""
    n = 366 * 144
    t = np.arange(n) * 600.0
    y = np.sin(t / 40_000) + 0.3 * np.sin(t / 2_500)
    knots = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=float(s)), float(v)) for s, v in zip(t, y)], "k string, ts timestamp, v double")
    got = {r.ts: r.v for r in matrix.spline(knots, "k", "v", 5).collect()}
    assert len(got) == 2 * n - 1
    for lo in (0, 144 * 30, 144 * 182, n - 400):  # the start, a month's edge, the middle, the end
        x, v = t[lo : lo + 400] / 600, y[lo : lo + 400]
        h, a = np.diff(x), np.zeros((400, 400))
        i = np.arange(1, 399)
        a[i, i - 1], a[i, i], a[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
        a[0, :3], a[-1, -3:] = [h[1], -(h[0] + h[1]), h[0]], [h[-1], -(h[-2] + h[-1]), h[-2]]
        m = np.linalg.solve(a, np.concatenate([[0.0], 6 * np.diff(np.diff(v) / h), [0.0]]))
        mid = (v[:-1] + v[1:]) / 2 - (m[:-1] + m[1:]) / 16
        own = range(0 if lo == 0 else 60, 399 if lo + 400 == n else 340)
        assert max(abs(got[T0 + dt.timedelta(seconds=600 * (lo + j) + 300)] - mid[j]) for j in own) < 1e-9


@pytest.mark.parametrize("n", [4, 5, 6])
def test_short_splines_are_cubics_where_they_can_be(spark, n):
    rows = [("a", T0 + h * HOUR, float(h**3 - 2 * h)) for h in range(n)]
    got = matrix.spline(spark.createDataFrame(rows, "k string, ts timestamp, v double"), "k", "v").collect()
    for r in got:
        h = (r.ts - T0) / HOUR
        assert abs(r.v - (h**3 - 2 * h)) < 1e-9


def test_upscale_fills_metadata(spark):
    rows = [("a", T0 + h * HOUR, float(h), g) for h, g in ((0, None), (1, "x"), (2, None), (3, None), (4, "y"), (5, None))]
    events = [(1, "a", T0 + HOUR / 2, T0 + 2 * HOUR), (2, "a", T0 + 4 * HOUR, T0 + 5 * HOUR), (3, "b", T0, T0)]
    hourly = spark.createDataFrame(rows, "site string, ts timestamp, hs double, grid string")
    got = matrix.upscale(hourly, spark.createDataFrame(events, "event_id long, site string, start timestamp, end timestamp"), "site", ["hs"], [], ["grid"]).collect()
    for r in got:
        h = (r.ts - T0) / HOUR
        want = (None, None) if r.event_id == 3 else (h, "x" if h < 4 else "y")
        assert (r.hs is None) == (want[0] is None) and (r.hs is None or abs(r.hs - h) < 1e-9) and r.grid == want[1]
    assert len(got) == 10 + 7 + 1


def test_tasks_stay_as_large_when_tables_grow(spark, monkeypatch):
    """Partitions of scans, brackets and candidates are as many as their rows ask for."""
    from tidemark.operators import scan
    from tidemark.plans import lineage, roles

    monkeypatch.setattr(lineage, "TASK_ROWS", 100)
    df = spark.range(2000).selectExpr("id % 3 as k", "id as t")
    assert scan.placed(df, ["k"], ["t"]).rdd.getNumPartitions() == 20
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert roles.candidates(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-lines // 100)
