"""Ten-minute feature matrices, their event aggregates, and cubic interpolation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import angles
from tidemark.operators.evidence import operational_label
from tidemark.operators.timejoin import asof_nearest, grid


def feature_matrix(events: DataFrame, status: DataFrame, metocean: DataFrame, values: list[str], tolerance_s: float = 600) -> DataFrame:
    """Every event's ten-minute rows with the status and metocean values nearest in time, and an operational label.

    events: event_id, found_id, start, end, duration_min, min_dist; status:
    found_id, ts, status; metocean: found_id, ts and the values.
    """
    rows = grid(events.select("event_id", "found_id", "start", "end", "duration_min", "min_dist")).drop("start", "end")
    rows = asof_nearest(rows, status, ["found_id"], ["status"], tolerance_s).drop("gap_s")
    rows = asof_nearest(rows, metocean, ["found_id"], values, tolerance_s).drop("gap_s")
    return rows.withColumn("label", operational_label(F.col("status"), F.col("duration_min"), F.col("min_dist")))


def event_aggregates(matrix: DataFrame, keys: list[str], scalars: list[str], directions: list[str] = (), label: str = "label") -> DataFrame:
    """One row for each event: mean, max, min, population deviation and null share of scalars, circular mean and variance of directions, shares and the most frequent label."""
    aggs = [F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) / 6).alias("duration_h")]
    for c in scalars:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"), F.min(c).alias(f"{c}_min"), F.stddev_pop(c).alias(f"{c}_std"), (1 - F.count(c) / F.count(F.lit(1))).alias(f"{c}_null_share")]
    for c in directions:
        aggs += [angles.mean_direction(F.col(c)).alias(f"{c}_mean"), angles.circular_variance(F.col(c)).alias(f"{c}_variance")]
    out = matrix.groupBy(*keys).agg(*aggs)
    n = matrix.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy(*keys).agg(F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col(label))).alias("x"), F.sum("n").alias("all"))
    return out.join(top.select(*keys, F.col(f"x.{label}").alias("dominant_label"), (F.col("x.n") / F.col("all")).alias("dominant_share")), keys)


def paired_medians(matrix: DataFrame, event: str, label: str, value: str) -> DataFrame:
    """Median of a value for labels 0 and 1 of each event that has both."""
    m = matrix.groupBy(event).pivot(label, [0, 1]).agg(F.percentile(value, 0.5))
    return m.filter(F.col("0").isNotNull() & F.col("1").isNotNull()).select(event, F.col("0").alias("median_0"), F.col("1").alias("median_1"))


def spline(knots: DataFrame, key: str, value: str, step_minutes: int = 10, block: str = "month") -> DataFrame:
    """Not-a-knot cubic spline of a series (key, ts, value) every step_minutes, block by block.

    A block of a key (a month of hourly knots) is one pandas group with a day
    of knots beyond either edge, so no group grows with the length of the
    series; what a knot does to a place fades to a quarter with each knot
    between, so a day of hourly knots leaves nothing of the edge. The
    equations have three bands and are solved in time linear in the knots.
    Three knots give their parabola, two a line, one its value.
    """
    import pandas as pd

    ts = F.col("ts")
    own = F.date_trunc(block, ts)
    edges = F.array_distinct(F.array(own, F.date_trunc(block, ts - F.expr("interval 1 day")), F.date_trunc(block, ts + F.expr("interval 1 day"))))
    spread = knots.filter(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.unix_seconds("ts").alias("t"), F.col(value).cast("double").alias("v"), F.explode(edges).alias("b")).withColumn("b0", F.unix_seconds("b"))
    spread = spread.withColumn("b1", F.unix_seconds(F.add_months("b", 1).cast("timestamp") if block == "month" else F.col("b") + F.expr(f"interval 1 {block}"))).drop("b")

    def curvatures(h, d):
        """Second derivatives at all knots, from steps and slopes: one equation at each inner knot, and third derivatives that go on over the second and the last but one knot, so the first and last unknowns are put into their neighbours' equations and what is left has three bands."""
        import numpy as np

        n = len(h) + 1
        low, mid, high, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(d)
        mid[0], high[0] = mid[0] + h[0] * (h[0] + h[1]) / h[1], high[0] - h[0] ** 2 / h[1]
        mid[-1], low[-1] = mid[-1] + h[-1] * (h[-2] + h[-1]) / h[-2], low[-1] - h[-1] ** 2 / h[-2]
        low, mid, high, right = low.tolist(), mid.tolist(), high.tolist(), right.tolist()
        for i in range(1, n - 2):
            f = low[i] / mid[i - 1]
            mid[i] -= f * high[i - 1]
            right[i] -= f * right[i - 1]
        m = [0.0] * n
        m[n - 2] = right[-1] / mid[-1]
        for i in range(n - 4, -1, -1):
            m[i + 1] = (right[i] - high[i] * m[i + 2]) / mid[i]
        m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
        m[-1] = ((h[-2] + h[-1]) * m[-2] - h[-1] * m[-3]) / h[-2]
        return np.array(m)

    def solve(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        p = pdf.groupby("t", as_index=False).v.mean().sort_values("t")
        x, y = p.t.to_numpy(float), p.v.to_numpy(float)
        step = step_minutes * 60
        lo, hi = max(x[0], group[1]), min(x[-1], group[2] - 1)
        at = np.arange(np.ceil(lo / step) * step, hi + 1, step)
        n = len(x)
        if n < 3:
            return pd.DataFrame({"k": group[0], "t": at.astype(np.int64), "v": np.interp(at, x, y)})
        h, d = np.diff(x), np.diff(y) / np.diff(x)
        m = np.full(3, 2 * (d[1] - d[0]) / (h[0] + h[1])) if n == 3 else curvatures(h, d)
        j = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
        a, b = x[j + 1] - at, at - x[j]
        v = (m[j] * a**3 + m[j + 1] * b**3) / (6 * h[j]) + (y[j] / h[j] - m[j] * h[j] / 6) * a + (y[j + 1] / h[j] - m[j + 1] * h[j] / 6) * b
        return pd.DataFrame({"k": group[0], "t": at.astype(np.int64), "v": v})

    out = spread.groupBy("k", "b0", "b1").applyInPandas(solve, "k string, t long, v double")
    return out.select(F.col("k").alias(key), F.timestamp_seconds("t").alias("ts"), F.col("v").alias(value))


def upscale(hourly: DataFrame, events: DataFrame, key: str, scalars: list[str], directions: list[str] = (), metadata: list[str] = ()) -> DataFrame:
    """Every event's ten-minute rows (event_id, key, ts) with hourly series between their knots.

    Scalars follow a spline, directions the line between the components of
    the knots around, metadata columns are filled forward and then backward
    over the whole series. All are computed before they are clipped to the
    events, so a knot within an hour on either side is there wherever the
    series has one; beyond its ends scalars and directions are null.
    """
    from tidemark.operators.timejoin import interpolate

    rows = grid(events.select("event_id", key, "start", "end")).select("event_id", key, "ts")
    out = rows
    for c in scalars:
        out = out.join(spline(hourly.select(key, "ts", c), key, c), [key, "ts"], "left")
    if directions or metadata:
        parts = hourly.select(key, "ts", *metadata, *(x.alias(f"__{c}_{n}") for c in directions for n, x in zip("sk", angles.components(F.col(c)))))
        met = interpolate(rows.select(key, "ts"), parts, [key], [f"__{c}_{n}" for c in directions for n in "sk"], metadata)
        turned = {c: angles.speed_direction(F.col(f"__{c}_s"), F.col(f"__{c}_k"))[1] for c in directions}
        out = out.join(met.select(key, "ts", *(v.alias(c) for c, v in turned.items()), *metadata), [key, "ts"], "left")
    return out


def status_profile(status: DataFrame) -> DataFrame:
    """At each time the most frequent status (ties to the smaller) and the shares in service and down."""
    n = status.groupBy("ts", "status").agg(F.count(F.lit(1)).alias("n"))
    s = F.sum("n")
    return n.groupBy("ts").agg(F.min_by("status", F.struct(-F.col("n"), F.col("status"))).alias("mode"), (F.sum(F.when(F.col("status").isin(3, 4), F.col("n")).otherwise(0)) / s).alias("service_share"), (F.sum(F.when(F.col("status").isin(1, 2, 5), F.col("n")).otherwise(0)) / s).alias("down_share"))
