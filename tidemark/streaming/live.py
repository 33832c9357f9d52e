"""Structured Streaming forms of the ping operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import pings as P
from tidemark.plans.lineage import scratch


def filtered(stream: DataFrame, turbines: DataFrame, box: tuple[float, float, float, float] | None = None, max_sog: float | None = 2.0) -> DataFrame:
    """Sound, slow pings, each with its nearest turbine of a static table; stateless."""
    return P.match_nearest(P.stationary(P.filter_pings(stream, box, max_sog)), turbines)


def without_duplicates(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One ping of each vessel and time within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["mmsi", "ts"])


#: Vessels whose numbers differ in so many last bits alone form a group: a call of Python and a row of state serve up to 32 vessels, however many there are.
BITS = 5
#: The group of pings without a vessel's number, beyond all others; workers get no nulls as keys, which would make their column one of floats.
NOBODY = 2**62


def _grouped(stream: DataFrame, delay: str, *columns: Column | str) -> DataFrame:
    """A stream with its watermark, each vessel's number split into a group (fleet) and its place there (unit), and times as microseconds (us)."""
    mmsi = F.col("mmsi").cast("long")
    fleet, unit = F.coalesce(F.shiftright(mmsi, BITS), F.lit(NOBODY)), F.coalesce(mmsi.bitwiseAND(F.lit(2**BITS - 1)).cast("long"), F.lit(0).cast("long"))
    return stream.withWatermark("ts", delay).select("ts", fleet.alias("fleet"), unit.alias("unit"), F.unix_micros("ts").alias("us"), *columns)


def _mmsi() -> Column:
    return F.when(F.col("fleet") < NOBODY, F.shiftleft("fleet", BITS) + F.col("unit")).alias("mmsi")


def _columns(types: dict[str, str], values: Iterable[list]) -> pd.DataFrame:
    return pd.DataFrame({c: np.array(v, "int64" if types[c] == "long" else "float64") for c, v in zip(types, values)})


def dwell_sessions(stream: DataFrame, gap_minutes: float = 30.0, least_minutes: float = 15.0, delay: str = "1 hour") -> DataFrame:
    """Dwell sessions of matched pings (filtered), each sent once it is closed; the same as those of a batch.

    A session ends at a longer gap or at another turbine; shorter ones than
    least_minutes go. State is, for each group of vessels, the pings beyond
    the watermark, as earlier ones may still come, and a vessel's open session.
    """
    gap = int(gap_minutes * 60_000_000)
    out = "fleet long, unit long, found_id long, start long, end long, ping_count long, mean_sog double, min_dist double, duration_min double"
    waiting = {"unit": "long", "us": "long", "found": "long", "sog": "double", "dist": "double"}
    session = {"unit": "long", "found": "long", "start": "long", "end": "long", "n": "long", "sog": "double", "dist": "double"}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else [[]] * (len(waiting) + len(session))
        rows = pd.concat([_columns(waiting, held[: len(waiting)]), *(() if state.hasTimedOut else (f[list(waiting)] for f in frames))], ignore_index=True)
        now = state.getCurrentWatermarkMs() * 1000
        ready, later = rows[rows.us < now], rows[rows.us >= now]
        ready = ready.sort_values(["unit", "us", "dist", "found"]).drop_duplicates(["unit", "us"])
        # open sessions, and each ping as one of its own; all pings are later than the open session of their vessel
        parts = pd.concat([_columns(session, held[len(waiting) :]), ready.assign(start=ready.us, end=ready.us, n=1)[list(session)]]).sort_values(["unit", "start"], ignore_index=True)
        same = (parts.unit == parts.unit.shift(fill_value=-1)) & (parts.found == parts.found.shift(fill_value=0)) & (parts.start - parts.end.shift(fill_value=0) <= gap)
        sessions = parts.groupby((~same).cumsum()).agg({"unit": "first", "found": "first", "start": "min", "end": "max", "n": "sum", "sog": "sum", "dist": "min"})
        is_open = ~sessions.unit.duplicated(keep="last") & (sessions.end + gap >= now)
        open_, done = sessions[is_open], sessions[~is_open]
        if len(later) or len(open_):
            state.update((*(later[c].tolist() for c in waiting), *(open_[c].tolist() for c in session)))
            state.setTimeoutTimestamp(max(min([*later.us, *(open_.end + gap)]), now) // 1000 + 1)
        elif state.exists:
            state.remove()
        done = done[(done.end - done.start) / 60e6 >= least_minutes]
        if len(done):
            yield pd.DataFrame(
                {"fleet": key[0], "unit": done.unit, "found_id": done.found, "start": done.start, "end": done.end, "ping_count": done.n, "mean_sog": done.sog / done.n, "min_dist": done.dist, "duration_min": (done.end - done.start) / 60e6}
            )

    kept = ", ".join(f"{name}_{c} array<{t}>" for name, types in (("w", waiting), ("s", session)) for c, t in types.items())
    pings = _grouped(stream, delay, F.col("found_id").alias("found"), "sog", F.col("dist_m").alias("dist"))
    found = pings.groupBy("fleet").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(_mmsi(), "found_id", *(F.timestamp_micros(c).alias(c) for c in ("start", "end")), "ping_count", "mean_sog", "min_dist", "duration_min")


def hourly(stream: DataFrame, value: str, delay: str = "1 hour") -> DataFrame:
    """Means of tumbling hours."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "mean", "n")


def variability(stream: DataFrame, value: str, delay: str = "1 hour") -> DataFrame:
    """Spread over six hours, every hour."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "6 hours", "1 hour").alias("w")).agg((F.max(value) - F.min(value)).alias("spread"), F.stddev_pop(value).alias("std")).select(F.col("w.start").alias("start"), "spread", "std")


def new_files(spark, schema, path: str, per_trigger: int = 100) -> DataFrame:
    """A stream of files as they arrive, each read once; with a checkpoint and Trigger.AvailableNow it continues where it ended."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def nearby_samples(pings: DataFrame, samples: DataFrame, key: str, tolerance: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Pairs of two streams on a key whose times are within the tolerance; both need watermarks, so state is bounded."""
    a = pings.withWatermark("ts", delay).alias("a")
    b = samples.withWatermark("sample_ts", delay).alias("b")
    near = F.expr(f"a.{key} = b.{key} and b.sample_ts between a.ts - interval {tolerance} and a.ts + interval {tolerance}")
    return a.join(b, near)


class _LastPositions(StatefulProcessor):
    """The last known positions of a group of vessels, and their pings that the watermark hasn't passed yet.

    Pings wait until none older can come, so they are answered in order of
    time whatever files and batches they come in. A timer wakes the group
    for the next ping that waits, or when a position is to be forgotten.
    """

    rows = {"unit": "long", "us": "long", "lat": "double", "lon": "double"}

    def __init__(self, max_knots: float, forget_hours: float) -> None:
        self.max_knots, self.forget = max_knots, int(forget_hours * 3_600_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = ", ".join(f"{c} array<{t}>" for c, t in self.rows.items())
        self.last = handle.getValueState("last", kept)
        self.waiting = handle.getListState("waiting", kept)  # an element for each batch that brought some

    def _wake(self, at: int | None, held: list[int]) -> None:
        for t in held:
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        self.waiting.appendValue(tuple(new[c].tolist() for c in self.rows))
        held, first = list(self.handle.listTimers()), int(new.us.min())
        if not held or first // 1000 + 1 < min(held):
            self._wake(first, held)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last = [self.last.get()] if self.last.exists() else []
        parts = [_columns(self.rows, r).assign(new=new) for new, rs in ((False, last), (True, self.waiting.get())) for r in rs]
        rows = pd.concat(parts, ignore_index=True)
        later = rows[rows.us >= now]
        r = rows[rows.us < now].sort_values(["unit", "new", "us", "lat", "lon"], ignore_index=True)
        since = (r.us - r.us.shift(fill_value=0)).to_numpy()
        known = (r.unit == r.unit.shift(fill_value=-1)).to_numpy() & (since > 0) & (since <= self.forget)
        lat, lon, lat0, lon0 = r.lat.to_numpy(), r.lon.to_numpy(), r.lat.shift().to_numpy(), r.lon.shift().to_numpy()
        a = np.sin(np.radians(lat - lat0) / 2) ** 2 + np.cos(np.radians(lat0)) * np.cos(np.radians(lat)) * np.sin(np.radians(lon - lon0) / 2) ** 2
        knots = 2 * 3440.065 * np.arcsin(np.minimum(1.0, np.sqrt(a))) / np.where(known, since / 3600e6, np.nan)
        if len(later):
            self.waiting.put([tuple(later[c].tolist() for c in self.rows)])
        else:
            self.waiting.clear()
        kept = r[~r.unit.duplicated(keep="last") & (r.us + self.forget >= now)]
        if len(kept):
            self.last.update(tuple(kept[c].tolist() for c in self.rows))
        elif last:
            self.last.clear()
        self._wake(min([*later.us, *(kept.us + self.forget)], default=None), list(self.handle.listTimers()))
        if r.new.any():
            out = pd.DataFrame({"fleet": key[0], "unit": r.unit, "us": r.us, "lat": lat, "lon": lon, "implied_knots": knots, "alert": knots > self.max_knots})
            yield out[r.new]

    def close(self) -> None:
        pass


def vessel_state(stream: DataFrame, max_knots: float = 45.0, forget_hours: float = 2.0, delay: str = "1 hour") -> DataFrame:
    """For each vessel's pings the implied speed since the one before and an alert when it is impossible.

    The same rows as a batch in order of time, for pings that the watermark
    has passed; speed is null without a ping in the forget_hours before, and
    without time between. State, with `keyed_state`, is for each group of
    vessels their last positions, forgotten by a timer (event time), and the
    pings that still wait.
    """
    out = "fleet long, unit long, us long, lat double, lon double, implied_knots double, alert boolean"
    pings = _grouped(stream, delay, "lat", "lon").groupBy("fleet").transformWithStateInPandas(_LastPositions(max_knots, forget_hours), out, "Append", "EventTime")
    return pings.select(_mmsi(), F.timestamp_micros("us").alias("ts"), "lat", "lon", "implied_knots", "alert")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with states of their own and timers need, for streams that start in the block."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, base: str | None = None) -> tuple[DataFrame, int]:
    """What a stream gives for all that is available now, as a table, and the late rows that its watermarks dropped.

    Results and checkpoints are files in the folder that all executors share;
    with the base of an earlier call the stream goes on where that one ended,
    and the table holds the results of both.
    """
    base = base or scratch(stream.sparkSession)
    run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out"), late
