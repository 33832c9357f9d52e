"""Interval, nearest-time and bracketing joins without nested loops.

Ranges are met by time buckets: an equi-join on the key and the bucket, then
the exact condition. A wider bucket repeats intervals less and compares more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import scan, segments
from tidemark.plans.lineage import pieces


def _bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000))


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str = "ts", start: str = "start", end: str = "end", bucket_s: int = 3600) -> DataFrame:
    """Points inside intervals of their key, both ends included; all pairs."""
    spread = intervals.withColumn("__b", F.explode(F.sequence(_bucket(F.col(start), bucket_s), F.greatest(_bucket(F.col(start), bucket_s), _bucket(F.col(end), bucket_s)))))
    return points.withColumn("__b", _bucket(F.col(ts), bucket_s)).join(spread, [*keys, "__b"]).filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))).drop("__b")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], bucket_s: int = 6 * 3600) -> DataFrame:
    """Pairs of intervals (start, end) and (b_start, b_end) of a key that overlap, with overlap_min and its share of a."""
    cover = lambda d, s, e: d.withColumn("__b", F.explode(F.sequence(_bucket(F.col(s), bucket_s), _bucket(F.col(e), bucket_s))))
    met = cover(a, "start", "end").join(cover(b, "b_start", "b_end"), [*keys, "__b"])
    low, high = F.greatest("start", "b_start"), F.least("end", "b_end")
    # a pair counts in the bucket where it begins to overlap
    met = met.filter((low < high) & (F.col("__b") == _bucket(low, bucket_s))).drop("__b")
    shared = (F.unix_micros(high) - F.unix_micros(low)) / 60e6
    own = (F.unix_micros("end") - F.unix_micros("start")) / 60e6
    return met.withColumns({"overlap_min": shared, "overlap_fraction": F.when(own > 0, shared / own)})


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance_s: float, ts: str = "ts", tie: str = "earlier", prefix: str = "", bucket_s: int | None = None) -> DataFrame:
    """left with the values of the right row nearest in time, within tolerance_s, else null; also gap_s.

    Both sides fall into buckets as wide as the tolerance; the last right row
    of a bucket also goes into the next one and the first into the one
    before, so a left row's neighbours are all in its own. A window over a
    key's bucket takes the right rows just before and after each left row:
    rows are sorted, never paired, however dense the series. Of right rows
    at one time the one with the smallest JSON counts; ties in time go to the
    earlier or the later row. Repeated left rows come back each; a left row
    without a time gets nulls.
    """
    width = max(1, int(bucket_s or math.ceil(tolerance_s)))
    own = [F.col(k) for k in keys]
    r = right.filter(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("__rt"), F.struct(*values).alias("__v"))
    r = r.groupBy(*keys, "__rt").agg(F.min_by("__v", F.to_json("__v")).alias("__v")).withColumn("__b", _bucket(F.col("__rt"), width))
    ends = r.groupBy(*keys, "__b").agg(F.min_by(F.struct("__rt", "__v"), "__rt").alias("first"), F.max_by(F.struct("__rt", "__v"), "__rt").alias("last"))
    spread = F.explode(F.array(F.struct((F.col("__b") + 1).alias("b"), F.col("last").alias("x")), F.struct((F.col("__b") - 1).alias("b"), F.col("first").alias("x"))))
    edges = ends.select(*keys, spread.alias("e")).select(*keys, F.col("e.b").alias("__b"), F.col("e.x.__rt").alias("__rt"), F.col("e.x.__v").alias("__v"))
    l = left.select(F.struct(*left.columns).alias("__left"), *keys, F.col(ts).alias("__t"), _bucket(F.col(ts), width).alias("__b"))  # noqa: E741
    both = l.unionByName(r.unionByName(edges).withColumn("__t", F.col("__rt")), allowMissingColumns=True)
    w = Window.partitionBy(*own, "__b").orderBy("__t", F.col("__rt").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    # a frame that is open ahead is evaluated anew for each row, so the next row is found in descending order
    ahead = Window.partitionBy(*own, "__b").orderBy(F.desc("__t"), F.col("__rt").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("__rt").isNotNull(), F.struct("__rt", "__v"))
    both = both.withColumns({"__p": F.last(seen, True).over(w), "__n": F.last(seen, True).over(ahead)})
    gap = lambda c: F.when(F.abs(F.unix_micros(f"{c}.__rt") - F.unix_micros("__t")) <= tolerance_s * 1e6, F.abs(F.unix_micros(f"{c}.__rt") - F.unix_micros("__t")))
    both = both.filter("__left is not null").withColumns({"__gp": gap("__p"), "__gn": gap("__n")})
    before = F.col("__gp") <= F.col("__gn") if tie == "earlier" else F.col("__gp") < F.col("__gn")
    best = F.when(F.col("__gp").isNotNull() & (F.col("__gn").isNull() | before), F.col("__p")).when(F.col("__gn").isNotNull(), F.col("__n"))
    both = both.withColumn("__m", best)
    return both.select(*(F.col(f"__left.{c}").alias(c) for c in left.columns), *(F.col(f"__m.__v.{v}").alias(prefix + v) for v in values), (F.abs(F.unix_micros("__m.__rt") - F.unix_micros("__t")) / 1e6).alias(prefix + "gap_s"))


def window_or_nearest(events: DataFrame, samples: DataFrame, keys: list[str], value: str, tolerance_s: float, event_id: str = "event_id") -> DataFrame:
    """For each event the mean of a key's samples in [start, end]; without any, the sample nearest to its middle.

    Returns event_id, value, n_samples, method (window, nearest) and
    missing_reason (bad_window, no_samples_in_tolerance), one row for each event.
    """
    middle = F.timestamp_micros(F.floor((F.unix_micros("start") + F.unix_micros("end")) / 2).cast("long"))
    sound = events.filter(F.col("start").isNotNull() & (F.col("end") >= F.col("start")))
    inside = interval_join(samples.filter(F.col(value).isNotNull()), sound.select(event_id, *keys, "start", "end"), keys).groupBy(event_id).agg(F.avg(value).alias("w"), F.count(F.lit(1)).alias("n"))
    near = asof_nearest(sound.select(event_id, *keys, middle.alias("ts")), samples.filter(F.col(value).isNotNull()).select(*keys, "ts", F.col(value).alias("x")), keys, ["x"], tolerance_s)
    out = events.select(event_id, "start", "end").join(inside, event_id, "left").join(near.select(event_id, "x"), event_id, "left")
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("end") < F.col("start"))
    return out.select(
        event_id,
        F.coalesce("w", "x").alias("value"),
        F.coalesce("n", F.when(F.col("x").isNotNull(), 1).otherwise(0).cast("long")).alias("n_samples"),
        F.when(F.col("n") > 0, "window").when(F.col("x").isNotNull(), "nearest").alias("method"),
        F.when(F.coalesce("w", "x").isNull(), F.when(bad, "bad_window").otherwise("no_samples_in_tolerance")).alias("missing_reason"),
    )


def bracketed(events: DataFrame, samples: DataFrame, keys: list[str], value: str, event_id: str = "event_id") -> DataFrame:
    """For each event the mean of the samples inside it, else of the last before and the first after it, at any distance; else nothing.

    Returns event_id, value, n_inside, bracketed (there is a sample at its
    start or before and one at its end or after), gap_min (from its middle to
    the nearest sample), method (window, bracket, not_assigned),
    missing_fraction (of the samples taken; 1 if none) and missing_reason
    (no_assignable_samples, values_missing, values_partially_missing from over
    5 %). Samples without a value count as samples, as a source that has them
    covers the time. Samples at one time count by their mean at an event's
    edge and each by itself inside. An event that ends before it starts, or
    lacks a time or a key, has no samples; repeated ids are one event.

    Samples, one row for each time, and an event's start, end and middle are
    sorted together by range partitions (scan.scan); sums up to the edges and
    the samples next to them are carried to the events. So nothing is paired,
    whatever the gaps or the density. Sums are of decimals with 12 places, so
    they don't depend on partitions.
    """
    known = lambda df, *c: df.filter(" and ".join(f"`{x}` is not null" for x in (*keys, *c)))
    v = F.col(value).cast("double")
    exact = F.sum(F.when(v.isNotNull(), v.cast("decimal(38,12)")))
    each = known(samples, "ts").groupBy(*keys, F.col("ts").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("full"), exact.alias("s"), F.avg(v).alias("v"))
    sound = known(events, "start", "end").filter(F.col("end") >= F.col("start")).dropDuplicates([event_id])
    middle = F.timestamp_micros(F.floor((F.unix_micros("start") + F.unix_micros("end")) / 2).cast("long"))
    # at one time: an event's start, then the sample, then an event's end and middle
    marks = F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("t")) for k, t in ((0, F.col("start")), (2, F.col("end")), (3, middle))))
    asked = sound.select(F.col(event_id).alias("__id"), *keys, F.explode(marks).alias("m")).select("__id", *keys, F.col("m.kind").alias("kind"), F.col("m.t").alias("t"))
    both = each.withColumn("kind", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    here = F.when(F.col("kind") == 1, F.struct("t", "n", "full", "v"))
    got = scan(both, keys, ["t", "kind", "__id"], last={"back": here}, first={"ahead": here}, sums={"run_n": F.col("n"), "run_full": F.col("full"), "run_s": F.col("s")})
    mark = lambda k: F.max(F.when(F.col("kind") == k, F.struct("t", "back", "ahead", "run_n", "run_full", "run_s")))
    # three marks of an event meet in as many tasks as the events ask for
    got = got.filter("kind != 1").repartition(pieces(asked), "__id").groupBy("__id").agg(mark(0).alias("a"), mark(2).alias("b"), mark(3).alias("c"))
    before = F.when(F.col("a.ahead.t") == F.col("a.t"), F.col("a.ahead")).otherwise(F.col("a.back"))
    after = F.when(F.col("b.back.t") == F.col("b.t"), F.col("b.back")).otherwise(F.col("b.ahead"))
    far = lambda c: F.abs(F.unix_micros(c) - F.unix_micros("c.t")) / 60e6
    got = got.select(
        "__id", before.alias("before"), after.alias("after"), (F.col("b.run_n") - F.col("a.run_n")).alias("n"), (F.col("b.run_full") - F.col("a.run_full")).alias("full"), (F.col("b.run_s") - F.col("a.run_s")).alias("s"),
        F.least(far("c.back.t"), far("c.ahead.t")).alias("gap_min"),
    )
    pair = F.col("before").isNotNull() & F.col("after").isNotNull()
    one = F.col("before.t") == F.col("after.t")
    ends = F.when(F.col("before.v").isNotNull() & F.col("after.v").isNotNull(), (F.col("before.v") + F.col("after.v")) / 2).otherwise(F.coalesce("before.v", "after.v"))
    inside = F.col("n") > 0
    taken = F.when(inside, F.col("n")).when(pair, F.when(one, F.col("before.n")).otherwise(F.col("before.n") + F.col("after.n")))
    full = F.when(inside, F.col("full")).when(pair, F.when(one, F.col("before.full")).otherwise(F.col("before.full") + F.col("after.full")))
    out = events.select(event_id).distinct().join(got, F.col(event_id) == F.col("__id"), "left").withColumns({"missing_fraction": F.coalesce(1 - full / taken, F.lit(1.0))})
    return out.select(
        event_id,
        F.when(inside, F.when(F.col("full") > 0, (F.col("s") / F.col("full")).cast("double"))).when(pair, ends).alias("value"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_inside"),
        F.coalesce(pair, F.lit(False)).alias("bracketed"),
        "gap_min",
        F.when(inside, "window").when(pair, "bracket").otherwise("not_assigned").alias("method"),
        "missing_fraction",
        F.when(~F.coalesce(inside | pair, F.lit(False)), "no_assignable_samples").when(F.col("missing_fraction") == 1, "values_missing").when(F.col("missing_fraction") > 0.05, "values_partially_missing").alias("missing_reason"),
    )


def full_time_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two series on the same keys and times, either may lack a row; one row for each key first."""
    return a.dropDuplicates(keys).join(b.dropDuplicates(keys), keys, "full")


def one_to_one(base: DataFrame, layer: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails when the layer repeats a key, so rows are kept one for one.

    The check is part of the plan: raise_error fires in the task that sees the key twice.
    """
    once = layer.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *(F.first(c).alias(c) for c in layer.columns if c not in keys))
    once = once.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.lit("a layer repeats a key"))).otherwise(F.lit(1)))
    return base.join(once.filter("__n = 1").drop("__n"), keys, "left")


def grid(events: DataFrame, minutes: int = 10, start: str = "start", end: str = "end") -> DataFrame:
    """Each event's times every so many minutes, from the floor of its start to the ceiling of its end."""
    s = minutes * 60
    lo, hi = F.floor(F.unix_micros(start) / (s * 1_000_000)) * s, F.ceil(F.unix_micros(end) / (s * 1_000_000)) * s
    return events.withColumn("ts", F.explode(F.transform(F.sequence(lo, hi, F.lit(s).cast("long")), lambda x: F.timestamp_seconds(x))))


def months(df: DataFrame, start: str, end: str) -> DataFrame:
    """Calendar months that a span touches, with month_end."""
    out = df.withColumn("month", F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))))
    return out.withColumn("month_end", F.last_day("month"))


def islands(df: DataFrame, keys: list[str], ts: str, max_gap_s: float) -> DataFrame:
    """Spans of rows whose gaps are at most max_gap_s: key, span, first, last, rows. By range partitions, so a key may hold most rows."""
    spans = segments(df.select(*keys, ts), keys, [ts], lambda before: F.unix_micros(ts) - F.unix_micros(before[ts]) > max_gap_s * 1e6, "span")
    return spans.groupBy(*keys, "span").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("rows"))


def interpolate(grid_rows: DataFrame, knots: DataFrame, keys: list[str], values: list[str], carried: list[str] = ()) -> DataFrame:
    """grid_rows (keys, ts) with values linear between the knots around them and carried columns filled forward, then backward.

    Knots and places are sorted together by range partitions, so a series may
    be as long as the table; each value has knots of its own where others are null.
    """
    g = grid_rows.select(*keys, "ts").distinct().withColumn("__g", F.lit(True))
    both = g.join(knots.select(*keys, "ts", *values, *carried), [*keys, "ts"], "full")
    t = F.unix_micros("ts")
    here = {v: F.when(F.col(v).isNotNull(), F.struct(t.alias("t"), F.col(v).alias("v"))) for v in values}
    fill = {c: F.col(c) for c in carried}
    around = {**here, **fill}
    out = scan(both, keys, ["ts"], last={f"__p_{n}": c for n, c in around.items()}, first={f"__n_{n}": c for n, c in around.items()})

    def between(v: str) -> Column:
        p, n = F.col(f"__p_{v}"), F.col(f"__n_{v}")
        return F.when(p["t"] == n["t"], p["v"]).otherwise(p["v"] + (n["v"] - p["v"]) * (t - p["t"]) / (n["t"] - p["t"]))

    return out.filter("__g").select(*keys, "ts", *(between(v).alias(v) for v in values), *(F.coalesce(f"__p_{c}", f"__n_{c}").alias(c) for c in carried))
