"""Correlations at given shifts, bootstrap, rank statistics and power curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hourly_mean(df: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Mean of each hour, after one mean for each time."""
    once = df.groupBy(*keys, ts).agg(F.avg(value).alias(value))
    return once.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(F.avg(value).alias(value))


def correlation_scan(a: DataFrame, b: DataFrame, shifts_h: list[int], least_hours: int = 48) -> DataFrame:
    """Correlation of a series (hour, x) with each candidate (site, hour, y) at each shift in hours, best first."""
    moved = a.withColumn("shift_h", F.explode(F.array(*map(F.lit, shifts_h)))).withColumn("hour", F.timestamp_seconds(F.unix_seconds("hour") + F.col("shift_h") * 3600))
    out = moved.join(b, "hour").groupBy("site", "shift_h").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("hours")).filter(F.col("hours") >= least_hours)
    return out.withColumn("r", F.nanvl("r", F.lit(None).cast("double"))).withColumn("rank", F.row_number().over(Window.partitionBy("shift_h").orderBy(F.desc_nulls_last("r"), "site")))


def bootstrap_wins(winners: DataFrame, draws: int, seed: int) -> DataFrame:
    """Share of bootstrap draws in which each winner comes first.

    winners has month and winner, a row for each month. A draw takes as many
    months as there are, by a hash of seed, draw and place, so it is the same
    everywhere; the most frequent winner takes the draw, ties to the smaller name.
    """
    n = winners.count()
    numbered = winners.withColumn("i", F.row_number().over(Window.orderBy("month")) - 1)  # months: a short table
    picks = winners.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
    picks = picks.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "draw", "j"), F.lit(max(1, n))).cast("int"))
    count = picks.join(numbered, "i").groupBy("draw", "winner").agg(F.count(F.lit(1)).alias("n"))
    first = count.groupBy("draw").agg(F.min_by("winner", F.struct(-F.col("n"), F.col("winner"))).alias("winner"))
    return first.groupBy("winner").agg((F.count(F.lit(1)) / draws).alias("win_rate"))


def running_counts(counts: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """counts with run_<c>, the sum of each c up to and with a row, in the order of a column within the keys.

    Rows are range-partitioned and written; a window runs within each
    partition and the totals of those before, a row for each partition and
    key, are added. So a key that holds most rows is not one task's.
    """
    from tidemark.plans.lineage import cut

    placed = cut(counts.repartitionByRange(*keys, order).withColumn("__part", F.spark_partition_id()))
    own = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    part = placed.groupBy(*keys, "__part").agg(*(F.sum(c).alias(f"__sum_{c}") for c in sums))
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = part.select(*keys, "__part", *(F.coalesce(F.sum(f"__sum_{c}").over(ahead), F.lit(0)).alias(f"__sum_{c}") for c in sums))
    run = placed.withColumns({f"run_{c}": F.sum(c).over(own) for c in sums}).join(before, [*keys, "__part"])
    return run.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"__sum_{c}") for c in sums}).drop("__part", *(f"__sum_{c}" for c in sums))


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """df with before, a struct of the columns in the row before, in the order of a column that is unique within the keys; null in a key's first row.

    By range partitions, written: a window within each, and the last row of
    the one before where a key goes on, so no key is one task's.
    """
    from tidemark.plans.lineage import cut

    placed = cut(df.repartitionByRange(*keys, order).withColumn("__part", F.spark_partition_id()))
    last = placed.groupBy(*keys, "__part").agg(F.max_by(F.struct(*columns), order).alias("__last"))
    carried = last.select(*keys, "__part", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__part")).alias("__carried"))
    own = F.lag(F.struct(*columns)).over(Window.partitionBy(*keys, "__part").orderBy(order))
    return placed.withColumn("before", own).join(carried, [*keys, "__part"]).withColumn("before", F.coalesce("before", "__carried")).drop("__part", "__carried")


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles of a value for each key (a null key is one, too), a column for each name in qs, linear between the two ranks around.

    Values are counted, and ranks found from running counts by range
    partitions; no task holds the values of a whole group.
    """
    own = F.struct(*keys).alias("__k") if keys else F.lit(0).alias("__k")
    n = df.filter(F.col(value).isNotNull()).groupBy(own, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = running_counts(n, ["__k"], "v", ["n"])
    met = run.join(n.groupBy("__k").agg(F.sum("n").alias("__all")), "__k")
    holds = lambda rank: (F.col("run_n") > rank) & (F.col("run_n") - F.col("n") <= rank)
    aggs, out = [], []
    for name, q in qs.items():
        at = q * (F.col("__all") - 1)
        aggs += [F.max(F.when(holds(F.floor(at)), F.col("v"))).alias(f"{name}|a"), F.max(F.when(holds(F.ceil(at)), F.col("v"))).alias(f"{name}|b")]
        part = q * (F.col("__all") - 1) - F.floor(q * (F.col("__all") - 1))
        out.append((F.col(f"{name}|a") + part * (F.col(f"{name}|b") - F.col(f"{name}|a"))).alias(name))
    return met.groupBy("__k", "__all").agg(*aggs).select(*(F.col(f"__k.{k}").alias(k) for k in keys), *out)


def with_quantiles(out: DataFrame, df: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]]) -> DataFrame:
    """out, a row for each key (or one), with quantiles of df's values: wanted is, for each value, the names and shares. Null keys meet null keys."""
    for value, qs in wanted.items():
        q = quantiles(df, keys, value, qs)
        if keys:
            out = out.withColumn("__k", F.struct(*keys)).join(q.select(F.struct(*keys).alias("__k"), *qs), "__k", "left").drop("__k")
        else:
            out = out.join(F.broadcast(q), how="left")  # one row
    return out


def kolmogorov_tail(x: Column) -> Column:
    """Share of the Kolmogorov distribution beyond x, by its alternating series."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x * x))
    whole = F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.when(x < 0.2, F.lit(1.0)).when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), whole)))


def normal_tail(z: Column) -> Column:
    """Share of the normal distribution beyond z: a series up to 6 deviations, a continued fraction beyond."""
    far = F.abs(z)
    density = F.exp(-far * far / 2) / F.lit((2 * math.pi) ** 0.5)
    start = F.struct(far.alias("t"), far.alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, lambda a, k: F.struct((a["t"] * far * far / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * far * far / (2 * k + 1)).alias("s")), lambda a: a["s"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), far, lambda a, k: far + k / a)
    beyond = F.when(far <= 6, 0.5 - density * series).otherwise(density / fraction)
    return F.when(z >= 0, beyond).otherwise(1 - beyond)


def rank_statistics(df: DataFrame, group: str, value: str, label: Column, alpha: float = 0.05) -> DataFrame:
    """Whether labelled rows have other, and whether they have smaller, values than the others, for each group.

    ks and ks_p: Kolmogorov-Smirnov distance and its limiting tail; u:
    Mann-Whitney U of the labelled rows (ties count half), u_p: the normal
    tail of their being smaller, with corrections for ties and continuity;
    cliffs_delta, z (without the half), mean_a, mean_b, delta (a less b);
    selective: u_p below alpha and delta below 0. Groups that lack either
    side have no row; where all values are equal u_p and z are null.

    Values are counted first and summed up by range partitions, so no task
    sorts a whole group; a value's count tells its ties.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count_if(label).alias("a"), F.count_if(~label).alias("b"))
    total = c.groupBy(group).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    c = running_counts(c, [group], value, ["a", "b"]).withColumnsRenamed({"run_a": "ca", "run_b": "cb"}).join(total, group)
    u = F.sum(F.col("a") * ((F.col("cb") - F.col("b")) + F.col("b") / 2))
    t = (F.col("a") + F.col("b")).cast("double")
    mean = lambda x: (F.sum(F.col(x) * F.col(value)) / F.first(f"n{x}")).alias(f"mean_{x}")
    out = c.filter("na > 0 and nb > 0").groupBy(group, "na", "nb").agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"), u.alias("u"), F.sum(t * t * t - t).alias("__ties"), mean("a"), mean("b"))
    m, n = F.col("na").cast("double") * F.col("nb"), (F.col("na") + F.col("nb")).cast("double")
    spread = F.sqrt(m / 12 * ((n + 1) - F.col("__ties") / (n * (n - 1))))
    spread = F.when(spread > 0, spread)
    out = out.withColumns({
        "cliffs_delta": 2 * F.col("u") / m - 1, "z": (F.col("u") - m / 2) / spread, "delta": F.col("mean_a") - F.col("mean_b"),
        "ks_p": kolmogorov_tail(F.sqrt(m / n) * F.col("ks")), "u_p": normal_tail(((m - F.col("u")) - m / 2 - 0.5) / spread),
    })
    return out.withColumn("selective", F.coalesce((F.col("u_p") < alpha) & (F.col("delta") < 0), F.lit(False))).drop("__ties")


def sound_wind(df: DataFrame, wind: str, most: float = 45.0) -> DataFrame:
    """Rows whose wind speed is between 0 and the limit."""
    return df.filter(F.col(wind).between(0, most))


def power_curve(df: DataFrame, asset: str, wind: str, power: str, width: float = 0.5, least_rows: int = 30) -> DataFrame:
    """Mean power of wind bins of each asset, from rows of sound status, wind 0 to 35 and power -0.05 to 1.2."""
    ok = df.filter(F.col("status").isin(0, 1) & F.col(wind).between(0, 35) & F.col(power).between(-0.05, 1.2))
    mid = (F.floor(F.col(wind) / width) + 0.5) * width
    return ok.groupBy(asset, mid.alias("wind")).agg(F.avg(power).alias("power"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least_rows) & F.col("wind").between(4, 25))


def best_curve(binned: DataFrame, curves: DataFrame, asset: str, least_bins: int = 12) -> DataFrame:
    """The reference curve (curve, wind, power) nearest to each asset's by mean absolute error, interpolated between its points."""
    w = Window.partitionBy("curve").orderBy("wind")
    seg = curves.select("curve", F.col("wind").alias("x0"), F.col("power").alias("y0"), F.lead("wind").over(w).alias("x1"), F.lead("power").over(w).alias("y1")).filter("x1 is not null")
    seg = seg.withColumn("cell", F.explode(F.sequence(F.floor("x0").cast("int"), F.floor("x1").cast("int"))))
    met = binned.withColumn("cell", F.floor("wind").cast("int")).join(seg, "cell").filter((F.col("wind") >= F.col("x0")) & (F.col("wind") < F.col("x1")))
    err = F.col("power") - (F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("wind") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    fit = met.groupBy(asset, "curve").agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.count(F.lit(1)).alias("bins")).filter(F.col("bins") >= least_bins)
    return fit.groupBy(asset).agg(F.min_by(F.struct("curve", "mae", "rmse", "bins"), F.struct("mae", "curve")).alias("x")).select(asset, "x.*")


def label_audit(df: DataFrame, event: str, ts: str, label: str) -> DataFrame:
    """Rows by label of each event and its longest run of positives."""
    w = Window.partitionBy(event).orderBy(ts)
    pos = F.coalesce(F.col(label) == 1, F.lit(False))
    runs = df.withColumn("__p", pos).withColumn("__new", (~F.col("__p").eqNullSafe(F.lag("__p").over(w))).cast("int")).withColumn("__run", F.sum("__new").over(w))
    per = runs.groupBy(event, "__run", "__p").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label).isNull()).alias("unknown"))
    return per.groupBy(event).agg(F.sum(F.when(F.col("__p"), F.col("n")).otherwise(0)).alias("positive"), F.sum("neg").alias("negative"), F.sum("unknown").alias("unknown"), F.max(F.when(F.col("__p"), F.col("n")).otherwise(0)).alias("longest_run"))


def scores(df: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Accuracy, precision, recall and F1 at every threshold, in one pass."""
    y = F.col(label) == 1
    t = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("p", F.col(score) >= F.col("threshold"))
    c = t.groupBy("threshold").agg(F.count_if(y & F.col("p")).alias("tp"), F.count_if(~y & F.col("p")).alias("fp"), F.count_if(y & ~F.col("p")).alias("fn"), F.count_if(~y & ~F.col("p")).alias("tn"))
    prec, rec = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.withColumns({"accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "precision": prec, "recall": rec, "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
