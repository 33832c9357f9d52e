"""Correlation of two hourly series at every lag, by Fourier transforms of pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hours of a block, and the deviation, as a share of the whole series', below which a stretch counts as constant.
BLOCK_HOURS, CONSTANT = 1 << 15, 1e-6


def _blocks(series: DataFrame, value: str, size: int) -> tuple[DataFrame, float] | None:
    """Blocks of a series (block, p: hours in it, v: values less the mean), and its deviation; None for an empty one."""
    v = F.col(value).cast("double")
    once = series.filter(F.col("hour").isNotNull() & v.isNotNull() & ~F.isnan(v)).groupBy(F.floor(F.unix_seconds("hour") / 3600).alias("h")).agg(F.avg(v).alias("v"))
    mean, spread = once.agg(F.avg("v"), F.stddev_pop("v")).first()
    if mean is None:
        return None
    block = F.floor(F.col("h") / size)
    own = once.select(block.alias("block"), F.struct((F.col("h") - block * size).cast("int").alias("p"), (F.col("v") - mean).alias("v")).alias("x"))
    return own.groupBy("block").agg(F.collect_list("x").alias("x")).select("block", "x.p", "x.v"), spread


def lag_scan(a: DataFrame, b: DataFrame, least_hours: int, top: int, block_hours: int = BLOCK_HOURS) -> DataFrame:
    """The best of all hourly lags of b (hour, y) behind a (hour, x): lag_h, hours (that both have), r, lag_days and rank, by correlation.

    Every lag at which the series overlap in least_hours hours is compared;
    hours that either lacks are left out, lags at which one is constant have
    no correlation and no row. Rows of one hour count by their mean.

    Counts, sums, squares and products at all lags are six cross-correlations
    of the series and the masks of their hours. They are cut in blocks; a pair
    of blocks gives a run of lags by Fourier transforms, pairs equally far
    apart are added before they are turned back, and runs are added up by
    lag. So the work is n log n for each pair of blocks, a task holds one
    pair, and no row is paired with a row. Values are taken less their means,
    so what rounding leaves is far below a millionth of r.
    """
    spark = a.sparkSession
    one, other = _blocks(a, "x", block_hours), _blocks(b, "y", block_hours)
    out = "lag_h long, n double, x double, y double, xx double, yy double, xy double"
    if one is None or other is None:
        sums = spark.createDataFrame([], out)
        dx = dy = 0.0
    else:
        (left, dx), (right, dy) = one, other
        lo, hi = right.agg(F.min("block"), F.max("block")).first()
        pairs = left.select(F.col("block").alias("i"), F.col("p").alias("ap"), F.col("v").alias("av"), F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("j"))
        pairs = pairs.join(right.select(F.col("block").alias("j"), F.col("p").alias("bp"), F.col("v").alias("bv")), "j").withColumn("apart", F.col("j") - F.col("i"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, total = None, None
            lags = np.arange(1 - block_hours, block_hours)

            def spectra(places, values):
                own = np.zeros((3, 2 * block_hours))
                own[0, places], own[1, places], own[2, places] = 1, values, values**2
                return np.fft.rfft(own)

            def turned() -> pa.RecordBatch:
                got = np.fft.irfft(total, 2 * block_hours)[:, lags]  # a negative lag is at the end
                n = np.rint(got[0])
                keep = n > 0
                return pa.RecordBatch.from_arrays([pa.array(at * block_hours + lags[keep]), pa.array(n[keep]), *(pa.array(g[keep]) for g in got[1:])], ["lag_h", "n", "x", "y", "xx", "yy", "xy"])

            for batch in batches:
                for r in range(batch.num_rows):
                    apart = batch.column(0)[r].as_py()
                    if apart != at:
                        if at is not None:
                            yield turned()
                        at, total = apart, np.zeros((6, block_hours + 1), np.complex128)
                    cells = [batch.column(c)[r].values.to_numpy() for c in range(1, 5)]
                    (ma, x, xx), (mb, y, yy) = np.conj(spectra(*cells[:2])), spectra(*cells[2:])
                    total += np.array([ma * mb, x * mb, ma * y, xx * mb, ma * yy, x * y])
            if at is not None:
                yield turned()

        met = pairs.select("apart", "ap", "av", "bp", "bv", "i")
        sums = met.repartition("apart").sortWithinPartitions("apart", "i").mapInArrow(run, out)
    s = sums.groupBy("lag_h").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy"))).filter(F.col("n") >= least_hours)
    n = F.col("n")
    vx, vy = (F.col(q) / n - (F.col(c) / n) ** 2 for q, c in (("xx", "x"), ("yy", "y")))
    moves = (vx > (CONSTANT * dx) ** 2) & (vy > (CONSTANT * dy) ** 2)
    r = (F.col("xy") / n - F.col("x") / n * F.col("y") / n) / F.sqrt(vx * vy)
    best = s.filter(moves).select("lag_h", n.cast("long").alias("hours"), r.alias("r"), (F.col("lag_h") / 24).alias("lag_days")).orderBy(F.desc("r"), "lag_h").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("r"), "lag_h")))  # of the top rows
