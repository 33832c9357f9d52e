"""Quantiles from mergeable sketches kept as a table, beside the exact ones of stats.quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_error(k: int) -> float:
    """How far a quantile's rank may be off, as a share of all rows, in 99 of 100 cases, for sketches of size k."""
    return 2.296 / k**0.9723


def sketches(df: DataFrame, keys: list[str], value: str, by: dict[str, Column] | None = None, k: int = 400) -> DataFrame:
    """A sketch of a value for each key and each of `by` (a day, a source): keys, n, least, most and sketch, some kilobytes each.

    Null and NaN values are left out. Such a table is written once and grows
    by appending; `merged` answers for any coarser grouping from it alone.
    """
    v = F.col(value).cast("double")
    rows = df.withColumns(by or {}).filter(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(*keys, *(by or {})).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_double(v, k).alias("sketch"))


def merged(table: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of a coarser grouping: keys, n, least, most, sketch. Sketches are added pairwise, partly before the shuffle."""
    return table.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(table: DataFrame, qs: dict[str, float]) -> DataFrame:
    """table with a column for each name in qs, a value whose rank is within rank_error of the quantile; 0 and 1 are exact."""
    def at(q: float) -> Column:
        return F.col("least") if q <= 0 else F.col("most") if q >= 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(q))

    return table.withColumns({name: at(q) for name, q in qs.items()})
