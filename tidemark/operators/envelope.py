"""Observed envelopes: binned boundaries, occupancy surfaces, kernel look-ups and lanes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut


@dataclass(frozen=True)
class Axis:
    """A binned column: edges left to right; left-closed bins, or right-closed."""

    column: str
    edges: tuple[float, ...]
    right: bool = False

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(float(a), float(b)) for a, b in zip(self.edges, self.edges[1:])], f"{self.column}_left double, {self.column}_right double")

    def left(self) -> Column:
        """Left edge of a value's bin; null outside all bins. Edges are a constant list, so this is one expression."""
        c, out = F.col(self.column), F.lit(None).cast("double")
        for a, b in zip(self.edges, self.edges[1:]):
            out = F.when((c > a) & (c <= b) if self.right else (c >= a) & (c < b), float(a)).otherwise(out)
        return out


@dataclass(frozen=True)
class Surface:
    """A surface: axes, grouping columns and the subset of rows it describes (a SQL predicate)."""

    axes: tuple[Axis, ...]
    groups: tuple[str, ...] = ()
    subset: str = "true"
    required: tuple[str, ...] = field(default=())


def occupancy_surface(df: DataFrame, spec: Surface) -> DataFrame:
    """Counts of every combination of bins for every group, with 0 where nothing was seen.

    Rows with a null axis value are counted apart (null_rows) and rows beyond
    the edges too (outside_rows). Bin tables are constant, so crossing them
    with the groups seen is bounded by groups times bins.
    """
    spark = df.sparkSession
    own = df.filter(spec.subset)
    lefts = {f"{a.column}_left": a.left() for a in spec.axes}
    binned = own.withColumns(lefts)
    any_null, outside = F.lit(False), F.lit(False)
    for a in spec.axes:
        any_null = any_null | F.col(a.column).isNull()
        outside = outside | (F.col(a.column).isNotNull() & F.col(f"{a.column}_left").isNull())
    # rows are read and counted once; what follows works on a row for each group and bin
    cells = cut(binned.groupBy(*spec.groups, *lefts, any_null.alias("__null"), outside.alias("__outside")).agg(F.count(F.lit(1)).alias("rows")))
    only = lambda test: F.sum(F.when(test, F.col("rows")).otherwise(0))
    account = cells.groupBy(*spec.groups).agg(F.sum("rows").alias("group_rows"), only(F.col("__null")).alias("null_rows"), only(~F.col("__null") & F.col("__outside")).alias("outside_rows"))
    counts = cells.filter(~F.col("__null") & ~F.col("__outside")).drop("__null", "__outside")
    every = account
    for a in spec.axes:
        every = every.crossJoin(F.broadcast(a.table(spark)))
    return every.join(counts, [*spec.groups, *lefts], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def boundary(df: DataFrame, bins: DataFrame, left: Column, value: str, least_rows: int = 1) -> DataFrame:
    """p50, p75, p90, p95, min and max of a value in each bin of `bins` (a column `bin`); bins without rows stay, as nulls. Quantiles are exact, by range partitions."""
    from tidemark.operators.stats import quantiles

    own = df.withColumn("bin", left).filter("bin is not null")
    got = own.groupBy("bin").agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).filter(F.col("n") >= least_rows)
    out = bins.join(got.join(quantiles(own, ["bin"], value, {f"p{p}": p / 100 for p in (50, 75, 90, 95)}), "bin", "left"), "bin", "left")
    return out.select("bin", F.coalesce("n", F.lit(0)).alias("n"), "p50", "p75", "p90", "p95", "lo", "hi")


def kernel_percentiles(df: DataFrame, grid: DataFrame, x: str, value: str, quantiles: tuple[float, ...], width: float = 1.0, least_weight: float = 2.0, reach: float = 6.0) -> DataFrame:
    """Gaussian-kernel weighted percentiles of a value along a grid of x (column `g`).

    The weighted percentile is the first value, in order, at which the running
    weight reaches the share. Equal (x, value) rows are counted first, and
    rows meet grid points at most `reach` widths away through equal cells
    (beyond it a weight is under 2e-8), so the grid may be long.
    """
    cell = reach * width
    rows = df.groupBy(F.col(x).alias("x"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("x is not null and v is not null")
    rows = rows.withColumn("c", F.explode(F.array(*(F.floor(F.col("x") / cell) + d for d in (-1, 0, 1)))))
    met = grid.withColumn("c", F.floor(F.col("g") / cell)).join(rows, "c").filter(F.abs(F.col("x") - F.col("g")) <= cell)
    met = met.groupBy("g", "v").agg(F.sum(F.col("n") * F.exp(-0.5 * F.pow((F.col("x") - F.col("g")) / width, 2))).alias("w"))
    run = F.sum("w").over(Window.partitionBy("g").orderBy("v"))
    total = F.sum("w").over(Window.partitionBy("g"))
    met = met.withColumns({"run": run, "total": total}).filter(F.col("total") >= least_weight)
    return met.groupBy("g").agg(F.max("total").alias("weight"), *(F.min(F.when(F.col("run") >= q * F.col("total"), F.col("v"))).alias(f"p{round(q * 100)}") for q in quantiles))


def access_matrix(percentiles: DataFrame, levels: DataFrame, floor50: float = 0.5, floor95: float = 1.0) -> DataFrame:
    """Access share of every (g, level): 1 up to p50, 0 from p95 on, linear between; with floors for both."""
    lo, hi = F.greatest("p50", F.lit(floor50)), F.greatest("p95", F.lit(floor95))
    v = F.col("level")
    share = F.when(v <= lo, 1.0).when(v >= hi, 0.0).otherwise((hi - v) / (hi - lo))
    return percentiles.crossJoin(F.broadcast(levels)).select("g", "level", share.alias("access"))


def ecdf(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Distinct values of each group and the share of rows up to each; counted first, then summed up by range partitions."""
    from tidemark.operators.stats import running_counts

    n = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*groups).agg(F.sum("n").alias("__all"))
    run = running_counts(n, groups, value, ["n"])
    met = run.join(total, groups) if groups else run.crossJoin(F.broadcast(total))
    return met.withColumn("ecdf", F.col("run_n") / F.col("__all")).drop("n", "run_n", "__all")


@dataclass(frozen=True)
class Lane:
    """A named evidence lane: a SQL predicate over the fused table."""

    name: str
    predicate: str


def in_lanes(df: DataFrame, lanes: list[Lane], scopes: list[Lane]) -> DataFrame:
    """A row for each lane and depth scope that a row belongs to, in one pass."""
    names = lambda ls: F.array_compact(F.array(*(F.when(F.expr(x.predicate), F.lit(x.name)) for x in ls)))
    return df.withColumn("lane", F.explode(names(lanes))).withColumn("scope", F.explode(names(scopes)))


def lane_comparison(summary: DataFrame, baseline: str) -> DataFrame:
    """Lanes against a baseline lane of the same scope, with what is material.

    summary has lane, scope, n, hs_p95, tp_p95 and top_share. Material: under
    80 % of the rows kept, Hs p95 off by 0.25 m, Tp p95 by 0.5 s, top-farm
    share by 0.10.
    """
    from tidemark.functions.values import reasons, share

    b = summary.filter(F.col("lane") == baseline).select("scope", *(F.col(c).alias(f"b_{c}") for c in ("n", "hs_p95", "tp_p95", "top_share")))
    out = summary.join(b, "scope").withColumn("retained_share", share(F.col("n"), F.col("b_n")))
    off = lambda c, limit: F.abs(F.col(c) - F.col(f"b_{c}")) >= limit
    why = reasons((F.col("retained_share") < 0.80, "rows"), (off("hs_p95", 0.25), "hs"), (off("tp_p95", 0.50), "tp"), (off("top_share", 0.10), "top_farm"))
    return out.withColumn("material", why)
