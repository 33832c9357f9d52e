"""Scans in the order of a column within keys, by range partitions: no key, however many rows it has, is one task's.

Rows are range-partitioned by keys and order and written. A window runs
within each partition of a key, in as many tasks as the rows ask for; what goes across partitions (last and first
values, sums, numbers of spans) is one row for each key and partition, and a
window over those few rows carries it to the others, over partitions that
hold nothing of it. Rows of equal order lie in one partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut, pieces


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df in range partitions of keys and order, as many as its rows ask for, written, with the partition's number as __part and its place in a key as __at."""
    rows = cut(df.repartitionByRange(pieces(df), *keys, *order).withColumn("__part", F.spark_partition_id()))
    rows = rows.withColumn("__at", F.struct(*keys, "__part"))
    return rows.repartition(pieces(rows), "__at")


def with_part(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what is carried to their key and partition; null keys are keys, too, as a struct's nulls are equal."""
    return rows.join(carried.withColumn("__at", F.struct(*keys, "__part")).drop(*keys, "__part"), "__at", "left")


def scan(df: DataFrame, keys: list[str], order: list[str], last: dict[str, Column] | None = None, first: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """df with new columns: the last value that isn't null at a row or before it, the first at it or after, the sum up to and with it.

    Values are expressions of df's columns; order must be unique within the
    keys. Looking ahead is looking back in descending order, as a frame that
    is open ahead is evaluated anew for each row.
    """
    last, first, sums = last or {}, first or {}, sums or {}
    rows = placed(df.withColumns({f"__v_{n}": c for n, c in {**last, **first, **sums}.items()}), keys, order)
    value, at = lambda n: F.col(f"__v_{n}"), F.struct(*order)
    held = lambda n: F.when(value(n).isNotNull(), at)
    edges = rows.groupBy(*keys, "__part").agg(
        F.count(F.lit(1)).alias("__n"), *(F.max_by(value(n), held(n)).alias(f"__e_{n}") for n in last), *(F.min_by(value(n), held(n)).alias(f"__e_{n}") for n in first), *(F.sum(value(n)).alias(f"__e_{n}") for n in sums)
    )
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        *keys, "__part", *(F.last(f"__e_{n}", True).over(before).alias(f"__c_{n}") for n in last), *(F.last(f"__e_{n}", True).over(after).alias(f"__c_{n}") for n in first), *(F.sum(f"__e_{n}").over(before).alias(f"__c_{n}") for n in sums)
    )
    own = Window.partitionBy("__at")
    back = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = own.orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, 0)
    out = with_part(rows, carried, keys)
    out = out.withColumns({**{n: F.coalesce(F.last(value(n), True).over(back), f"__c_{n}") for n in last}, **{n: F.coalesce(F.sum(value(n)).over(back), F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums}})
    out = out.withColumns({n: F.coalesce(F.last(value(n), True).over(ahead), f"__c_{n}") for n in first})
    return out.drop("__part", "__at", *(f"__{x}_{n}" for x in "vc" for n in {**last, **first, **sums}))


def segments(df: DataFrame, keys: list[str], order: list[str], opens: Callable[[Column], Column], number: str) -> DataFrame:
    """df with a running number, from 1 in each key, of the spans that its rows fall into.

    opens gets the order columns of the row before, as a struct, and says
    whether a row begins a new span; a key's first row does. Each partition
    tells the next its last row and how many spans begin in it, so a span
    goes on over the edges of partitions.
    """
    df = df.drop(number)
    rows, at = placed(df, keys, order), F.struct(*order)
    end = rows.groupBy(*keys, "__part").agg(F.max(at).alias("__end"))
    carried = end.select(*keys, "__part", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__part")).alias("__carried"))
    own = Window.partitionBy("__at").orderBy(*order)
    flagged = with_part(rows, carried, keys).withColumn("__before", F.coalesce(F.lag(at).over(own), F.col("__carried")))
    flagged = flagged.withColumn("__new", (F.col("__before").isNull() | F.coalesce(opens(F.col("__before")), F.lit(True))).cast("long"))
    counts = flagged.groupBy(*keys, "__part").agg(F.sum("__new").alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__offset"))
    run = F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return with_part(flagged.withColumn("__run", run), offsets, keys).select(*df.columns, (F.col("__run") + F.col("__offset")).alias(number))
