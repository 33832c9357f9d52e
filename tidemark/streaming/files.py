"""Files that arrive: only stable ones, each once, with ledgers that make a repeated batch write nothing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.scan import scan


def ledger(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What has been committed to a root: the rows of its ledger, none if there isn't one yet."""
    try:
        return spark.read.schema(schema).parquet(f"{root}/ledger")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


BATCHES = "batch_id long, rows long"


def sink_once(stream: DataFrame, root: str, checkpoint: str, after_write: Callable[[int], None] = lambda batch: None) -> StreamingQuery:
    """A started query that writes every micro-batch once into root/data, for all that is available now.

    A batch overwrites its own folder, then its line is added to the ledger.
    A batch that the ledger has is not written again; one that failed between
    the two is written anew in its place. after_write is called in between.
    Readers take committed batches only (`committed`).
    """
    def write(df: DataFrame, batch: int) -> None:
        own = df.sparkSession
        if ledger(own, root, BATCHES).filter(F.col("batch_id") == batch).head(1):
            return
        df.write.mode("overwrite").parquet(f"{root}/data/batch_id={batch}")
        after_write(batch)
        written = own.read.schema(stream.schema).parquet(f"{root}/data/batch_id={batch}").agg(F.count(F.lit(1)).alias("rows"))
        written.select(F.lit(batch).cast("long").alias("batch_id"), "rows").coalesce(1).write.mode("append").parquet(f"{root}/ledger")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, root: str, schema, batches: str = BATCHES) -> DataFrame:
    """Rows of the batches that a ledger has, with batch_id; others are pruned as folders."""
    data = spark.read.schema(schema).option("basePath", f"{root}/data").parquet(f"{root}/data").withColumn("batch_id", F.col("batch_id").cast("long"))
    return data.join(F.broadcast(ledger(spark, root, batches).select("batch_id").distinct()), "batch_id", "left_semi")


def listing(spark: SparkSession, folder: str, pattern: str, fields: list[str]) -> DataFrame:
    """Files of a folder that aren't empty and whose names match: path, modified, size and the pattern's groups as fields. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    name = F.element_at(F.split("path", "/"), -1)
    found = files.filter((F.col("size") > 0) & name.rlike(pattern))
    return found.select("*", *(F.regexp_extract(name, pattern, i).alias(f) for i, f in enumerate(fields, 1)))


def complete_sets(files: DataFrame, kind: str, kinds: list[str], keys: list[str], now: float, stable_seconds: float) -> DataFrame:
    """For each key of a listing its paths by kind and a status: stable, fresh (a file is younger than stable_seconds) or incomplete (a kind is missing)."""
    by = files.filter(F.col(kind).isin(kinds)).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col(kind), F.col("path"))))).alias("paths"), F.count_distinct(kind).alias("kinds"), F.max("modified").alias("newest"))
    fresh = F.unix_micros("newest") > int((now - stable_seconds) * 1e6)
    return by.select(*keys, "paths", F.when(F.col("kinds") < len(kinds), "incomplete").when(fresh, "fresh").otherwise("stable").alias("status"))


def consolidate(
    sets: DataFrame, root: str, keys: list[str], read: Callable[[SparkSession, dict[str, list[str]]], DataFrame], batch_size: int = 100, max_batches: int | None = None
) -> dict[str, int]:
    """Write the stable sets that aren't in the ledger yet, batch_size of them a batch, into root/data/batch_id=N; batch ids go on from the ledger's.

    read turns the paths of a batch, by kind, into its rows. Returns counts:
    eligible, already, fresh, incomplete, written and batches. A batch's
    folder is written (over what a failed run left of it), then its sets enter
    the ledger; so a set is in one committed batch, whenever a run ends. What
    comes to the driver are the paths of one batch at a time.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    spark = sets.sparkSession
    schema = ", ".join(f"`{k}` string" for k in keys) + ", batch_id long"
    done = ledger(spark, root, schema)
    status = {r.status: r.n for r in sets.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    stable = sets.filter("status = 'stable'").select(*(F.col(k).cast("string").alias(k) for k in keys), "paths")
    already = stable.join(done, keys, "left_semi").count()
    start = (done.agg(F.max("batch_id")).first()[0] or 0) + 1
    new = scan(stable.join(done, keys, "left_anti").withColumn("__all", F.lit(0)), ["__all"], keys, sums={"number": F.lit(1)})
    new = new.withColumn("batch_id", F.floor((F.col("number") - 1) / batch_size) + start).drop("number", "__all").persist()
    total = new.agg(F.max("batch_id")).first()[0]
    last = start - 1 if total is None else total if max_batches is None else min(total, start - 1 + max_batches)
    written = 0
    for batch in range(start, last + 1):
        own = new.filter(F.col("batch_id") == batch)
        paths: dict[str, list[str]] = {}
        for r in own.select("paths").collect():
            for kind, path in r.paths.items():
                paths.setdefault(kind, []).append(path)
        read(spark, paths).write.mode("overwrite").parquet(f"{root}/data/batch_id={batch}")
        rows = own.select(*keys, F.col("batch_id").cast("long").alias("batch_id"))
        written += rows.count()
        rows.coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    new.unpersist()
    return {"eligible": status.get("stable", 0), "already": already, "fresh": status.get("fresh", 0), "incomplete": status.get("incomplete", 0), "written": written, "batches": max(0, last + 1 - start)}


def consolidate_folder(spark: SparkSession, folder: str, pattern: str, fields: list[str], kind: str, kinds: list[str], root: str, read: Callable, stable_seconds: float = 120, now: float | None = None, **options) -> dict[str, int]:
    """One run over a folder that others still write to: what is complete and old enough is consolidated, the rest left for a later run."""
    keys = [f for f in fields if f != kind]
    sets = complete_sets(listing(spark, folder, pattern, fields), kind, kinds, keys, time.time() if now is None else now, stable_seconds)
    return consolidate(sets, root, keys, read, **options)
