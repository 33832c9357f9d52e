"""Archives by their footers and folders, sketches, and table functions."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import tables
from tidemark.operators import sketches
from tidemark.sources import files


def archive(spark, tmp_path):
    root = str(tmp_path / "archive")
    df = spark.range(600).select(F.concat(F.lit("F"), (F.col("id") % 4).cast("string")).alias("wind_farm"), (2020 + F.col("id") % 3).cast("int").alias("year"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("day"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("hs"))
    df.write.partitionBy("wind_farm", "year").parquet(root)
    return root, df


def leaves(df):
    """File scans of the plan as it was run, those inside of query stages too."""
    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name.startswith("Adaptive"):
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        children = plan.children()
        return [x for i in range(children.size()) for x in walk(children.apply(i))] or ([plan] if name == "FileSourceScanExec" else [])

    return walk(df._jdf.queryExecution().executedPlan())


def test_index_comes_from_footers(spark, tmp_path):
    root, df = archive(spark, tmp_path)
    got = files.archive_index(spark, root, ["wind_farm", "year"], ["day"], ["hs", "tp"])
    want = files.index_plan(df, ["wind_farm", "year"], ["day"], ["hs", "tp"])
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 12
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        plan = files.index_plan(spark.read.parquet(root), ["wind_farm", "year"], ["day"], ["hs"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.useV1SourceList")
        spark.conf.unset("spark.sql.parquet.aggregatePushdown")
    assert "PushedAggregation: [COUNT(*), MIN(day), MAX(day), COUNT(hs)]" in plan and "PushedGroupBy: [wind_farm, year]" in plan


def test_unwanted_folders_are_not_opened(spark, tmp_path):
    root, _ = archive(spark, tmp_path)
    wanted = spark.createDataFrame([("F1", 2021), ("F2", 2022), ("F9", 2021)], "wind_farm string, year int")
    got = files.read_archive(spark, root, wanted)
    assert {(r.wind_farm, r.year) for r in got.collect()} == {("F1", 2021), ("F2", 2022)}
    every = spark.read.parquet(root)
    every.collect()
    opened = [sum(x.metrics().apply("numFiles").value() for x in leaves(df)) for df in (got, every)]
    assert 0 < opened[0] * 2 <= opened[1]  # each key prunes by itself, so four folders of twelve are left, and the keys' own file


def test_merged_daily_sketches(spark):
    rng = np.random.default_rng(5)
    values = np.r_[rng.normal(size=20_000), rng.exponential(9, 20_000)]
    rows = [("ab"[i % 2], dt.date(2024, 1, 1) + dt.timedelta(days=i % 40), float(v)) for i, v in enumerate(values)] + [("a", None, None), ("a", None, float("nan"))]
    table = sketches.sketches(spark.createDataFrame(rows, "s string, day date, v double"), ["s", "day"], "v")
    got = {r.s: r for r in sketches.sketch_quantiles(sketches.merged(table, ["s"]), {"a": 0.0, "m": 0.5, "z": 0.95}).collect()}
    for i, s in enumerate("ab"):
        own = np.sort(values[i::2])
        assert got[s].n == len(own) and got[s].a == own[0]
        for name, q in (("m", 0.5), ("z", 0.95)):
            assert abs(np.searchsorted(own, got[s][name]) / len(own) - q) <= 3 * sketches.rank_error(400)
    assert sketches.rank_error(200) < 0.0134


def test_table_functions(spark):
    tables.register_tables(spark)
    spark.createDataFrame([(1, "x", 1, 1.0, 5.0, 350.0), (1, "z", 3, 1.5, None, 10.0), (1, "y", 2, 1.0, 4.0, 90.0), (2, "x", 1, 1.0, 1.0, 1.0)], "dwell_id long, source string, rank int, hs double, tp double, direction double").createOrReplaceTempView("cand_t")
    got = spark.sql("SELECT * FROM source_pairs(TABLE(cand_t) PARTITION BY dwell_id)").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "x", "y", 0.0, 1.0, 100.0), (1, "x", "z", -0.5, None, 20.0), (1, "y", "z", -0.5, None, 80.0)]
    spark.createDataFrame([("l", 0.4, 3.2), ("l", 0.1, 3.9), ("l", 0.6, 3.0), ("m", None, 1.0)], "lane string, hs double, tp double").createOrReplaceTempView("lane_t")
    got = spark.sql("SELECT * FROM occupied_bins(TABLE(lane_t) PARTITION BY lane, hs_width => 0.5D, tp_width => 1.0D)").collect()
    assert sorted(map(tuple, got)) == [("l", 0.0, 3.0, 2), ("l", 0.5, 3.0, 1)]
