"""Queries over all rows of their tables: no id is left out."""

import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
ALL = {"interval_join": ("events", "event_id"), "asof_nearest": ("events", "event_id"), "window_or_nearest": ("events", "event_id"), "bracketed": ("events", "event_id"), "ten_minute_grid": ("events", "event_id"),
       "feature_matrix": ("events", "event_id"), "months_touched": ("orders", "o_orderkey"), "scalar_functions": ("orders", "o_orderkey")}


@pytest.mark.parametrize("name", sorted(ALL))
def test_no_id_is_left_out(spark, name):
    table, key = ALL[name]
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in catalog.QUERIES[name](spark, SF).select(key).distinct().collect()} == want


def test_all_lines_are_candidates(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    assert sum(r.n_sources for r in catalog.QUERIES["event_confidence"](spark, SF).collect()) == lines.count()
