"""Every registered query of the reference's operators against DuckDB on the smallest tables."""

import pytest
from helpers import duck, spark_rows

from tidemark import catalog

SF = "/root/testdata/sf0.001"


NAMES = sorted(catalog.ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got, want = spark_rows(catalog.QUERIES[name](spark, SF)), duck(SF, catalog.ORACLE[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
