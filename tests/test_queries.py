"""Every query with SQL gives the SQL's rows on the small tables."""

from pathlib import Path

import pytest

from factloom.plans.catalog import ORACLES, QUERIES

from .harness import by_spark, by_sql

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    columns, got = by_spark(QUERIES[name](spark, SMALL))
    if name in ORACLES:
        names, wanted = by_sql(ORACLES[name], SMALL)
        assert sorted(columns) == sorted(names)
        assert got == wanted
