"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

from metricwell import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, data, same):
    got = registry.QUERIES[name](spark, data).toPandas()
    if name in registry.ORACLE_SQL:
        same(got, duck.sql(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got)
