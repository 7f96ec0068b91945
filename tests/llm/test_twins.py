"""Every SQL twin of the training-data queries runs, and gives its query's rows, on the smallest tables."""

import duckdb
import pytest

from check_oracle import TABLES, canon
from panelwright.llm import plans

from ..conftest import SF


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_twin(spark, con, name):
    a = plans.QUERIES[name](spark, SF).toPandas()
    b = con.execute(plans.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert canon(a) == canon(b)
    assert len(a)
