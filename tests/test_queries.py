"""Every query of the engine against its SQL, on the smallest tables."""

import os

import pytest

from driftline import queries as engine

from .helpers import cells, oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query_equals_sql(spark, name):
    got = engine.queries()[name](spark, SF).toPandas()
    want = oracle(SF, engine.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_entry_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
