"""Every registered query against its SQL on the small tables."""

import pytest

from oracle import compare, connect
from ordscope.workloads import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert compare(got, duck.execute(ORACLES[name]).df()) == ""
    else:
        assert len(got) > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 130
