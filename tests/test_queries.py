"""Every registered query runs on the smallest tables with a stable schema, and equals its SQL where it has one."""

import os

import pytest

from skein import plans
from tests.compare import SMALL, connection, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    got = df.toPandas()
    if name in plans.oracle_sql():
        want = con.execute(plans.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
