"""Every query of the subpackage on the smallest tables, against its SQL where it has one."""

import os

import pytest

from skein.llm import plans
from tests.compare import SMALL, connection, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    got = plans.QUERIES[name](spark, SMALL).toPandas()
    if name in plans.ORACLE:
        want = connection().execute(plans.ORACLE[name]).df()
        assert rows(got) == rows(want)
    if name.endswith("_found"):
        assert not got.duplicated().any()


def test_pieces_by_sql(spark):
    got = plans.QUERIES["p7_pieces"](spark, SMALL)
    assert got.where("length(text) > 1200").count() == 0
    assert got.select("chunk_id").distinct().count() == connection().execute("SELECT count(DISTINCT chunk_id) FROM graph_chunks").fetchone()[0]
