"""Every query with oracle SQL gives the same rows in both engines."""

import pytest

from compare import TESTDATA, connect, differences
from duoframe.queries import ORACLE, QUERIES, ROWS

FOLDER = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert differences(got, con.sql(ORACLE[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert {n for names in ROWS.values() for n in names} == set(QUERIES)
