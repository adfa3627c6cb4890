"""Every core query against its SQL, or at least run, over the smallest tables."""

import pytest

from foliant import catalogue
from tests.conftest import oracle, rows

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    df = QUERIES[name](spark, folder)
    got = rows(df, *sorted(df.columns))
    if name in SQL:
        names, want = oracle(SQL[name], folder)
        assert sorted(df.columns) == names
        assert got == want
    else:
        assert got


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
