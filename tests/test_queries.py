"""Every query runs, and gives what its SQL gives where SQL states it."""

import pytest
from helpers import oracle, rows

import attestor.plans.more_queries  # noqa: F401
import attestor.plans.record_queries  # noqa: F401
import attestor.plans.text_queries  # noqa: F401
from attestor.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    if name not in SQL:
        assert len(got.columns) > 0
        return
    want = oracle(small).sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
