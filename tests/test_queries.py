"""Every query of the reference's own operators against its SQL."""

import oracle
import pytest

from palimpsest.jobs import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    got, want = oracle.both(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert got == want


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_iterative_queries(spark):
    m = registry.QUERIES["mixed_model"](spark, oracle.SF_DIR).collect()
    assert [r.term for r in m] == ["Intercept", "week"] and all(0 <= r.icc < 1 and 0 <= r.p <= 1 for r in m)
    assert registry.QUERIES["log_rank"](spark, oracle.SF_DIR).first().df == 4
