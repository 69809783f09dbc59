"""Every registered query against its SQL counterpart; queries without one must return rows."""

from __future__ import annotations

import pytest

from compare import connect, difference
from conftest import SF_DIR
from quire.plans import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    oracle = registry.oracle_sql().get(name)
    if oracle is None:
        assert df.count() > 0
    else:
        assert difference(df, duck, oracle) is None


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["lang"] for r in rows} == {"de", "en", "es", "fr"}
