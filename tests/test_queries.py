from __future__ import annotations

import pytest

from loomgraph import registry
from tests.compare import duck, rows


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert list(got.columns)
        return
    want = duck(sf_dir).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) > 0


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())
