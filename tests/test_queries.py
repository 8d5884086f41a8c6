"""Every named query against its SQL oracle, over whole tables."""

import pytest

from quillmark.plans import catalog
from tests.conftest import SF


def rows(frame, columns):
    values = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return sorted(map(repr, values))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_oracle(spark, duck, name):
    want = duck.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_has_rows(spark, name):
    found = catalog.QUERIES[name](spark, SF)
    assert found.count() > 0 and len(set(found.columns)) == len(found.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
