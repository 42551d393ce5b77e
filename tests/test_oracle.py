"""Every core query with SQL gives the rows of its SQL; every one without runs."""

import pytest

from poolcraft.queries import catalog

from compare import rows, tables


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, name):
    found = catalog.QUERIES[name](spark, data).toPandas()
    if name in catalog.SQL:
        wanted = tables(data).execute(catalog.SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
