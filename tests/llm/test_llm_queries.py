"""Every query of the subpackage with SQL gives the rows of its SQL; every one without runs and gives distinct rows where they must be."""

import pytest

from poolcraft.llm import queries

from compare import rows, tables


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    found = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.SQL:
        assert rows(found) == rows(tables(data).execute(queries.SQL[name]).df())
    if name.endswith("_found"):
        assert not found.duplicated().any()
