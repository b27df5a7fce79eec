"""Every registered query of the engine against its SQL."""

import pytest

from lodestrata.queries import ORACLE_SQL, QUERIES
from tests.compare import duck_rows, spark_rows
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    if name not in ORACLE_SQL:
        assert columns
        return
    expected_columns, expected = duck_rows(ORACLE_SQL[name], SF)
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
