import pytest
from comparing import rows_of, sql_rows

import __spark_entry__ as entry
from revlens.plans import queries as own

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", own.QUERIES)
def test_equals_sql(spark, name):
    df = own.QUERIES[name](spark, SF)
    want, columns = sql_rows(own.ORACLE_SQL[name], SF)
    assert sorted(df.columns) == columns
    assert rows_of(df) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "revision_id", "additions", "deletions"]


def test_every_query_has_its_sql():
    assert own.QUERIES.keys() == own.ORACLE_SQL.keys()
    assert own.QUERIES.keys() <= entry.queries().keys()
