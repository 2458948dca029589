import pytest

from tuplewise import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(name, spark, sf, same):
    same(queries.queries()[name](spark, sf), SQL[name])


@pytest.mark.parametrize("name, table", [("via_inverse_left_join", "lineitem"), ("exists_range", "lineitem"), ("arithmetic_precedence", "lineitem"), ("normalised_values", "orders")])
def test_whole_tables_are_read(name, table, spark):
    sf = "/root/testdata/sf0.01"
    assert queries.queries()[name](spark, sf).count() >= spark.read.parquet(f"{sf}/{table}.parquet").count()
