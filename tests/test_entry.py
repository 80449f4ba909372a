import __spark_entry__ as contract


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["hour", "cell", "visitors"] and df.count() > 0


def test_every_oracle_has_a_query():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(f) for f in queries.values())
