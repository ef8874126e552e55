import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["a", "b"] and df.count() > 0
