import __spark_entry__ as entry_point


def test_every_sql_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_the_flagship_runs(spark):
    assert entry_point.entry(spark).count() > 0
