import __spark_entry__


def test_entry_points(spark):
    names = __spark_entry__.queries()
    assert len(names) >= 50 and set(__spark_entry__.oracle_sql()) <= set(names)
    assert __spark_entry__.entry(spark).count() >= 1
