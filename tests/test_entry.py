import __spark_entry__


def test_entry_and_registry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0].id == 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
