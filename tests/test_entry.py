import __spark_entry__


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).columns[:2] == ["stream_id", "chunk_id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
