import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["idx", "cluster_id", "cluster_size"] and df.count() == 500


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
