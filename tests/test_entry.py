import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_every_sql_belongs_to_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "path", "in_degree", "centrality"] and df.count() == 10
