"""Training-data queries give the rows of their SQL on the smallest tables; the others run."""

import os

import pytest

from stallkit.llm.queries import QUERIES, SQL
from stallkit.session import local_session
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name):
    spark = local_session(cores="2", shuffle_partitions=3)
    if name in SQL:
        assert compare(spark, name, QUERIES[name], SQL[name], FOLDER) is None
    else:
        assert QUERIES[name](spark, FOLDER).count() >= 0
