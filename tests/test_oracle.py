"""Every core query with SQL gives the rows of its SQL on the smallest tables; the others run."""

import os

import pytest

from stallkit.plans import core
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data here")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    if name in core.SQL:
        assert compare(spark, name, core.QUERIES[name], core.SQL[name], FOLDER) is None
    else:
        assert core.QUERIES[name](spark, FOLDER).count() >= 0
