import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p5_found", "run_sums"} <= set(entry.queries())


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
