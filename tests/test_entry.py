import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 18 and all(0 <= r.auc <= 1 for r in rows)
