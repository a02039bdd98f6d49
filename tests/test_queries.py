"""Every registered query against its SQL on the same tables."""

import pytest
from compare import compare

import __spark_entry__ as entry
from marginalia.plans import load_catalog

QUERIES, ORACLES = load_catalog()
SF = "/root/testdata/sf0.01"


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    diff, rows, _ = compare(spark, name, QUERIES[name], ORACLES[name], SF)
    assert diff is None
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert {"r_name", "total", "open", "searched", "depth"} <= set(df.columns)
    assert df.count() > 0
