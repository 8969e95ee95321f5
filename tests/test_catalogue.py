import pytest
from compare import assert_same

import __spark_entry__ as entry
from quaylight.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, tiny, name):
    assert_same(catalogue.QUERIES[name](spark, tiny), catalogue.ORACLES[name], tiny)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(spark, tiny, name):
    assert catalogue.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["query", "doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
