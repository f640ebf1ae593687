import pytest

import __spark_entry__ as entry
from tests.oracle import check
from weftline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_oracle(spark, sf, name):
    check(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_oracle_has_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_has_rows_and_a_stable_schema(spark):
    a, b = entry.entry(spark), entry.entry(spark)
    assert a.schema == b.schema and a.count() > 0


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
