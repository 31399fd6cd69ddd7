"""Every query against its SQL on the smallest tables."""

import pytest

from conftest import DATA, same
from palimpsest.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(name, spark, duck):
    same(registry.QUERIES[name](spark, DATA), duck, registry.ORACLES[name])


def test_entry_and_names(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rerun_is_equal(spark):
    q = registry.QUERIES["bootstrap_ci_hash"]
    assert sorted(q(spark, DATA).collect()) == sorted(q(spark, DATA).collect())
