"""Every registered query against its SQL on DuckDB."""

import pytest

from biblioflow.plans import registry
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got) > 0
        return
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["k9_schema_org_json", "s20_item_information"])
def test_plans_hold_their_inputs_once(name, spark, sf_dir):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 200_000
