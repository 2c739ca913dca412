"""Every query that SQL can say, against DuckDB on the smallest tables."""

import importlib

import pytest
from conftest import canonical

from quireforge import plans

for _m in ("corpus", "text", "graph", "retrieval", "ingest"):
    importlib.import_module(f"quireforge.plans.{_m}")


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, small, duck, name):
    got, want = plans.QUERIES[name](spark, small).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_runs(spark, small, name):
    assert plans.QUERIES[name](spark, small).columns
    plans.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
