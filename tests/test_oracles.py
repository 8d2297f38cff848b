"""Every query with a SQL statement gives the same rows and types in DuckDB; the others give rows."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# Jobs of several minutes are covered by test_models on smaller settings; text operators have tests of their own.
SLOW = {"model_rf", "model_gbt", "model_mlp", "cv_scores"} | {n for n in QUERIES if n == "pipeline" or n.startswith("op")}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_matches_sql(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_gives_rows(spark, sf_dir, name):
    assert not QUERIES[name](spark, sf_dir).isEmpty()


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1000


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
