"""Every registered query that has an SQL form against that SQL in a second engine."""

import pytest

import __spark_entry__ as entry
import compare
from bundlelens.plans import oracles, registry
from conftest import SF01

SQL = oracles.oracle_sql()
MODEL_ONLY = {"model_scores", "fitted_auc", "model_confusion", "leading_features", "model_lift_table", "model_decile_profile"}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF01)


def test_only_model_output_has_no_sql():
    assert set(registry.queries()) - set(SQL) == MODEL_ONLY
    assert set(SQL) <= set(registry.queries()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, con, key):
    assert compare.differences(entry.queries()[key](spark, SF01), con, SQL[key]) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 12
