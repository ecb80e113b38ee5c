"""The registry's contract, and a sample of queries against their SQL.

``python tests/compare.py [folder]`` compares all of them.
"""

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from conftest import SMALL

SAMPLE = ["order_features", "customer_summary", "churn_table", "latest_warning", "churn_crosstab",
          "revenue_bucket_by_product", "robust_scale", "export_orders", "gower_to_landmarks"]


def test_every_statement_has_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, connection, SMALL, name, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
