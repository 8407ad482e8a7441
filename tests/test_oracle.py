"""Every registered library query against its DuckDB oracle (the driver's correctness gate).

CHURNSCOPE_TEST_SF picks the scale (default sf0.001).
"""

import os

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare

SF = os.environ.get("CHURNSCOPE_TEST_SF", "/root/testdata/sf0.001")
ROWS_ONLY = {"progression_topology", "population_mahalanobis", "topology_summary", "comparison_summary",
             "final_synthesis"}


def test_every_query_has_oracle_or_is_declared_rows_only():
    assert set(E._QUERIES) - set(E._SQL) == ROWS_ONLY
    assert set(E._SQL) <= set(E._QUERIES)
    assert set(E._QUERIES) <= set(E.queries()) and set(E._SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(E._SQL))
def test_query_matches_oracle(spark, key):
    res = compare(spark, SF, [key])[key]
    assert res.startswith("OK"), res
