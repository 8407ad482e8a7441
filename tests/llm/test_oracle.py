"""Registered queries against their SQL, as the driver compares them."""

import pytest

from tests import oracle_check
from churnscope.llm import queries as Q


@pytest.mark.parametrize("key", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, key):
    assert oracle_check.compare(spark, "/root/testdata/sf0.001", [key])[key].startswith("OK")


def test_registered_names():
    names = sorted(Q.queries())
    assert [n for n in names if n == "pipeline" or n.startswith("op")] == names
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
