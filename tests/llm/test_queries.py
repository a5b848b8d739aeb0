"""Registered queries of the package against their SQL, and what all of them have in common."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in entry.LLM if n.startswith("op")) == list(range(1, 14)) and "pipeline" in entry.LLM


@pytest.mark.parametrize("name", [n for n, (_, sql) in entry.LLM.items() if sql])
def test_query_equals_sql(spark, name):
    problem, _, _, _ = compare(spark, name, SMALL)
    assert problem == ""
