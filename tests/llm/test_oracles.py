"""Training-data queries that SQL can express, against their DuckDB oracle."""

import pytest

from lakejobs.llm.queries import ORACLE, QUERIES
from oracle import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf_dir, name):
    ok, msg = compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE[name])
    assert ok, msg


def test_one_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
