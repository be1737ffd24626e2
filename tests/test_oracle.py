"""Every registered query of the lake operators against its DuckDB oracle."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as E
from lakejobs.plans import registry
from oracle import compare, duck

# the training-data queries have tests of their own
NAMES = sorted(registry.ORACLE)  # an index search has none: see test_properties


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = E.queries()[name](spark, sf_dir)
    ok, msg = compare(df, con, E.oracle_sql()[name])
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_lake_queries_work_without_the_training_subpackage():
    """Import and query names with the subpackage and its pipeline hidden."""
    code = ("import sys; sys.modules['corpus_pipeline'] = None; sys.modules['lakejobs.llm'] = None\n"
            "import __spark_entry__ as e; from lakejobs.plans import registry\n"
            "assert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.ORACLE)")
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(E.__file__), check=True)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["ingested_day", "event_type", "n_events", "n_users"]
    assert df.count() > 0
