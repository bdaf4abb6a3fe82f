"""Every registered query against its checking SQL (or for rows) at the smallest scale."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SLOW = {"train_position_models", "generate_lineups", "optimizer_job", "save_load_models", "candidate_lineups", "select_portfolio"}
EMPTY_AT_THIS_SCALE = {"name_fallback_join", "ambiguous_matches"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, con, sf_dir, name):
    problem = compare(spark, con, sf_dir, entry.queries()[name], entry.oracle_sql().get(name))
    assert problem == "" or (problem == "both empty" and name in EMPTY_AT_THIS_SCALE)


def test_oracles_name_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
