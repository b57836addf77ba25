"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf_dir, con):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


def test_near_duplicates_are_near_and_stable(spark, sf_dir):
    first = sorted(map(tuple, QUERIES["near_duplicates"](spark, sf_dir).collect()))
    again = QUERIES["near_duplicates"](spark, sf_dir)
    assert first == sorted(map(tuple, again.collect())) and len(first) == len(set(first))
    ratios = [r for row in first for r in row if isinstance(r, float)]
    assert all(0.94 <= r < 1 for r in ratios)


def test_classifier_scores_are_shares(spark, sf_dir):
    rows = QUERIES["classifier_eval"](spark, sf_dir).collect()
    values = [v for row in rows for v in row if isinstance(v, float)]
    assert rows and values and all(0 <= v <= 1 for v in values)


def test_queries_without_sql_have_tests_of_their_own():
    own = {"near_duplicates", "classifier_eval"}
    assert {n for n in set(QUERIES) - set(ORACLES) if not n.startswith("op") and n != "pipeline"} == own


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
