"""A few registered queries against their SQL; ``check.py`` runs them all."""

import pytest

import __spark_entry__ as entry
from check import comparable, connect

SAMPLE = [
    "fold_names", "parse_features", "eligible_items", "coedges", "node_degree", "dedup_titles",
    "bfs_distances", "path_details", "cross_tier_override", "catalog_match", "trailing_rate", "top_collaborators",
]


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, tiny, duck, name):
    got = entry.queries()[name](spark, tiny).toPandas()
    wanted = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert comparable(got).equals(comparable(wanted))


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_check_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
