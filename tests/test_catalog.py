"""Every catalog query agrees with its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


# Learnt by rounds over shuffled texts: tested by its own figures instead.
BEYOND_SQL = {"learned_mentions", "learned_mention_accuracy"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | BEYOND_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, db, name):
    found = difference(QUERIES[name](spark, SF_DIR), db, ORACLES[name])
    assert found is None, found


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {row["step"] for row in rows} == {"votes", "model"}
    assert all(0 < row["n_correct"] <= row["n_attempted"] for row in rows)
