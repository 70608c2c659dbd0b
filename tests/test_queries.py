"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from tallywright.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n in QUERIES))
def test_matches_sql(spark, sf_dir, duck, name):
    assert compare(queries()[name](spark, sf_dir), duck, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle_sql())))
def test_gives_rows(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    board = entry(spark)
    assert board.columns == ["kind", "model", "strategy", "macro_f1", "accuracy", "mean_latency_s", "n"]
    assert board.count() == 16
