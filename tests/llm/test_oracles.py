"""Every registered query of the folder that has SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from tallywright.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) is None
