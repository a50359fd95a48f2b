"""Every registered query against its SQL on the given tables."""

import pytest

from votelens.queries import ORACLES, QUERIES

from .oracle import DATA, same


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLES[name])
