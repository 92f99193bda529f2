"""The registered queries of the training-data operators beside their SQL."""

import pytest

from tidemark.llm import queries
from tools.compare import compare, duck

FUNCTIONS = {fn.__name__: fn for fn in queries.QUERIES}


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in FUNCTIONS)
    assert numbers == list(range(1, 14))
    assert set(queries.SQL) <= set(FUNCTIONS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf_dir, name):
    err, n = compare(spark, duck(sf_dir), FUNCTIONS[name], queries.SQL[name], sf_dir)
    assert err is None
    assert n > 0
