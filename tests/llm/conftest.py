import random

import pytest
from pyspark.sql import types as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard int, H string, kept boolean, `odd name` int"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, further columns with names the operators use."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "ZETA", "eta", "θ"]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = body(30_000)
    same = body(40)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, long, "en", "b"), (5, long.upper(), "en", "b")]
    rows += [(10 + i, same, "en", "c") for i in range(40)] + [(None, same, None, "c"), (None, None, None, None)]
    rows += [(60, same, "en", "c")] * 5 + [(61, "One two", "de", "é"), (62, "one TWO", "de", "z")]
    rows += [(100 + i, body(rng.randint(1, 60)), "en", rng.choice(["a", "b", "c", None])) for i in range(80)]
    return spark.createDataFrame([(*r, 7, "s", 3, "h", True, 1) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def edge_labels(spark):
    rows = [(i, i % 2, int(i % 7 == 0)) for i in range(100, 180)] + [(None, 1, 1), (100, None, None), (101, 1, 1), (101, 0, 0), (999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def ids(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture
def sorted_rows():
    return ids


@pytest.fixture
def columns_of():
    return lambda df: [f.name for f in df.schema if not isinstance(f.dataType, T.NullType)]
