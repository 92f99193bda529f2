import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import pack as P


def next_fit(sizes, capacity=3776):
    """The sequential rule: (bucket, position) of each entry."""
    out, fill, bucket, pos = [], 0, -1, 0
    for i, n in enumerate(sizes):
        if i == 0 or fill + n > capacity:
            bucket, fill, pos = bucket + 1, n, 0
        else:
            fill, pos = fill + n, pos + 1
        out.append((bucket, pos))
    return out


def check(spark, shards, chunk_rows, **kw):
    rows = [(s, o * 3, n) for s, sizes in shards.items() for o, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "shard string, ord long, entry_bytes long").repartition(5)
    got = {}
    for r in P.pack_next_fit(df, chunk_rows=chunk_rows, **kw).collect():
        got.setdefault(r.shard, []).append((r.ord, r.bucket, r.pos))
    for s, sizes in shards.items():
        want = [(o * 3, b, p) for o, (b, p) in enumerate(next_fit(sizes))]
        assert sorted(got.get(s, [])) == want


@pytest.mark.parametrize("chunk_rows", [3, 10, 1000, 1_000_000])
def test_same_as_sequential_for_any_chunk(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    shards = {
        "hot": [rng.choice([60, 61, 300, 900, 1080, 3776, 3777, 9000]) for _ in range(900)],
        "small": [rng.randint(60, 1100) for _ in range(200)],
        "one": [5000],
        "exact": [1888] * 20,
    }
    check(spark, shards, chunk_rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=80), st.integers(1, 40))
def test_property(spark, sizes, chunk_rows):
    check(spark, {"s": sizes}, chunk_rows)


def test_buckets(spark):
    rows = [("", 0, "a.py", "é" * 700), ("", 1, "b.js", "x" * 1000), ("", 2, "c.ts", "y" * 1500), ("", 3, "big.md", "z" * 9000)]
    df = spark.createDataFrame(rows, "shard string, ord long, path string, text string")
    entries = df.select("shard", "ord", F.octet_length(P.entry_text(F.col("path"), F.col("text"))).alias("entry_bytes"))
    got = {r.bucket: r for r in P.build_buckets(P.pack_next_fit(entries), df).collect()}
    assert [got[b].n_members for b in sorted(got)] == [2, 1, 1]
    first = got[0].text
    assert first.startswith(
        "<!-- GCS_BUCKET_MANIFEST_START: a.py, b.js -->\n\n--- GCS_FILE_START: a.py ---\n```py\n" + "é" * 700
        + "\n```\n--- GCS_FILE_END: a.py ---\n--- GCS_FILE_START: b.js ---\n```js\n"
    )
    assert "\n<!-- GCS_BUCKET_MANIFEST_END -->\n<!-- GCS_HYSTERESIS_PADDING_" in first
    assert len(first.encode()) == got[0].n_bytes == 4096
    assert got[2].n_blocks == 3


def test_positions_follow_the_order(spark):
    rows = [(f"p{i * 37 % 100:03d}",) for i in range(100)]
    df = P.with_positions(spark.createDataFrame(rows, "path string").repartition(4), "path")
    got = df.orderBy("ord").collect()
    assert [r.path for r in got] == sorted(p for (p,) in rows)
    assert len({r.ord for r in got}) == 100


def test_bucket_keys(spark):
    r = spark.range(1).select(
        P.bucket_key(F.lit(""), F.lit(3)).alias("a"), P.bucket_key(F.lit("src1"), F.lit(3)).alias("b")
    ).first()
    assert (r.a, r.b) == ("COMMON_BUCKET_3", "COMMON_BUCKET_src1_3")
