"""Exact dedup, mixing and sharding: brute force and edges."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import exact_dedup, mixing, sharding

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(text):
    return (text or "").translate(UPPER)


def test_dedup_against_brute_force(edge_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r["doc_id"])
    # few counters: most digests take the ordinary way, the heavy ones the broadcast
    for limits in ({}, {"candidates": 2, "counters": 16}):
        got = exact_dedup.find_duplicates(edge_docs, **limits).collect()
        assert len(got) == len(rows)
        by_digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
        kept = Counter()
        for g in got:
            own = by_digest[g["digest"]]
            assert g["group_size"] == len(own)
            assert g["keep_id"] == max((i for i in own if i is not None), default=None)
            kept[g["digest"]] += g["kept"]
            assert not g["kept"] or g["id"] == g["keep_id"]
        assert set(kept.values()) == {1}


def test_drop_duplicates_keeps_columns(edge_docs, no_docs):
    got = exact_dedup.drop_duplicates(edge_docs)
    assert got.columns == edge_docs.columns
    texts = [norm(r["text"]) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r["text"]) for r in edge_docs.collect()})
    assert exact_dedup.find_duplicates(no_docs).count() == 0
    assert exact_dedup.drop_duplicates(no_docs).count() == 0


def sizes_of(docs):
    out = Counter()
    for r in docs.collect():
        out[r["source"]] += len([w for w in (r["text"] or "").replace("\n", " ").replace("\t", " ").split(" ") if w])
    return out


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
            left -= target[s]
        open_ -= over or open_
    return target


@pytest.mark.parametrize("chunk", [4, 128])
def test_mix_targets_and_rounding(edge_docs, chunk):
    sizes, rows = sizes_of(edge_docs), mixing.mix(edge_docs, chunk=chunk).collect()
    target = brute_targets(sizes)
    assert sum(r["copies"] for r in rows) == edge_docs.count()
    taken, largest = Counter(), Counter()
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(target[s], rel=1e-9)
        rate = target[s] / sizes[s] if sizes[s] else 0
        if r["size"]:
            assert abs(r["times"] - rate * r["copies"]) < 1 + 1e-6
        assert r["times"] <= 3 * r["copies"]
        taken[s] += r["times"] * r["size"]
        largest[s] = max(largest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-3
    again = mixing.mix(edge_docs.repartition(7), chunk=chunk).collect()
    key = lambda r: (str(r["source"]), str(r["id"]), r["h"], r["times"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_rounding_is_fair_on_average(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 5 as int)) as text", "if(id < 1000, 'a', 'b') as source")
    rows = [r for r in mixing.mix(docs, weights=(1, 4)).collect() if r["source"] == "a"]
    rate = rows[0]["target"] / rows[0]["source_size"]
    for size in range(1, 6):
        own = [r["times"] for r in rows if r["size"] == size]
        assert sum(own) / len(own) == pytest.approx(rate, abs=0.1)


def test_mixed_rows(edge_docs, no_docs):
    got = mixing.mixed_rows(edge_docs)
    assert got.columns == edge_docs.columns
    want = Counter()
    for r in mixing.mix(edge_docs).collect():
        want[r["id"]] += r["times"]
    have = Counter(r["doc_id"] for r in got.collect())
    assert {k: v for k, v in want.items() if v} == dict(have)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


def test_shards(edge_docs, no_docs):
    for shards, ranges in ((4, 8), (16, 1024)):
        rows = sharding.assign_shards(edge_docs, shards, ranges=ranges).collect()
        assert len(rows) == edge_docs.count()
        slots, size, texts = defaultdict(list), Counter(), {}
        for r in edge_docs.collect():
            texts.setdefault(r["doc_id"], []).append((r["text"] or "").encode())
        for r in rows:
            assert any(r["size"] == len(t) + 1 and r["crc"] == zlib.crc32(t) for t in texts[r["id"]])
            slots[r["shard"]].append(r["slot"])
            size[r["shard"]] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert set(slots) <= set(range(shards))
        mean, most = sum(size.values()) / shards, max(r["size"] for r in rows)
        assert all(abs(size[s] - mean) <= most + 0.04 * mean for s in range(shards))
    assert sharding.assign_shards(no_docs).count() == 0


def test_sharded_documents(edge_docs, no_docs):
    got = sharding.shard_documents(edge_docs)
    assert set(got.columns) == {*edge_docs.columns, "slot"} and got.count() == edge_docs.count()
    placed = {(r["shard"], r["slot"]) for r in got.collect()}
    assert len(placed) == edge_docs.count()
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in edge_docs.collect())
    assert sharding.shard_documents(no_docs).count() == 0


def test_a_text_copied_into_most_rows_is_spread(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 10 = 0, concat('t', id), 'the same text') as text")
    size = Counter()
    for r in sharding.assign_shards(docs, 8, ranges=64).collect():
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) <= 40


def test_plans_are_native(edge_docs):
    for df in (exact_dedup.find_duplicates(edge_docs), mixing.mix(edge_docs), sharding.assign_shards(edge_docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
