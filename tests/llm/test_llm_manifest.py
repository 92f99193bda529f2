"""Merkle manifest, exact top-k search and target resampling beside brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, pivot_search, queries, target_resampling
from tidemark.llm.common import table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    """All levels of a tree, from its leaves to its root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def climb(tree, at, node):
    """What a node folds to, and its siblings."""
    proof = []
    for level in tree[:-1]:
        run = level[at // 2 * 2:at // 2 * 2 + 2]
        proof += run[:at % 2] + run[at % 2 + 1:]
        run[at % 2] = node
        at, node = at // 2, sha("".join(run))
    return node, proof


def brute_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(part, r)))
    first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    trees = {}
    for r in rows:  # doc_id, source, lang, n_chars, text
        trees.setdefault(r[2], []).append((first(r[0]), leaf(r), r))
    names = sorted(trees, key=first)
    for n in names:
        trees[n].sort(key=lambda x: x[:2])
    built = {n: levels([x[1] for x in trees[n]]) for n in names}
    top = levels([built[n][-1][0] for n in names])
    out = []
    for at, n in enumerate(names):
        for pos, (_, own, r) in enumerate(trees[n]):
            forged = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            tried = leaf((*r[:3], r[3] + 1, r[4])) if forged else own
            low, proof = climb(built[n], pos, tried)
            high, more = climb(top, at, low)
            out.append((r[0], own, built[n][-1][0], top[-1][0], sha("".join(proof + more)), high, high == top[-1][0]))
    return sorted(out, key=repr)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof", "folded", "verified")


def manifest_rows(df):
    rows = merkle.verified_manifest(df).select(*MANIFEST).collect()
    return sorted((tuple(v.hex() if isinstance(v, (bytes, bytearray)) else v for v in r) for r in rows), key=repr)


def test_appends_give_the_tree_of_levels():
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 31, 33, 100):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        tree = levels([x.hex() for x in leaves])
        root, found = merkle.block_root(leaves, True, True)
        assert root.hex() == tree[-1][0]
        for at, (x, w) in enumerate(zip(leaves, found)):
            assert merkle.fold(x, bytes(w)) == root
            assert [s.hex() for side, s in merkle.steps(bytes(w)) if side != merkle.LONE] == climb(tree, at, x.hex())[1]


def test_manifest(spark, edge_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select(*merkle.LEAF).collect()]
    assert manifest_rows(edge_docs) == brute_manifest(rows)
    assert manifest_rows(no_docs) == []


def test_manifest_of_several_blocks(spark):
    rng = np.random.default_rng(3)
    n = 2 * merkle.BLOCK + 77  # one language over three blocks, one of a single row, one without name
    rows = [(int(rng.integers(1000)), "s", "en", int(i), f"t{i % 50}") for i in range(n)]
    rows += [(i, None, None, i, "x") for i in range(merkle.BLOCK)] + [(1, "s", "", 1, ""), (None, None, "z", None, None)] + [(7, "s", "eq", 1, "same")] * 600
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = manifest_rows(df)
    assert got == brute_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)
    wide = merkle.manifest(df)  # the witness itself, not what the query derives from it
    assert {len(list(merkle.steps(bytes(r.witness)))) for r in wide.filter("pos = 0").collect()} == {12 + 3, 10 + 3, 0 + 3}


def brute_top(rows, k, every):
    """(query_id, rank, vec_id, score) of (vec_id, embedding)."""
    ok = [(i, [math.floor(256 * float(x)) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (i, e) in enumerate(ok):
        if i is None or i % every:
            continue
        found = [(-sum(x * y for x, y in zip(e, f)), j is None, j or 0, j) for b, (j, f) in enumerate(ok) if a != b and len(e) == len(f)]
        out += [(i, n + 1, f[3], -f[0]) for n, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_top_k_of_hard_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)] + [(50, [0.5] * 6), (50, [0.5] * 6), (None, [0.5] * 6), (100, [0.0] * 6)]
    rows += [(150, None), (200, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (250, [float("nan")] * 6), (300, [float("inf")] * 6)]
    rows += [(2000, [1.0, -1.0]), (2001, [0.25, 3.0]), (2050, []), (2051, []), (5000, [1.0] * 9)]
    rows += [(3000, [3e6] * 6), (3001, [-2.5e6] * 6)]  # products beyond 2^53
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rank int, cell int").repartition(4)
    got = sorted(map(tuple, pivot_search.top_k(df, 5, 50).collect()), key=repr)
    assert got == brute_top(rows, 5, 50)
    assert pivot_search.top_k(df.limit(0), 5, 50).count() == 0
    assert sorted(map(tuple, pivot_search.top_k(df, 3, 50, pivots=1).collect()), key=repr) == brute_top(rows, 3, 50)


def test_top_k_leaves_candidates_out(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 4
    near = [centres[i % 40] + rng.normal(size=16) * 0.05 for i in range(5000)]
    unit = [(v / np.linalg.norm(v)).tolist() for v in near]
    df = spark.createDataFrame(list(enumerate(unit)), "vec_id long, embedding array<float>")
    rows = [tuple(r) for r in df.collect()]
    top, seen = pivot_search.Index(df, "vec_id", "embedding", F.col("vec_id") % 500 == 0).search(5)
    assert sorted(map(tuple, top.collect()), key=repr) == brute_top(rows, 5, 500)
    evaluated = [r.evaluated for r in seen.collect()]
    assert len(evaluated) == 10
    assert max(evaluated) < 1000  # of 4,999


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def features(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return w + [a + b" " + b for a, b in zip(w, w[1:])]


def brute_resample(docs, target, buckets=10_000):
    at = lambda f: zlib.crc32(f) % buckets
    s, t = (Counter(at(f) for x in texts for f in features(x)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s_all + buckets) / ((s[i] + 1) * (t_all + buckets)))) for i in range(buckets)]
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(gain[at(x)] for x in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((o for o in out if o[1] >= 39), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for n, o in enumerate(fit[:25 * len(fit) // 100]):
        o[4] = n + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("kind", ["documents", "edges"])
def test_resample(spark, sf_dir, edge_docs, kind):
    target = table(spark, sf_dir, "benchmark")
    docs = edge_docs if kind == "edges" else table(spark, sf_dir, "documents")
    if kind == "edges":  # lines: repeated, blank, of one word, with marks and other line ends
        lines = ["Alpha beta\n\n \nbeta", "Alpha beta\nalpha BETA\n", "\n\nx", "a\rb\nc\x0bd\n" * 30, "-- \n alpha\n!!\nbeta " * 20]
        more = spark.createDataFrame([(300 + i, t) for i, t in enumerate(lines * 3)], "doc_id long, text string")
        docs = docs.select("doc_id", "text", F.lit(1).alias("weight"), F.lit("x").alias("line")).unionByName(
            more.select("doc_id", "text", F.lit(2).alias("weight"), F.lit("y").alias("line"))
        )
    got = sorted(map(tuple, target_resampling.resample(docs, target).collect()), key=repr)
    want = brute_resample([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    assert got == want
    assert sum(r[4] is not None for r in got) > 5


def test_resample_without_rows(spark, edge_docs, no_docs):
    assert target_resampling.resample(no_docs, edge_docs).count() == 0
    some = edge_docs.filter("doc_id >= 100").select("doc_id", "text")
    got = sorted(map(tuple, target_resampling.resample(some, no_docs).collect()), key=repr)
    assert got == brute_resample([tuple(r) for r in some.collect()], [])


def test_long_lines_are_counted_in_pieces(spark):
    words = [f"w{i % 977}" for i in range(400_000)]  # one line of over 2 MB, twice
    df = spark.createDataFrame([(" ".join(words),), ("  ".join(words),), ("w1 w2\nw3",)], "text string")
    got = target_resampling.bucket_counts(F.col("text"), df, 101)
    want = Counter(zlib.crc32(f) % 101 for f in features(" ".join(words)))
    rest = Counter(zlib.crc32(f) % 101 for f in features("w1 w2 w3"))
    assert [int(x) for x in got] == [2 * want[i] + rest[i] for i in range(101)]


def test_manifest_query_gives_hex(spark, sf_dir):
    row = queries.op11_merkle(spark, sf_dir).first()
    assert all(re.fullmatch("[0-9a-f]{64}", row[c]) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
