"""SimHash near duplicates: brute force and edges."""

import random
import re

import numpy as np
import xxhash

from tidemark.llm import near_dedup as N


def brute_fingerprint(text, width=4):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "A b", "a b c d", "É\x85x  The\tquick Brown fox jumps\x0bover", "w " * 50]
    texts += [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (3, 4, 5, 300)]
    for t in texts:
        assert N.fingerprint(t) == brute_fingerprint(t)
    cut = N.pieces
    monkeypatch.setattr(N, "pieces", lambda data, *a: cut(data, b" \t\n\r\x0b\x0c", 17))
    for t in texts:
        assert N.fingerprint(t) == brute_fingerprint(t)


def test_trees_find_all_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 700, dtype=np.uint64)
    near = base[:400].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    dense = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, dense]))
    for radius in (4, 9):
        groups = N.Groups(len(fps))
        for segment in N.segments(radius):
            of = N.link_points(N.Points(fps, radius), segment, leaf=32)
            away = np.flatnonzero(of != np.arange(len(fps)))
            groups.link(away, of[away])
        want = brute_components([int(x) for x in fps], radius)
        pairs = {(a, b) for a, b in zip(groups.of.tolist(), want)}
        assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def test_near_duplicates_against_brute_force(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    want = brute_components([brute_fingerprint(t) for _, t in rows], 4)
    least = {}
    for (i, _), c in zip(rows, want):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    expect = sorted(((i, f"{brute_fingerprint(t):016x}", least[c]) for (i, t), c in zip(rows, want)), key=repr)
    # shards of few points and cells of fewer: many levels, rings and blocks
    for sizes in ({}, {"shard_rows": 8, "cell_rows": 5}):
        df = N.near_duplicates(edge_docs, **sizes)
        got = df.select("id", N.fingerprint_hex(df["fp"]).alias("f"), "component_id").collect()
        assert sorted((tuple(r) for r in got), key=repr) == expect
    assert N.near_duplicates(no_docs).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i + 1, i) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(2001, 2000)]
    got = dict(N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 50)} | {2001: 2000}


def test_one_of_each_links_edited_copies_only(spark, edge_docs, no_docs):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    rows, clean = [], []
    for k in range(30):
        base = [rng.choice(words) for _ in range(200)]
        clean.append(k * 10)
        rows.append((k * 10, " ".join(base)))
        for c in (1, 2):
            edited = base.copy()
            edited[rng.randrange(200)] = "edited"
            rows.append((k * 10 + c, " ".join(edited)))
        half = base[:100] + [rng.choice(words) for _ in range(100)]
        rows.append((k * 10 + 5, " ".join(half)))
        clean.append(k * 10 + 5)
    got = {r["doc_id"] for r in N.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(clean) <= got
    assert len(got - set(clean)) <= 3
    out = N.one_of_each(edge_docs)
    assert out.columns == edge_docs.columns
    left = [r["doc_id"] for r in out.collect()]
    assert len(left) == len(set(left))
    assert N.one_of_each(no_docs).count() == 0


def test_one_of_each_keeps_one_row_of_each_group(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(None, text()) for _ in range(6)] + [(1, text()) for _ in range(4)] + [(None, None)]
    copies = [(2, rows[6][1]), (None, rows[0][1]), (2, rows[0][1]), rows[7]]  # a repeated row, copies with other ids or none
    got = [tuple(r) for r in N.one_of_each(spark.createDataFrame(rows + copies, "doc_id bigint, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(2, rows[0][1]), *rows[1:]], key=repr)


def edited_pairs(seed, pairs, n_words):
    """Rows (2k, text), (2k + 1, its edited copy) and the true similarity of each pair, over all levels from 0.7 on."""
    rng, rows, true = random.Random(seed), [], []
    for k in range(pairs):
        base = [f"p{k}w{rng.randrange(10**5)}" for _ in range(n_words)]
        copy = base.copy()
        for i in rng.sample(range(n_words), rng.randint(1, n_words // 25)):
            copy[i] = f"edit{rng.randrange(10**6)}"
        a, b = ({" ".join(w[i:i + 5]) for i in range(n_words - 4)} for w in (base, copy))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        true.append(len(a & b) / len(a | b))
    return rows, true


def test_one_of_each_links_every_similarity_from_the_threshold_on(spark):
    rows, true = edited_pairs(9, 150, 100)
    passage = " ".join(f"license{i}" for i in range(12))  # common to all, so that keys are shared by unlike texts
    rows = [(i, f"{t} {passage}") for i, t in rows]
    sets = {i: {" ".join(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    want = {2 * k for k in range(150)} | {2 * k + 1 for k in range(150) if 5 * len(sets[2 * k] & sets[2 * k + 1]) < 4 * len(sets[2 * k] | sets[2 * k + 1])}
    near = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(150)]
    assert sum(0.8 <= j < 0.9 for j in near) > 10 and sum(0.7 <= j < 0.8 for j in near) > 10
    assert {r["doc_id"] for r in N.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == want


def test_large_keys_meet_in_blocks(spark):
    """One passage fills most of the prefix of many unlike texts; all pairs that are alike are found, each once."""
    rng = random.Random(3)
    met = [(1, i, 50, rng.randrange(3), i // 2 if i < 40 else i, 10_000) for i in range(10_000)] + [(2, i, 50, 0, i, 3) for i in range(3)]
    df = spark.createDataFrame(met, "key bigint, node bigint, n int, at int, root bigint, k bigint")
    some = df.filter("node < 60")
    got = [(r[0], r[1], r[2]) for r in N._all_pairs(some).select("x.key", "x.node", "y.node").collect()]
    want = [(1, a, b) for a in range(60) for b in range(a) if not (a < 40 and b < 40 and a // 2 == b // 2)] + [(2, a, b) for a in range(3) for b in range(a)]
    assert sorted(got) == sorted(want)


def test_spreads_leave_no_link_out(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        base = rng.integers(0, 2**64, int(rng.integers(1, 400)), dtype=np.uint64)
        other = base.copy()
        at = rng.random(len(base)) < rng.choice([0.02, 0.1, 0.2, 0.6])
        other[at] = rng.integers(0, 2**64, at.sum(), dtype=np.uint64)
        spread = [np.bincount((x >> np.uint64(56)).astype(int), minlength=256).astype("<u2").tobytes() for x in (base, other)]
        same = len(np.intersect1d(base, other))
        rows.append((k, 1000 + k, len(base), len(other), bytearray(spread[0]), bytearray(spread[1]), bool(9 * same >= 4 * (len(base) + len(other)))))
    df = spark.createDataFrame(rows, "a bigint, b bigint, n int, m int, p binary, q binary, linked boolean")
    kept = {r["a"] for r in N.can_share(df, (4, 5)).collect()}
    assert {r[0] for r in rows if r[-1]} <= kept
    assert len(kept) < 250


def test_likeness():
    a, b = ("".join(f"w{i} " for i in range(n, n + 300)) for n in (0, 20))
    sketch = np.stack([np.frombuffer(N.sketch_text(t, 5)[1], np.uint8) for t in (a, b)])
    true = (296 - 20) / (296 + 20)
    assert abs(float(N.likeness(sketch[:1], sketch[1:])[0]) - true) < 0.1


def test_stage_compares_what_the_fingerprints_link(spark, monkeypatch):
    base = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:-i], *[f"end{i}x{j}" for j in range(i)]])) for i in (1, 2, 3)] + [(9, " ".join(f"other{i}" for i in range(300)))]
    seen = []
    links = N.Alike.links
    monkeypatch.setattr(N.Alike, "links", lambda self, pairs: seen.append(pairs.count()) or links(self, pairs))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in N.one_of_each(docs).collect()) == [1, 9]
    assert seen[0] == 2  # two of three stars, by fingerprints alone


def test_fingerprint_pairs_are_stars(spark):
    points = spark.createDataFrame([(1, 0), (2, 0), (3, 0b1111), (4, 0b11111111), (5, -1)], "node bigint, fp bigint")
    assert sorted(tuple(r) for r in N.fingerprint_pairs(points).collect()) == [(2, 1), (3, 1), (4, 1)]


def test_shingles_are_counted_in_every_document(spark):
    texts = [f"a b c d w{i}" for i in range(9_000)] + ["A b c d w0 w1", "a b c d w7 a b c d w7", None, "", "one two"]
    want = np.zeros(N.BUCKETS, np.int64)
    for t in texts:
        words = (t or "").lower().split()
        found = {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())
        for s in found:
            want[xxhash.xxh64_intdigest(s.encode(), N.SEED) % N.BUCKETS] += 1
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    assert (N.shingle_counts(docs, 5) == want).all()
    assert want.sum() == 9_000 + 2 + 5 + 1
    assert not N.shingle_counts(docs.limit(0), 5).any()
