"""Decontamination, quality and toxicity: brute force, held-out accuracy and edges."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import decontamination as D
from tidemark.llm import quality as Q
from tidemark.llm import toxicity as X


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_matches(texts, items, window):
    out = []
    for t in texts:
        w, hit, names, longest = words(t), set(), set(), 0
        for name, text in items:
            v = words(text)
            k = min(window, len(v))
            parts = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in parts:
                    hit.update(range(i, i + k))
                    names.add(name)
            for i in range(len(w)):
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    longest = max(longest, n if n >= k else 0)
        out.append((len(w), len(hit), sorted(names), longest))
    return out


def test_suffix_arrays_against_brute_force():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)] + ["é", "Ü9"]
    for _ in range(15):
        window = rng.choice([3, 4, 13])
        items = [(str(i), rng.choice(" -\n").join(rng.choice(vocabulary) for _ in range(rng.randint(0, 20)))) for i in range(6)]
        texts = [None, ""] + [" ".join(rng.choice([*vocabulary, "zz"]) for _ in range(rng.randint(1, 60))) for _ in range(6)]
        texts += [f"Foo {rng.choice(items)[1]} baz, {rng.choice(items)[1].replace('w', 'W')}" for _ in range(4)]
        suffixes = D.Suffixes.of(items, window)
        for size in (10, 50, 1 << 20):
            got = D.search_texts(texts, suffixes, size)
            for g, (n, n_hit, names, _) in zip(got, brute_matches(texts, items, window)):
                assert (g["n_words"], sum(b - a + 1 for a, b in D._spans(g["hits"])), sorted(g["items"])) == (n, n_hit, names)
        for t in texts:  # alone in its shard, a text gets its own longest match
            assert D.search_texts([t], suffixes)[0]["longest"] == brute_matches([t], items, window)[0][3]


def test_every_text_of_a_shard_gets_its_longest_match():
    rng = random.Random(12)
    for _ in range(10):
        items = [(str(i), " ".join(rng.choice("abcd") for _ in range(rng.randint(4, 15)))) for i in range(4)]
        shared = [f"x {t} y" for _, t in items]
        texts = [rng.choice(shared) for _ in range(8)] + [" ".join(rng.choice("abcdz") for _ in range(40)) for _ in range(4)] + [None]
        for size in (30, 1 << 20):
            got = D.search_texts(texts, D.Suffixes.of(items, 3), size)
            for t, g, (_, _, _, longest) in zip(texts, got, brute_matches(texts, items, 3)):
                assert g["longest"] == longest
                assert (g["longest_at"] is None) == (g["longest_item"] is None) == (longest == 0)
                if longest:
                    part = words(t)[g["longest_at"]:g["longest_at"] + longest]
                    assert " ".join(part) in dict(items)[g["longest_item"]] and len(part) == longest


def test_blocks_of_items_add_up(spark, edge_docs, no_docs):
    base = [r["text"] for r in edge_docs.filter("doc_id >= 100").limit(6).collect()]
    items = [(i, t) for i, t in enumerate(base)] + [(7, None), (8, ""), (9, base[0]), (None, base[1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = D.find_matches(edge_docs, bench, carry=["doc_id"]).collect()
    parts = D.find_matches(edge_docs, bench, carry=["doc_id"], block_bytes=300).collect()
    key = lambda r: repr([r[c] for c in ("doc_id", "n_words", "hits", "items")])
    assert sorted(map(key, whole)) == sorted(map(key, parts))
    assert len(whole) == edge_docs.count()
    clean = D.decontaminate(edge_docs, bench)
    assert clean.columns == edge_docs.columns
    bad = sum(D.contaminated(sum(h["last"] - h["first"] + 1 for h in r["hits"]), r["n_words"]) for r in whole)
    assert 0 < bad and clean.count() == edge_docs.count() - bad
    assert D.find_matches(no_docs, bench).count() == 0
    assert D.decontaminate(edge_docs, bench.limit(0)).count() == edge_docs.count()


def test_log_weights_against_brute_force(edge_docs, edge_labels):
    r = Q.Resampler(edge_docs, edge_labels)
    rows = edge_docs.select("doc_id", "text").collect()
    known = dict(r.known.collect())
    raw, good = Counter(), Counter()

    def grams(t):
        w = (t or "").encode().split()
        import zlib
        h = [zlib.crc32(x) for x in w]
        mask = (1 << 64) - 1
        pairs = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & mask) >> 33 for a, b in zip(h, h[1:])]
        return Counter([x % Q.BUCKETS for x in h] + [x % Q.BUCKETS + Q.BUCKETS for x in pairs])

    for d in rows:
        raw += grams(d["text"])
        if known.get(d["doc_id"]) == 1:
            good += grams(d["text"])

    def weight(d):
        own = grams(d["text"])
        target = good - own if known.get(d["doc_id"]) == 1 else good
        total = 0.0
        for g, n in own.items():
            half = g >= Q.BUCKETS
            size = lambda c: sum(v for k, v in c.items() if (k >= Q.BUCKETS) == half)  # noqa: E731, B023
            total += n * (math.log((target[g] + 1) / (size(target) + Q.BUCKETS)) - math.log((raw[g] + 1) / (size(raw) + Q.BUCKETS)))
        return Q.LENGTH * total / (sum(own.values()) + Q.SHRINK)

    want = Counter((d["doc_id"], round(weight(d), 6)) for d in rows)
    assert Counter((x["id"], round(x["log_weight"], 6)) for x in r.result().collect()) == want


def test_kth_largest(spark):
    values = [1.5] * 40 + [float(i) for i in range(-20, 60)] + [1e-9, 2e-9]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    for k in (1, 2, 7, 55, 60, 100, len(values)):
        assert Q.kth_largest(df, k, bins=8) == sorted(values, reverse=True)[k - 1]


def test_quality_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["id"]: r["kept"] for r in Q.resample(docs, labels).collect()}
    seen = [(got[r["doc_id"]], r["quality"]) for r in labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()]
    good, bad = [k for k, q in seen if q == 1], [k for k, q in seen if q == 0]
    assert sum(good) / len(good) > 0.93 and sum(bad) / len(bad) < 0.2


def test_quality_edges(edge_docs, edge_labels, no_docs, no_labels):
    for k in (0, 1, 25):
        n = Q.resample(edge_docs, edge_labels, k=k).filter("kept").count()
        assert n >= k and n <= k + 45  # equal rows stay together
    r = Q.Resampler(edge_docs, edge_labels, k=30)
    out = r.drawn(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == r.result().filter("kept").count()
    assert Q.keep_good(edge_docs, no_labels).count() == edge_docs.count()
    assert Q.keep_good(no_docs, edge_labels).count() == 0


def test_block_max_search_is_exact():
    rng = random.Random(6)
    vector = lambda most: tuple(np.array(x, np.int64) for x in zip(*Counter(rng.choices(spread, k=rng.randint(1, most))).items()))
    none, spread = (np.zeros(0, np.int64),) * 2, [w for w in range(30) for _ in range(1 if w else 12)]
    vectors = [vector(12) for _ in range(290)] + [none] * 10
    idf = np.array([1 + rng.random() * 3 for _ in range(30)])
    index = X.Index.build(vectors, idf, list(range(300)), np.array([i % 2 for i in range(300)]), np.ones(300), k=7, block=8)

    def dense(v):
        w = np.zeros(30)
        n, x = X.unit_vector(v, idf)
        w[n] = x
        return w

    all_ = np.stack([dense(v) for v in vectors])
    visited = 0
    assert 0 < len(index.matrix) < 30
    queries = [vector(9) for _ in range(95)] + [none] * 5
    for v, (near, cosine, blocks) in zip(queries, index.search(queries)):
        scores = all_ @ dense(v)
        order = np.lexsort((np.arange(300), -np.round(scores, 10)))[:7]
        order = order[scores[order] > 0]
        assert list(near) == list(order) and np.allclose(cosine, scores[order])
        visited += blocks
    assert visited < 100 * index.n_blocks  # some blocks were skipped


def test_toxicity_on_held_out_labels(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["id"]: r["score"] for r in X.score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    seen = [(got[r["doc_id"]] >= 0.5, r["toxic"] == 1) for r in labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()]
    assert sum(a == b for a, b in seen) / len(seen) > 0.93


def test_toxicity_against_brute_force(spark, edge_docs, edge_labels):
    """Scores and evidence from the texts alone: all terms of the examples, dense vectors, every example compared."""
    rows = edge_docs.select("doc_id", "text").collect()
    labels = {}
    for r in edge_labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            labels[r["doc_id"]] = max(labels.get(r["doc_id"], 0), r["toxic"])
    text_of = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in labels}
    ids = sorted(text_of)
    toxic = np.array([labels[i] for i in ids])
    sets = [X.text_terms(text_of[i]) for i in ids]
    seen = Counter(t for s in sets for t in s)
    bad = Counter(t for s, y in zip(sets, toxic) for t in s if y)
    often = [t for t in seen if seen[t] >= X.SEEN]
    bar, n1, n = 2 * math.log(len(often)) + X.MARGIN, int(toxic.sum()), len(ids)

    def told(t):
        cells = [(bad[t], seen[t] * n1), (seen[t] - bad[t], seen[t] * (n - n1)), (n1 - bad[t], (n - seen[t]) * n1), (n - n1 - seen[t] + bad[t], (n - seen[t]) * (n - n1))]
        return min(2 * sum(o * math.log(o * n / e) for o, e in cells if o > 0) / bar, 1) if seen[t] >= X.SEEN else 0

    plain = [t for t in seen if b"#" not in t and not t.startswith(b"^")]
    chosen = sorted(plain + [t for t in often if t not in plain and told(t) >= 1])
    sets = [X.text_terms(r["text"]) for r in rows]
    df = Counter(t for s in sets for t in s)
    idf = np.array([(math.log((1 + len(rows)) / (1 + df[t])) + 1) * (X.FLOOR + (1 - X.FLOOR) * told(t) ** 2) for t in chosen])

    def dense(text):
        own = Counter(t for w in words(text) for t in X.terms(w.encode()))
        tf = np.array([own[t] if b"#" not in t else float(own[t.split(b"#")[0]] >= int(t.split(b"#")[1])) for t in chosen])
        w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
        return w / (np.sqrt((w * w).sum()) or 1)

    examples = np.stack([dense(text_of[i]) for i in ids])
    got = sorted(X.score_toxicity(edge_docs, edge_labels).collect(), key=lambda r: (r["id"] is None, r["id"] or 0, r["score"]))
    assert len(got) == len(rows)
    texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None}
    label = {str(i): y for i, y in labels.items()}
    for r in got:
        if r["id"] is None:
            continue
        cosine = np.sort(examples @ dense(texts[r["id"]]))[::-1][:X.K]
        assert np.allclose([e["cosine"] for e in r["evidence"]], cosine[cosine > 0], atol=1e-6)
        assert all(e["toxic"] == label[e["id"]] for e in r["evidence"])
        own = next((e for e in r["evidence"] if e["id"] == str(r["id"])), None)
        assert r["id"] not in text_of or not texts[r["id"]] or own is None or abs(own["cosine"] - 1) < 1e-6
    votes = {}
    for r in got:  # the score is one rising curve of the vote
        if r["evidence"]:
            w = [e["cosine"] / max(1 - e["cosine"], 0.05) for e in r["evidence"]]
            votes[sum(x * e["toxic"] for x, e in zip(w, r["evidence"])) / sum(w)] = r["score"]
    scores = [votes[v] for v in sorted(votes)]
    assert scores == sorted(scores) or scores == sorted(scores, reverse=True)


def test_copy_of_an_example_without_telling_words_is_found(spark):
    rng = random.Random(4)
    body = lambda: " ".join(f"w{rng.randint(0, 400)}" for _ in range(40))
    texts = {i: body() for i in range(200)}
    ids = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    copied = ids[0]
    docs = spark.createDataFrame([*texts.items(), (1000, texts[copied]), (1001, ""), (1002, "zzz")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i == copied)) for i in texts], "doc_id bigint, toxic int")
    got = {r["id"]: r for r in X.score_toxicity(docs, labels).collect()}
    best = got[1000]["evidence"][0]
    assert best["id"] == str(copied) and abs(best["cosine"] - 1) < 1e-6 and best["toxic"] == 1
    assert got[1001]["evidence"] == [] == got[1002]["evidence"]


def test_toxicity_edges(edge_docs, edge_labels, no_docs, no_labels):
    assert X.score_toxicity(edge_docs, edge_labels).count() == edge_docs.count()
    assert X.score_toxicity(no_docs, edge_labels).count() == 0
    assert {r["score"] for r in X.score_toxicity(edge_docs, no_labels).collect()} == {0.0}


def test_terms_of_words_and_repeats():
    v = X.Vocabulary([b"idiot", b"^idio", b"idiot#2", b"clown#3"])
    counts = lambda text: dict(zip(*(x.tolist() for x in v.counts(text))))
    assert counts("Idiot, idiotic! IDIOT") == {0: 2, 1: 3, 2: 1} and counts("idiotic other") == {1: 1}
    assert counts("clown clown") == {} and counts("clown clown%%% clown") == {3: 1} and counts(None) == {}


@pytest.mark.parametrize("text", [None, "", "  ", "a" * 300_000])
def test_long_and_empty_words(text):
    assert len(list(Q.ngram_buckets(text))) <= 1
    assert not len(X.Vocabulary([b"x"]).counts(text)[0])
