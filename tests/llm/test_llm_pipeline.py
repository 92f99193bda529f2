"""The corpus pipeline, stage by stage against brute force on small tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm import decontamination as D
from tidemark.llm import mixing
from tidemark.llm import quality as Q


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, fn in P.STAGES:
        path = f"{tmp_path_factory.mktemp('stage')}/out"
        fn(spark, docs, sf_dir).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return sf_dir, out


def test_columns(stages):
    _, out = stages
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(after.columns == columns for _, _, after in out[:-1])
    assert sorted(out[-1][2].columns) == sorted([*columns, "shard", "slot"])
    assert all(after.count() for _, _, after in out)


def test_quality_stage(spark, stages):
    sf_dir, out = stages
    _, before, after = out[0]
    kept = Q.resample(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("kept")
    assert {r["id"] for r in kept.collect()} == {r["doc_id"] for r in after.collect()}


def test_near_dedup_stage(stages):
    _, before, after = stages[1][1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or {" ".join(w)}

    sets, group = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    assert {r["doc_id"] for r in after.collect()} == {root(i) for i in sets}


def test_decontamination_stage(spark, stages):
    sf_dir, out = stages
    _, before, after = out[2]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    suffixes, clean = D.Suffixes.of(items, D.WINDOW), set()
    for r in before.collect():
        f = D.search_texts([r["text"]], suffixes)[0]
        if not D.contaminated(sum(b - a + 1 for a, b in D._spans(f["hits"])), f["n_words"]):
            clean.add(r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == clean and len(clean) < before.count()


def test_mixing_and_sharding_stages(stages):
    _, before, after = stages[1][3]
    times = Counter(r["doc_id"] for r in after.collect())
    units = {r["id"]: r["times"] for r in mixing.mix(before).collect()}
    assert times == Counter({k: v for k, v in units.items() if v})
    _, before, after = stages[1][4]
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(r["doc_id"] for r in before.collect())
    slots = {}
    for r in after.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_gives_the_last_stage(spark, stages):
    sf_dir, out = stages
    got = P.pipeline(spark, sf_dir)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in out[-1][2].collect())


OURS = (
    "_key _good _text _label_id _unit _nth _n _copy _row _h _t _g _s size h node least n hash prefix spread root key at block copies times nth "
    "log_weight noisy kept p_good n_words hits items longest longest_at longest_item shard slot id fp label_id good"
).split()


@pytest.mark.parametrize("at", range(5))
def test_stages_pass_on_columns_of_any_name(spark, stages, at):
    sf_dir, out = stages
    _, before, after = out[at]
    base = ["doc_id", "text", "lang", "source", "n_chars"]
    known = set(before.columns)
    wide = before.select(*base, *[F.concat(F.lit(f"{c}:"), F.col("doc_id")).alias(c) for c in OURS if c not in known])
    got = P.STAGES[at][1](spark, wide, sf_dir)
    replaced = {"shard", "slot"} if at == 4 else {"n_words", "hits", "items", "longest", "longest_at", "longest_item"} if at == 2 else set()
    assert set(OURS) - replaced <= set(got.columns)
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in after.collect())
    assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in OURS if c not in replaced)


@pytest.mark.parametrize("at", range(5))
def test_stages_of_odd_rows(spark, edge_docs, no_docs, at):
    fn = P.STAGES[at][1]
    docs = edge_docs.select("doc_id", "text", "lang", "source", "n_chars")
    got = fn(spark, docs, "/root/testdata/sf0.001")
    assert got.columns[:5] == docs.columns and got.count() <= docs.count() * 3
    assert fn(spark, no_docs, "/root/testdata/sf0.001").count() == 0
