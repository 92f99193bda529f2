"""The plans the operators are built for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import redact as R
from tidemark.operators import distill as D
from tidemark.operators import handoff as O
from tidemark.operators import index as I
from tidemark.operators import monitor as M
from tidemark.operators import rehydrate as H
from tidemark.operators import report as S
from tidemark.sources.files import scan_files
from workloads import registry

QUERIES = registry.queries()


def initial(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    plan = initial(df)
    return plan.split("Initial Plan")[0]


@pytest.fixture
def usage(spark, tmp_path):
    df = spark.range(3000).selectExpr(
        "id % 7 as session_id", "id as event_id", "id * 60000000 as t_us", "id * 37 % 1000 + 1 as prompt_tokens", "1000L as max_context"
    )
    df.write.parquet(str(tmp_path / "u"))
    return spark.read.parquet(str(tmp_path / "u"))


def test_samples_are_shuffled_once(usage):
    plan = final(M.track_sessions(usage))
    wide = re.findall(r"[+:]- Exchange hashpartitioning\(session_id#\d+L, _no_session_id#\d+, chunk#\d+L", plan)
    scans = re.findall(r"FileScan parquet", plan)
    assert plan.count("ReusedExchange") >= 1
    assert len(scans) == 1
    # the other shuffles by slot carry the summary only
    assert len(wide) == 1


def test_windows_run_within_a_slot(usage):
    plan = initial(M.track_sessions(usage))
    for w in re.findall(r"windowspecdefinition\(([^)]*?) (?:ASC|DESC)", plan):
        assert w.startswith("session_id#")
    # windows over whole sessions see one row per slot: they sit above an aggregate
    assert "SortAggregate" in plan or "ObjectHashAggregate" in plan


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if not k.startswith("stream_")))
def test_no_cross_join_and_no_python_outside_packing_and_scanning(spark, sf_dir, key):
    plan = initial(QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if not re.search("pack|bucket|snapshot|restore|prune|is_skeletonized|match_intents", key):  # the last two read a snapshot
        rest = re.sub(r".*ArrowEvalPython \[cut\(.*", "", plan)  # the scanner of blocks
        assert "Pandas" not in rest and "Python" not in rest
    assert not re.search(r"windowspecdefinition\([^)]* (?:ASC|DESC)[^)]*\), \[\], ", plan)


def test_redaction_stays_in_the_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = initial(docs.select("doc_id", R.redact(F.col("text")).alias("text")))
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_top_report_takes_ordered(spark, sf_dir):
    assert "TakeOrderedAndProject" in initial(QUERIES["top_savings"](spark, sf_dir))


def test_last_turns_are_limited_before_the_shuffle(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert initial(O.last_turns(turns)).count("WindowGroupLimit") == 2


def test_search_pushes_its_terms(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    I.postings(docs).write.parquet(str(tmp_path / "post"))
    found = I.search(spark.read.parquet(str(tmp_path / "post")), I.corpus_stats(docs), "token license")
    assert "PushedFilters: [In(term, [license,token])" in initial(found)


def test_index_search_reads_few_blocks(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 60)) + ["common"] * rng.choice([0, 1, 1, 2, 9]) + ["rare"] * (i % 400 == 7)) for i in range(3000)]
    rows = list(enumerate(texts)) + [(3000, None), (3001, ""), (None, "common common"), (3002, "common rare common")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    ix = str(tmp_path / "ix")
    I.write_index(docs, ix, partitions=5)
    blocks = spark.read.parquet(f"{ix}/blocks")
    assert blocks.agg(F.max("n")).first()[0] == I.BLOCK
    post, stats = I.postings(docs), I.corpus_stats(docs)
    assert tuple(spark.read.parquet(f"{ix}/stats").first()) == tuple(stats.first())
    for query in ("common rare", "common", "w1 w2 w3 common", "nothing", "rare w5"):
        for k in (1, 10, 5000):
            assert I.search_index(spark, ix, query, k).collect() == I.search(post, stats, query, k).collect()
    _, least, _ = I.search_plan(spark, ix, "common", 5)
    kept = blocks.filter(" or ".join(f"(term = '{t}' and largest >= {f!r})" for t, f in least.items())).count()
    assert kept < blocks.filter("term = 'common'").count() / 2
    plan = initial(I.search_index(spark, ix, "common", 5))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(largest", plan)


def test_postings_are_counted_without_a_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange" not in initial(I.postings(docs))
    lists = I.posting_lists(docs)
    assert lists.agg(F.max(F.size("keys"))).first()[0] == I.LIST
    assert lists.count() < I.postings(docs).count() / 2
    assert lists.agg(F.sum("total")).first() == docs.agg(F.sum(F.size(I.tokens(F.col("text"))))).first()


def test_postings_of_a_repeated_key_are_one(spark, tmp_path):
    rows = [(1, "a b b"), (1, "B c a"), (1, "a"), (None, "a d"), (None, "d a"), (2, "a b"), (3, None), (3, ""), (4, "b b b"), (4, None)]
    docs = spark.createDataFrame(rows * 200 + [(5, "e a")], "doc_id bigint, text string").repartition(7)
    words = docs.select("doc_id", I.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("bigint").alias("length"), F.explode("w").alias("term"))
    want = sorted(map(repr, words.groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf")).collect()))
    assert sorted(map(repr, I.postings(docs).collect())) == want
    kept = sorted(r for r in want if "term='a'" in r or "term='e'" in r)
    assert sorted(map(repr, I.postings(docs, only=["a", "e"]).collect())) == kept
    I.write_index(docs, str(tmp_path / "ix"), partitions=3)
    for query in ("a", "b d", "e", "a b c d e"):
        assert I.search_index(spark, str(tmp_path / "ix"), query).collect() == I.search(I.postings(docs), I.corpus_stats(docs), query).collect()


@pytest.mark.parametrize("chunk", [7, 50, 10**6])
def test_budgets_are_exact_by_parts(spark, chunk):
    rng = random.Random(chunk)
    rows = [("hot", f"p{i:04}", rng.choice([0, 1, 5, 30])) for i in range(600)] + [("big", "a", 500), ("big", "b", 1), ("c", "x", 100), ("d", "y", 101)]
    df = spark.createDataFrame(rows, "session_id string, path string, n long").repartition(5)
    want, at = set(), {}
    for s, p, n in sorted(rows):
        at[s] = at.get(s, 0) + n
        if at[s] <= 100:
            want.add((s, p))
    got = O.within_budget(df, "session_id", ["path"], "n", 100, chunk)
    assert {(r.session_id, r.path) for r in got.collect()} == want
    ranks = sorted(r["rank"] for r in got.filter("session_id = 'hot'").collect())
    assert ranks == list(range(1, len(ranks) + 1))
    # the first windows are by part; that over whole sessions sees what the parts have kept
    windows = re.findall(r"windowspecdefinition\(session_id#\d+, _part#\d+", initial(got))
    assert len(windows) >= (2 if chunk == 10**6 else 3) and not re.search(r"windowspecdefinition\(session_id#\d+, path", initial(got))


def test_a_cut_checkpoint_layer_says_so(spark):
    touched = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("a", "p3"), ("b", "p1"), ("c", "p4")], "session_id string, path string")
    texts = spark.createDataFrame([("p1", "x" * 40), ("p2", "y" * 40), ("p3", "z" * 40), ("p4", "w" * 200)], "path string, skeleton string")
    doc = O.handoff([O.checkpoint_layer(touched, texts, 100)], {})
    got = {r.session_id: r.document for r in doc.collect()}
    assert "x" * 40 + "\n" + "y" * 40 + "\n... 1 more" in got["a"] and "z" not in got["a"]
    assert "more" not in got["b"] and "... 1 more" in got["c"]


def test_files_that_nobody_asks_for_are_not_opened(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"a b+{i}.py").write_text(f"def f():\n    return {i}\n")
    files = scan_files(spark, str(tmp_path))
    spans = D.source_map(files)
    spans.write.parquet(str(tmp_path / "map"))
    spans = spark.read.parquet(str(tmp_path / "map"))
    asked = spark.createDataFrame([("a b+3.py", "f"), ("a b+4.py", "g"), ("none.py", "f")], "path string, symbol string")
    files = scan_files(spark, str(tmp_path))
    for i in range(20):
        if i != 3:  # a file that is opened now fails the query
            (tmp_path / f"a b+{i}.py").unlink()
    got = {(r.path, r.symbol): r.block for r in H.rehydrate_blocks(asked, spans, files).collect()}
    assert got == {("a b+3.py", "f"): "return 3", ("a b+4.py", "g"): None, ("none.py", "f"): None}
    many = H.rehydrate_blocks(asked, spans, files, few=0)
    assert "Semi" in initial(many)


def test_size_report_reads_no_text(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, "text")], "path string, n_bytes long, skeleton_bytes long, skeleton string")
    df.write.parquet(str(tmp_path / "s"))
    plan = initial(S.size_totals(S.file_sizes(spark.read.parquet(str(tmp_path / "s")))))
    assert "ReadSchema: struct<n_bytes:bigint,skeleton_bytes:bigint>" in plan
