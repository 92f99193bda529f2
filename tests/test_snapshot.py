import pytest
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B
from tidemark.operators import rehydrate as H
from tidemark.operators import report as S
from tidemark.plans.distill_run import distill
from tidemark.sources import report as W
from tidemark.sources import snapshot as N
from tidemark.sources.files import scan_files
from tidemark.streaming import distill as D
from tidemark.streaming.distill import distill_new_files, latest_members
from workloads import fixtures as X
from workloads import streams

BIG = "x = 'not small'\n" * 100


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "proj"
    for name, data in {
        "a.py": b"def f(x):\n    return x\n", "lib/b.js": b"function g(a) {\n  return a;\n}\n", "lib/big.py": BIG.encode(),
        "bad.ts": b"ok \xff\xfe end\n", "note.md": b"# no", "node_modules/c.js": b"x", "lib/build/d.py": b"y", "empty.tsx": b"",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return root


def test_scan(spark, tree):
    got = {r.path: r for r in scan_files(spark, str(tree)).collect()}
    # Spark's file sources do not list files without bytes
    assert set(got) == {"a.py", "lib/b.js", "lib/big.py", "bad.ts"}
    assert got["bad.ts"].text == "ok �� end\n" and got["bad.ts"].n_bytes == 10
    assert got["lib/b.js"].ext == "js"


def test_scan_skips_folders_below_the_root_only(spark, tmp_path):
    for root in (tmp_path / "build" / "a b+é%20" / "dist", tmp_path / "venv"):
        for name in ("a.py", "lib/b.py", "build/c.py", "lib/node_modules/d.py"):
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_text("x = 1\n")
        assert {r.path for r in scan_files(spark, str(root)).select("path", "text").collect()} == {"a.py", "lib/b.py"}


def test_run_write_read_prune(spark, tree, tmp_path):
    files = scan_files(spark, str(tree))
    run, root = distill(files), str(tmp_path / "snap")
    assert N.read_snapshot(spark, root).skeletons.count() == 0
    N.write_snapshot(run, root, "one", commit_sha="c1", project_root=str(tree), ts="2024-01-01 00:00:00")
    snap = N.read_snapshot(spark, root)
    sk = {r.key: r for r in snap.skeletons.collect()}
    assert set(sk) == {"lib/big.py", "COMMON_BUCKET_0"}
    assert all(len(r.text.encode()) == r.n_bytes and r.n_bytes % 4096 == 0 for r in sk.values())
    assert "def f(x):\n     pass" in sk["COMMON_BUCKET_0"].text
    assert sk["COMMON_BUCKET_0"].text.startswith("<!-- GCS_BUCKET_MANIFEST_START: a.py, bad.ts, lib/b.js -->\n")
    assert {(r.path, r.key, r.pos) for r in snap.members.collect()} == {
        ("a.py", "COMMON_BUCKET_0", 0), ("bad.ts", "COMMON_BUCKET_0", 1),
        ("lib/b.js", "COMMON_BUCKET_0", 2), ("lib/big.py", "lib/big.py", 0),
    }
    assert {r.symbol for r in snap.source_map.collect()} == {"f", "g"}

    listing = spark.createDataFrame([("a.py",)], "path string")
    kept = N.prune_snapshot(snap, listing, "c1")
    assert [r.key for r in kept.skeletons.collect()] == ["COMMON_BUCKET_0"]
    assert [r.path for r in kept.source_map.collect()] == ["a.py"]
    assert N.prune_snapshot(snap, listing, "c2").skeletons.count() == 0
    gone = spark.createDataFrame([("other",)], "path string")
    assert N.prune_snapshot(snap, gone, "c1").skeletons.count() == 1
    assert N.prune_snapshot(snap, gone, "c1", by_member=True).skeletons.count() == 0

    # a later snapshot replaces it as a whole; one without its meta row is not seen
    N.write_snapshot(kept, root, "two", commit_sha="c1", ts="2024-01-02 00:00:00")
    assert N.read_snapshot(spark, root).snapshot_id == "two"
    assert N.read_snapshot(spark, root, "one").skeletons.count() == 2
    kept.skeletons.write.parquet(f"{root}/skeletons/snapshot_id=three/attempt=x")
    assert N.read_snapshot(spark, root).snapshot_id == "two"

    gate = N.restore_size(snap.skeletons).first()
    assert gate.allowed and gate.total_bytes == sum(r.n_bytes for r in sk.values())
    assert N.restore(snap.skeletons, limit=10).count() == 0 and N.restore(snap.skeletons).count() == 2
    assert fixed.RESTORE_LIMIT_BYTES == 5 * 1024 * 1024


def test_rehydrate(spark, tree):
    files = scan_files(spark, str(tree))
    sm = distill(files).source_map
    ask = spark.createDataFrame([("a.py", "f"), ("a.py", "f"), ("lib/b.js", "g"), ("a.py", "no"), ("gone.py", "f")], "path string, symbol string")
    got = sorted(((r.path, r.symbol, r.block) for r in H.rehydrate_blocks(ask, sm, files).collect()), key=str)
    assert got == [
        ("a.py", "f", "return x"), ("a.py", "f", "return x"), ("a.py", "no", None), ("gone.py", "f", None),
        ("lib/b.js", "g", "{\n  return a;\n}"),
    ]
    full = H.rehydrate_full(spark.createDataFrame([("a.py",), ("gone.py",)], "path string"), files)
    assert {r.path: r.text for r in full.collect()} == {"a.py": "def f(x):\n    return x\n", "gone.py": None}


def test_rehydrate_rules(spark):
    sm = spark.createDataFrame(
        [("p", 1, "s", "t", 4, 6, 8), ("p", 0, "s", "t", 1, 3, 8), ("q", 0, "s", "t", 0, 2, 9), ("r", 0, "s", "t", 0, 2, 0), ("u", 0, "s", "t", 0, 1, 2)],
        N.SCHEMAS["source_map"],
    )
    files = spark.createDataFrame([("p", bytearray(b"abcdefgh"), 8), ("q", bytearray(b"12345678"), 8), ("r", bytearray(b"xyz"), 3), ("u", bytearray("é".encode()), 2)],
                                  "path string, content binary, n_bytes long")
    ask = sm.select("path", "symbol").distinct()
    got = {r.path: r.block for r in H.rehydrate_blocks(ask, sm, files).collect()}
    assert got == {"p": "bc", "q": None, "r": "xy", "u": "�"}
    strict = files.withColumn("sha2", F.sha2("content", 256))
    same = sm.join(strict.select("path", "sha2"), "path")
    other = same.withColumn("sha2", F.when(F.col("path") == "p", "0").otherwise(F.col("sha2")))
    got = {r.path: r.block for r in H.rehydrate_blocks(ask, other, strict).collect()}
    assert got["p"] is None and got["r"] == "xy"


def test_prompts(spark):
    rows = [
        (1, "Please EDIT src/a.py and lib/b.tsx, src/a.py."), (2, "credit a.py"), (3, "update nothing"), (4, "change x.md!"),
        (5, "rewrite a.python"), (6, "look at a.py"),
    ]
    df = spark.createDataFrame(rows, "prompt_id int, text string")
    found = {r.prompt_id: r.c for r in df.select("prompt_id", H.candidate_files(F.col("text")).alias("c")).collect()}
    assert found == {1: ["src/a.py", "lib/b.tsx"], 2: ["a.py"], 3: [], 4: ["x.md"], 5: [], 6: ["a.py"]}
    members = spark.createDataFrame([("lib/b.tsx", "COMMON_BUCKET_0"), ("a.py", "a.py")], "path string, key string")
    got = {r.prompt_id: (r.n_candidates, r.required) for r in H.match_intents(df, members).collect()}
    assert got == {1: (2, True), 3: (0, False), 4: (1, False), 5: (0, False)}
    some = spark.createDataFrame([("a.py",), ("z.py",)], "path string")
    assert [r.path for r in H.skeletonized_only(some, members).collect()] == ["a.py"]


def test_report(spark, tree, tmp_path):
    sizes = S.file_sizes(distill(scan_files(spark, str(tree))).sizes)
    text = W.write_report(sizes, str(tmp_path / "report"), top=2)
    totals = S.size_totals(sizes).first()
    assert f"| 4 | {totals.original:,} | {totals.distilled:,} | {totals.saving:,} |" in text and text.count("| lib/") == 2
    assert spark.read.parquet(str(tmp_path / "report" / "top")).count() == 2
    none = S.size_totals(sizes.filter("false")).first()
    assert (none.n_files, none.original, none.saving_pct) == (0, 0, 0.0)
    ratio = S.compression_ratio(spark.createDataFrame([("e", 0, 0), ("f", 4096, 10)], "path string, n_bytes long, skeleton_bytes long"))
    assert {r.path: r.ratio for r in ratio.collect()} == {"e": 1.0, "f": 1.0}
    ties = spark.createDataFrame([("b", 5, 1, 4), ("a", 5, 1, 4), ("c", 9, 1, 8)], "path string, original long, distilled long, saving long")
    assert [r.path for r in S.top_savings(ties, 2).collect()] == ["c", "a"]


def test_new_files_become_increments(spark, tree, tmp_path):
    root, ck = str(tmp_path / "inc"), str(tmp_path / "ck")
    distill_new_files(spark, str(tree), root, ck).awaitTermination()
    first = {r.path: r.snapshot_id for r in latest_members(spark, root).collect()}
    assert set(first) == {"a.py", "lib/b.js", "lib/big.py", "bad.ts"}
    (tree / "new.py").write_text("z = 1\n")
    distill_new_files(spark, str(tree), root, ck).awaitTermination()
    second = {r.path: r.snapshot_id for r in latest_members(spark, root).collect()}
    assert set(second) == set(first) | {"new.py"}
    assert second["new.py"] > first["a.py"] == second["a.py"]


def test_a_snapshot_is_swapped_in_one_step(spark, tree, tmp_path):
    root, files = str(tmp_path / "snap"), scan_files(spark, str(tree))
    N.write_snapshot(distill(files.filter("ext = 'py'")), root, "one", ts="2024-01-01")
    old = N.read_snapshot(spark, root, "one")
    N.write_snapshot(distill(files.filter("ext = 'js'")), root, "one", ts="2024-01-01")
    assert {r.path for r in old.members.collect()} == {"a.py", "lib/big.py"}  # a reader that began before
    assert {r.path for r in N.read_snapshot(spark, root, "one").members.collect()} == {"lib/b.js"}
    assert N.read_meta(spark, root).count() == 1
    # an attempt that died before its meta row is not seen, and goes with the superseded one
    old.members.write.parquet(f"{root}/members/snapshot_id=one/attempt=dead")
    assert N.drop_attempts(spark, root) == 4
    assert {r.path for r in N.read_snapshot(spark, root).members.collect()} == {"lib/b.js"}


def test_oversize_files_are_marked_in_the_snapshot(spark, tree):
    got = {r.path: (r.units, r.oversize) for r in distill(scan_files(spark, str(tree)), limit=50).members.collect()}
    assert got["a.py"] == (8, False)
    assert got["lib/big.py"][1] and got["lib/big.py"][0] > 50


def test_increments_compact_with_tombstones(spark, tmp_path):
    root = str(tmp_path / "runs")
    at = {
        0: {"a.py": "def f():\n    return 1\n", "b.py": "b = 1\n", "c.py": BIG},
        2: {"a.py": "def f():\n    return 2\n", "b.py": "b = 1\n", "d.py": "d = 1\n"},
        4: {"a.py": "def f():\n    return 2\n", "b.py": "b = 1\n", "d.py": "d = 1\n"},
    }
    listed = []

    def listing(batch):
        listed.append(batch)
        return spark.createDataFrame([(p, "py", t, len(t)) for p, t in at[batch].items()], "path string, ext string, text string, n_bytes long")

    runs = D.DeltaRuns(spark, root, listing)
    idle = spark.createDataFrame([(1, None)], "session_id long, fired_bucket int")
    fired = spark.createDataFrame([(1, 30), (1, None)], "session_id long, fired_bucket int")
    for batch, rows in enumerate([fired, idle, fired, idle, fired]):
        runs.sink(rows, batch)
        runs.sink(rows, batch)  # a repeated batch does no work
    assert listed == [0, 2, 4]
    assert sorted(map(tuple, runs.runs().collect()), key=lambda r: r[3]) == [(1, 3, 0, 0), (0, 0, 0, 1), (1, 2, 1, 2), (0, 0, 0, 3), (1, 0, 0, 4)]
    got = sorted((r.batch_id, r.path, r.gone) for r in runs.distilled().collect())
    assert got == [(0, "a.py", False), (0, "b.py", False), (0, "c.py", False), (2, "a.py", False), (2, "c.py", True), (2, "d.py", False)]
    assert sorted(r.snapshot_id for r in N.read_meta(spark, root).collect()) == ["part-000000000000", "part-000000000002"]

    def state():
        members = sorted((r.path, r.key) for r in latest_members(spark, root).collect())
        return members, sorted((r.path, r.symbol, r.file_size) for r in D.latest_source_map(spark, root).collect()), sorted(
            r.text for r in D.latest_skeletons(spark, root).collect()
        )

    before = state()
    assert [p for p, _ in before[0]] == ["a.py", "b.py", "d.py"]
    name = D.compact(spark, root)
    assert state() == before
    assert [r.snapshot_id for r in N.read_meta(spark, root).collect()] == [name]
    assert D.compact(spark, root) == name
    whole = N.read_snapshot(spark, root)
    assert sorted(r.path for r in whole.members.collect()) == ["a.py", "b.py", "d.py"]


def test_files_delivered_again_count_by_their_last_delivery(spark, tmp_path):
    folder, root, ck = (str(tmp_path / x) for x in ("in", "inc", "ck"))
    rows = spark.createDataFrame([("a.py", "x = 1"), ("lib/b.py", "y = 1"), ("lib/b.py", "y = 2"), ("gone.py", None), (None, "z")], "path string, text string")
    X.write_tree(rows, f"{folder}/0")
    assert {r.path: r.text for r in scan_files(spark, f"{folder}/0").collect()} == {"a.py": "x = 1\n", "lib/b.py": "y = 1\ny = 2\n"}
    assert not list((tmp_path / "in").rglob("part-*"))
    distill_new_files(spark, folder, root, ck, deliveries=True).awaitTermination()
    X.write_tree(rows.filter("path = 'a.py'"), f"{folder}/1")
    distill_new_files(spark, folder, root, ck, deliveries=True).awaitTermination()
    assert {r.path: r.snapshot_id for r in latest_members(spark, root).collect()} == {"a.py": D.part_name(1), "lib/b.py": D.part_name(0)}


def test_increments_hold_what_is_delivered_again(spark, sf_dir):
    got = {(int(r.path.split("_")[1].split(".")[0]), r.snapshot_id) for r in streams.stream_increments(spark, sf_dir).select("path", "snapshot_id").distinct().collect()}
    assert {p for p, s in got if s == D.part_name(1)} == {p for p, _ in got if p % 2 or p % 10 == 0}
    assert any(p % 10 == 0 for p, _ in got)
