"""Streams beyond the registered queries: late samples, expired state, repeated batches."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import status as T
from tidemark.streaming import monitor as M

S = 10**6
SCHEMA = "session_id string, event_id long, t_us long, prompt_tokens long, max_context long"


def feed(spark, tmp_path, parts, write=None):
    """Each part is one run of the stream; gives the progress of all runs."""
    landing, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    progress = []
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(landing)
        stream = M.monitor_stream(spark.readStream.schema(SCHEMA).parquet(landing))
        w = write(stream) if write else stream.writeStream.format("parquet").option("path", out)
        q = w.option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        progress += [p for p in q.recentProgress]
    return out, progress


def test_late_and_expired(spark, tmp_path):
    parts = [
        [("a", 1, 5 * S, 300, 1000), ("b", 2, 10 * S, 450, 1000), ("z", 3, 11 * S, 0, 1000)],
        [("b", 4, 5000 * S, 460, 1000)],
        # later than the watermark allows, then a sample long after its session went quiet
        [("a", 5, 100 * S, 990, 1000), ("a", 6, 5001 * S, 350, 1000)],
    ]
    out, progress = feed(spark, tmp_path, parts)
    got = {r.event_id: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {1, 2, 4, 6}
    assert (got[1].fired_bucket, got[2].fired_bucket, got[4].fired_bucket) == (30, 40, 40)
    # as after an idle reset
    assert (got[6].last_bucket, got[6].last_step, got[6].fired_bucket) == (0, 0, 30)
    dropped = sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators)
    assert dropped == 1


def test_status_sink_can_repeat_a_batch(spark, tmp_path):
    root = str(tmp_path / "status")
    df = spark.createDataFrame(
        [("a", 1, 1, 300, 1000), ("b", 2, 2, 100, 1000)], SCHEMA
    ).withColumns({"ratio": F.expr("prompt_tokens / max_context"), "tier": F.lit(30), "fired_bucket": F.expr("case when session_id = 'a' then 30 end")})
    sink = M.status_sink(root)
    sink(df, 0)
    sink(df, 0)
    later = df.filter("session_id = 'b'").withColumns({"t_us": F.lit(9).cast("long"), "ratio": F.lit(0.5)})
    sink(later, 1)
    sink(later, 1)
    got = {r.session_id: r.status for r in T.read_status(spark, root, kind="STRING").collect()}
    assert got == {"a": "[GCS: 30.0% ⚡ YOLO]", "b": "GCS: 50.0%"}
    assert T.last_overall(T.read_status(spark, root, kind="STRING")).first().session_id == "b"
    asked = spark.createDataFrame([("a",), ("x",)], "session_id string")
    assert {r.session_id: r.status for r in T.status_of(asked, T.read_status(spark, root, kind="STRING")).collect()}["x"] == "[GCS: --]"


@pytest.mark.parametrize("fold_every", [1, 3, 100])
def test_status_versions(spark, tmp_path, fold_every):
    root = str(tmp_path / "s")
    for v in range(7):
        rows = spark.createDataFrame([(v % 4, v, v, f"s{v}")], "session_id long, t_us long, event_id long, status string")
        T.write_status(rows, root, v, fold_every)
    assert {r.session_id: r.status for r in T.read_status(spark, root).collect()} == {0: "s4", 1: "s5", 2: "s6", 3: "s3"}
    kept = sorted(int(p.name[1:]) for p in (tmp_path / "s" / "status").iterdir() if p.name.startswith("v"))
    assert kept == {1: [5, 6], 3: [3, 4, 5, 6], 100: list(range(7))}[fold_every]
    T.write_status(rows, root, 6, fold_every)  # the last batch again
    assert {r.session_id: r.status for r in T.read_status(spark, root).collect()} == {0: "s4", 1: "s5", 2: "s6", 3: "s3"}


def test_payload_files_as_a_stream(spark, tmp_path):
    from tidemark.sources.usage import stream_usage

    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "a.jsonl").write_text('{"llm_response":{"usage":{"input_tokens":3}}}\n\nbad\n{"context_window":{"total_input_tokens":8}}\n')
    q = (
        stream_usage(spark, str(src)).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert sorted(r.prompt_tokens for r in spark.read.parquet(out).collect()) == [3, 8]


def test_a_slice_of_many_files_is_one_batch(spark, sf_dir):
    # a slice used to be one file, so a single task wrote and read it
    from workloads import streams

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        folders = streams._arrivals(spark, sf_dir, False)
        n_files = [len(spark.read.parquet(f).inputFiles()) for f in folders]
        n_rows = [spark.read.parquet(f).filter("prompt_tokens != 0").count() for f in folders]
        tables = streams._run(spark, sf_dir)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(n > 1 for n in n_files)
    done = streams.W.L.read_all(spark, tables.root, "commits", streams.W.COMMIT).orderBy("batch_id").collect()
    assert [(r.batch_id, r.n_on_time) for r in done] == list(enumerate(n_rows))
