"""Session tables of a stream: hot sessions, late samples, merges, repeated batches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import monitor as M
from tidemark.operators.running import Sequence, with_running
from tidemark.streaming.sessions import SessionTables, session_sink

S = 10**6
SCHEMA = "session_id long, event_id long, t_us long, prompt_tokens long, max_context long"
COLUMNS = ["session_id", "event_id", "t_us", "ratio", "step", "tier", "last_step", "last_bucket", "fired_bucket", "notice"]


def samples(n, seed):
    """A third of all samples in one session, some without a session, a real session -1, quiet spells, no tokens."""
    rng, out, at = random.Random(seed), [], {}
    for e in range(n):
        s = 7 if rng.random() < 0.33 else rng.choice([1, 2, 3, -1, None])
        at[s] = at.get(s, 0) + rng.choice([0, 1, 30, 200, 301, 950, 1500]) * S
        out.append((s, e, at[s], rng.choice([0, 100, 150, 300, 480, 700, 710]), 1000))
    return sorted(out, key=lambda r: (r[2], r[1]))


def rows(df, columns=COLUMNS):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def batch_form(spark, data):
    return M.track_sessions(spark.createDataFrame([r for r in data if r[3]], SCHEMA))


def quiet_ends(data, idle=300, late=600):
    """The last sample before each quiet spell, one way or the other."""
    out, newest, by = [], max(r[2] for r in data if r[3]), {}
    for r in sorted((r for r in data if r[3]), key=lambda r: (r[2], r[1])):
        by.setdefault((r[0] is None, r[0]), []).append(r)
    for (_, s), own in by.items():
        for a, b in zip(own, [*own[1:], None]):
            if (b[2] if b else newest) - a[2] > (idle + late) * S:
                out.append((-1 if s is None else s, a[2], a[3], a[2] + (idle + late) * S))
    return sorted(out, key=repr)


def feed(spark, tables, batches, first=0):
    for i, data in enumerate(batches, first):
        tables.fold(spark.createDataFrame(data, SCHEMA).repartition(3), i)


@pytest.mark.parametrize("slot_s", [60, 10**6])
def test_batches_in_order_give_the_batch_form(spark, tmp_path, slot_s):
    data = samples(400, slot_s)
    tables = SessionTables(spark, str(tmp_path / "t"), slot_us=slot_s * S)
    cuts = [0, 130, 131, 290, 400]
    feed(spark, tables, [data[a:b] for a, b in zip(cuts, cuts[1:])])
    assert rows(tables.result()) == rows(batch_form(spark, data))
    assert rows(tables.result("expired"), ["session_id", "t_us", "prompt_tokens", "expired_us"]) == quiet_ends(data)
    assert tables.arrived("late").count() == 0
    assert not tables.merge_late()


def test_late_samples_are_kept_and_merged(spark, tmp_path):
    data, rng = samples(400, 5), random.Random(1)
    parts = [[], [], [], []]
    for i, r in enumerate(data):
        parts[min(3, i // 100 + rng.choice([0, 0, 0, 1, 2]))].append(r)
    parts[1].append((2, 900, None, 500, 1000))
    tables = SessionTables(spark, str(tmp_path / "t"))
    feed(spark, tables, parts[:2])
    assert tables.merge_late()
    feed(spark, tables, parts[2:3], 2)
    feed(spark, tables, parts[2:3], 2)  # a committed batch is not folded again
    feed(spark, tables, parts[3:], 3)
    late, untimed = tables.arrived("late"), tables.arrived("untimed")
    on_time = tables.result().count()  # with the late ones of the first merge
    merged_before = late.filter("batch_id <= 1").count()
    used = [r for r in data if r[3]]
    assert late.count() > merged_before > 0
    assert on_time + late.count() - merged_before == len(used)
    assert [r.event_id for r in untimed.collect()] == [900]
    assert tables.merge_late() and not tables.merge_late()
    assert rows(tables.result()) == rows(batch_form(spark, data))
    assert rows(tables.result("expired"), ["session_id", "t_us", "prompt_tokens", "expired_us"]) == quiet_ends(data)
    # what comes after a merge follows the merged state
    newest = max(r[2] for r in data)
    more = [(s, 1000 + k, newest + k * S, 300 + 40 * k, 1000) for k, s in enumerate([7, 7, None, -1, 2])]
    feed(spark, tables, [more], 4)
    assert rows(tables.result()) == rows(batch_form(spark, data + more))


def test_a_run_that_dies_is_repeated(spark, tmp_path):
    data = samples(200, 9)
    tables, seen = SessionTables(spark, str(tmp_path / "t")), []

    def sink(monitored, batch_id):
        seen.append((batch_id, monitored.count()))
        if len(seen) == 2:
            raise RuntimeError("lost")

    write = session_sink(tables, sink)
    write(spark.createDataFrame(data[:100], SCHEMA), 0)
    with pytest.raises(RuntimeError):
        write(spark.createDataFrame(data[100:], SCHEMA), 1)
    assert tables.result().count() == seen[0][1]  # nothing of the dead run is seen
    write(spark.createDataFrame(data[100:], SCHEMA), 1)
    assert seen[1] == seen[2]
    assert rows(tables.result()) == rows(batch_form(spark, data))


def test_no_window_holds_a_session(spark, tmp_path):
    data = spark.createDataFrame(samples(60, 2), SCHEMA)
    M.session_state(M.track_sessions(data.filter("prompt_tokens > 0")), "session_id").write.parquet(str(tmp_path / "state"))
    carried = spark.read.parquet(str(tmp_path / "state"))
    tracked = M.track_sessions(data.withColumn("t_us", F.col("t_us") + 10**12), carried=carried)
    lines = tracked._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(re.match(r"[ :+-]*", x).group()) for x in lines]
    found = 0
    for i, line in enumerate(lines):
        if m := re.match(r"[ :+-]*Window \[.*\], \[([^\]]*)\], \[[^\]]*\]$", line):
            below = lines[i + 1:]
            stop = next((j for j, d in enumerate(depth[i + 1:]) if d <= depth[i]), len(below))
            found += 1
            # rows are windowed per slot; windows over a session run above an aggregate, one row per slot
            assert "chunk" in m.group(1) or any("Aggregate [session_id" in x for x in below[:stop])
    assert found >= 4
    assert "Python" not in "".join(lines)


def test_null_keys_are_apart_from_real_ones(spark):
    data = [(None, 1, 10 * S, 500, 1000), (-1, 2, 20 * S, 100, 1000), (None, 3, 30 * S, 400, 1000)]
    got = {r.event_id: r.prev_tokens for r in M.track_sessions(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {1: None, 2: None, 3: 500}
    df = spark.createDataFrame([("unnamed", 1, 5), (None, 2, 7)], "k string, t long, v long").withColumn("chunk", F.lit(0).cast("long"))
    out = with_running(df, Sequence(("k",), ("t",)), "sum", "v", "total").collect()
    assert sorted((r.k, r.total) for r in out) == [("unnamed", 5), ("unnamed", 7)]
