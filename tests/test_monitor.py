import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lookups as L
from tidemark.operators import monitor as M
from tidemark.operators.running import Sequence, slot, with_previous, with_running
from tidemark.streaming.monitor import fold

TIERS = [20, 30, 40, 50, 60, 70]
SCHEMA = "session_id string, event_id long, t_us long, prompt_tokens long, max_context long"


def replay(rows, idle=300):
    """The rules one sample at a time."""
    out, state = {}, {}
    for s, e, t, n, m in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        st = state.get(s)
        last_step, last_bucket, epoch, reason = 0, 0, 0, None
        if st:
            last_step, last_bucket, epoch = st["step"], st["bucket"], st["epoch"]
            if t - st["t"] > idle * 1_000_000:
                reason = "idle"
            elif st["n"] / m >= 0.10 and n / m < 0.10:
                reason = "below_floor"
            elif n < st["n"] * 0.5:
                reason = "drop"
            if reason:
                last_step, last_bucket, epoch = 0, 0, epoch + 1
        step, pct = math.floor(n / m / 0.05), n / m * 100
        pending = [b for b in TIERS if last_bucket < b <= pct]
        fired = pending[-1] if pending else None
        out[(s, e)] = (reason, epoch, step, last_step, step > last_step, last_bucket, tuple(pending), fired,
                       st and st["n"], st and st["t"])
        state[s] = {"t": t, "n": n, "step": step, "bucket": fired or last_bucket, "epoch": epoch}
    return out


def samples(seed, n=1500):
    rng = random.Random(seed)
    rows, t = [], {}
    for e in range(n):
        # one session holds most of the rows
        s = "hot" if rng.random() < 0.6 else f"s{rng.randint(0, 8)}"
        gap = rng.choice([0, 1, 20, 60, 299, 300, 301, 900])
        t[s] = t.get(s, rng.randint(0, 10**4) * 10**6) + gap * 10**6
        m = rng.choice([1000, 1000, 1000, 2000])
        rows.append((s, e, t[s], rng.choice([rng.randint(1, m), 100, 99, 150, 200, 700]), m))
    return rows


def got(df):
    return {
        (r.session_id, r.event_id): (
            r.reset_reason, r.epoch, r.step, r.last_step, r.notice, r.last_bucket, tuple(r.pending), r.fired_bucket,
            r.prev_tokens, r.prev_t_us,
        )
        for r in df.collect()
    }


@pytest.mark.parametrize("slot_s", [7, 600, 10**7])
def test_replay(spark, slot_s):
    rows = samples(slot_s)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert got(M.track_sessions(df, slot_us=slot_s * 10**6)) == replay(rows)


@pytest.mark.parametrize("cuts", [1, 4, 50])
def test_stream_fold_is_the_same(cuts):
    rows = samples(cuts)
    want = replay(rows)
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
        state, size = None, -(-len(mine) // cuts)
        for i in range(0, len(mine), size):
            part = mine[i : i + size]
            random.Random(i).shuffle(part)
            pdf = pd.DataFrame(part, columns=["session_id", "event_id", "t_us", "prompt_tokens", "max_context"])
            out, state = fold(pdf, state)
            for r in out.itertuples():
                w = want[(s, r.event_id)]
                fired = None if pd.isna(r.fired_bucket) else r.fired_bucket
                assert (r.reset, r.step, r.last_step, r.notice, r.last_bucket, fired) == (w[0] is not None, *w[2:6], w[7])


def test_boundaries(spark):
    s = 10**6
    rows = [
        ("gap", 1, 0, 300, 1000), ("gap", 2, 299 * s, 300, 1000), ("gap", 3, 599 * s, 300, 1000), ("gap", 4, 900 * s, 300, 1000),
        ("floor", 1, 0, 100, 1000), ("floor", 2, s, 99, 1000), ("floor", 3, 2 * s, 98, 1000),
        ("half", 1, 0, 800, 1000), ("half", 2, s, 400, 1000), ("half", 3, 2 * s, 199, 1000),
        ("tie", 2, 0, 700, 1000), ("tie", 1, 0, 200, 1000),
    ]
    r = got(M.track_sessions(spark.createDataFrame(rows, SCHEMA)))
    assert [r[("gap", e)][0] for e in (1, 2, 3, 4)] == [None, None, None, "idle"]
    assert [r[("floor", e)][0] for e in (1, 2, 3)] == [None, "below_floor", None]
    assert [r[("half", e)][0] for e in (1, 2, 3)] == [None, None, "drop"]
    assert r[("tie", 1)][7] == 20 and r[("tie", 2)][6] == (30, 40, 50, 60, 70) and r[("tie", 2)][7] == 70


def test_a_dip_gives_the_step_notice_again(spark):
    rows = [("a", i, i, n, 1000) for i, n in enumerate([400, 350, 400])]
    df = M.track_sessions(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.event_id for r in M.step_notices(df).collect()) == [0, 2]
    mono = M.monotone_notices(spark.createDataFrame(rows, SCHEMA), ("session_id",), limit=1000)
    assert [r.event_id for r in mono.collect()] == [0]


def test_status(spark):
    rows = [("a", 1, 1, 123, 1000), ("a", 2, 2, 124, 1000), ("b", 3, 3, 505, 1000)]
    df = M.track_sessions(spark.createDataFrame(rows, SCHEMA))
    assert {r.session_id: r.status for r in M.latest_status(df).collect()} == {"a": "GCS: 12.4%", "b": "[GCS: 50.5% ⚡ YOLO]"}
    assert M.latest_status(df, ()).first().status == "[GCS: 50.5% ⚡ YOLO]"
    assert {(r.session_id, r.fired_bucket, r.n_fired) for r in M.trigger_summary(df).collect()} == {("b", 50, 1)}


@pytest.mark.parametrize("reuse", [False, True])
@pytest.mark.parametrize("fn, inclusive", [("sum", True), ("sum", False), ("max", True), ("max", False)])
def test_running_values(spark, fn, inclusive, reuse):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else "b", rng.randint(0, 200), e, rng.randint(-9, 9)) for e in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, e long, v long").withColumn("chunk", slot("t", 7))
    seq = Sequence(("k",), ("t", "e"))
    res = {(r.k, r.e): r.x for r in with_running(df, seq, fn, "v", "x", inclusive, reuse).collect()}
    for k in ("hot", "b"):
        seen = []
        for _, t, e, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            part = seen + [v] if inclusive else seen
            want = sum(part) if fn == "sum" else (max(part) if part else None)
            assert res[(k, e)] == want
            seen.append(v)


def test_previous(spark):
    rows = [("a", t, e, 10 * e) for e, t in enumerate([5, 3, 900, 4, 900, 100])]
    df = spark.createDataFrame(rows, "k string, t long, e long, v long").withColumn("chunk", slot("t", 50))
    got_prev = {r.e: r.prev and r.prev.v for r in with_previous(df, Sequence(("k",), ("t", "e")), ["v"]).collect()}
    assert got_prev == {1: None, 3: 10, 0: 30, 5: 0, 2: 50, 4: 20}


def test_lookup_tiers(spark):
    day = 86_400_000_000
    rows = [("k", 0, 1), ("k", day, 2), ("k", day, 3), ("j", 5, 4)]
    df = spark.createDataFrame(rows, "key string, t_us long, event_id long")
    assert {r.event_id: (r.tier, r.n_lookups) for r in L.lookup_tiers(df).collect()} == {
        1: ("L2", 1), 2: ("L1", 2), 3: ("L1", 3), 4: ("L2", 1),
    }
