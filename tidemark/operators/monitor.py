"""Session state over usage rows: resets, step notices, tier triggers.

The reset rule looks at the previous sample only, so the state machine is a set
of running values. They are computed per (session, time slot), and one row per
slot carries the state onwards, so that no task holds a whole session (see
``running``). All values derive from tokens and limit after the one shuffle of
the samples, which the slot summary and the samples share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import usage as U
from tidemark.operators.running import Sequence, named, placed, slot, unplaced, with_running

SESSION = Sequence(keys=("session_id",), order=("t_us", "event_id"))
SLOT_US = 600_000_000
SAMPLE = ("prompt_tokens", "t_us", "max_context")


def reset_reason(prev: str, cur: str = "", idle_seconds: int = fixed.IDLE_SECONDS) -> Column:
    """Name of the first reset rule that holds between two samples.

    ``prev`` and ``cur`` are prefixes of their columns; both ratios use the
    current limit.
    """
    p, c, limit = f"{prev}prompt_tokens", f"{cur}prompt_tokens", f"cast({cur}max_context as double)"
    floor, drop = f"cast('{fixed.RESET_FLOOR}' as double)", f"cast('{fixed.RESET_DROP}' as double)"
    return F.expr(f"""case
        when {cur}t_us - {prev}t_us > {idle_seconds * 1_000_000} then 'idle'
        when {p} > 0 and {c} > 0 and {p} / {limit} >= {floor} and {c} / {limit} < {floor} then 'below_floor'
        when {p} > 0 and {c} > 0 and {c} < {p} * {drop} then 'drop' end""")


def session_state(tracked: DataFrame, *keys: str) -> DataFrame:
    """What later samples need of a session: its last sample, its epoch and the highest tier in it (``top``)."""
    end = F.struct("event_id", *SAMPLE, "epoch", F.greatest("last_bucket", "tier").alias("top"))
    last = F.max_by(end, F.struct("t_us", "event_id"))
    return tracked.groupBy(*keys).agg(last.alias("_end")).select(*keys, "_end.*")


def track_sessions(
    usage: DataFrame, idle_seconds: int = fixed.IDLE_SECONDS, slot_us: int = SLOT_US, carried: DataFrame | None = None
) -> DataFrame:
    """The whole state machine, one output row per sample that has a time.

    Samples without a session are one session of their own. ``carried`` is the
    ``session_state`` that the samples follow: one more row per session before
    its slots.

    Adds previous sample, reset reason, epoch, last step and last bucket before
    the sample, ``notice``, ``pending`` (thresholds passed since the last one
    fired in the epoch) and ``fired_bucket`` (the highest of them).
    """
    seq = SESSION
    upto = seq.rows().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = seq.rows().rowsBetween(Window.unboundedPreceding, -1)
    df = placed(usage.withColumn("chunk", slot("t_us", slot_us)), seq)
    df = df.withColumn("_here", F.lag(F.struct(*SAMPLE)).over(seq.rows()))
    ratio = F.expr("cast(prompt_tokens as double) / cast(max_context as double)")
    df = df.withColumns({
        "ratio": ratio,
        "_change": reset_reason("_here.", "", idle_seconds).isNotNull().cast("bigint"),
    })
    df = df.withColumns({"tier": U.tier_of(F.col("ratio")), "_local": F.sum("_change").over(upto)})

    # One row per slot: first and last sample, resets inside, maximum after the last of them.
    ends = df.groupBy(*seq.cut).agg(
        F.min_by(F.struct(*SAMPLE), seq.position()).alias("first"),
        F.max_by(F.struct(*SAMPLE), seq.position()).alias("last"),
        F.max(F.struct("_local", "tier")).alias("end"),
    )
    if carried is not None:
        sample = F.struct(*SAMPLE)
        start = named(carried, *seq.keys).select(
            *seq.parts, F.lit(-(1 << 63)).alias("chunk"), sample.alias("first"), sample.alias("last"),
            F.struct(F.col("epoch").alias("_local"), F.col("top").alias("tier")).alias("end"),
        )
        ends = ends.unionByName(start)
    chunks = seq.chunks()
    ends = ends.withColumn("prev", F.lag("last").over(chunks))
    ends = ends.withColumn("_at_first", reset_reason("prev.", "first.", idle_seconds).isNotNull().cast("bigint"))
    ends = ends.withColumn("_n", F.col("_at_first") + F.col("end._local"))
    ends = ends.withColumn("_run", F.sum((F.col("_n") > 0).cast("bigint")).over(chunks))
    ends = ends.withColumn("_state", F.max(F.struct("_run", "end.tier")).over(chunks)["tier"])
    before = ends.select(
        *seq.cut,
        F.col("prev").alias("_before"),
        F.when(F.col("_at_first") == 0, F.lag("_state").over(chunks)).alias("_tier_before"),
        (F.sum("_n").over(chunks) - F.col("end._local")).alias("_epoch_before"),
    )

    df = df.withColumn("_top", F.max(F.struct("_local", "tier")).over(earlier)).join(before, seq.cut)
    df = df.withColumns({
        "_prev": F.coalesce("_here", "_before"),
        "epoch": F.col("_epoch_before") + F.col("_local"),
        "last_bucket": F.expr(
            "greatest(0, case when _top._local = _local then _top.tier end, case when _local = 0 then _tier_before end)"
        ),
    })
    df = df.withColumns({
        "prev_tokens": F.col("_prev.prompt_tokens"),
        "prev_t_us": F.col("_prev.t_us"),
        "reset_reason": reset_reason("_prev.", "", idle_seconds),
        "step": U.step_of(F.col("ratio")),
        "_prev_step": U.step_of(F.expr("cast(_prev.prompt_tokens as double) / cast(_prev.max_context as double)")),
        "fired_bucket": F.expr("case when tier > last_bucket then tier end"),
    })
    tiers = ", ".join(str(b) for b in fixed.TIERS)
    return df.withColumns({
        "last_step": F.expr("case when reset_reason is null then coalesce(_prev_step, 0) else 0 end"),
        "notice": F.expr("step > case when reset_reason is null then coalesce(_prev_step, 0) else 0 end"),
        "pending": F.expr(f"filter(array({tiers}), b -> b > last_bucket and b <= tier)"),
    }).drop("_here", "_change", "_local", "_top", "_before", "_tier_before", "_epoch_before", "_prev", "_prev_step", "chunk", *seq.flags)


def untimed(usage: DataFrame) -> DataFrame:
    """Samples without a time: they have no place in any session and are left out of ``track_sessions``."""
    return unplaced(usage, "t_us")


def step_notices(tracked: DataFrame) -> DataFrame:
    return tracked.filter("notice")


def tier_triggers(tracked: DataFrame) -> DataFrame:
    return tracked.filter(F.col("fired_bucket").isNotNull())


def pending_tiers(tracked: DataFrame) -> DataFrame:
    """One row per pending threshold, in order."""
    return tracked.select("session_id", "event_id", "t_us", F.posexplode("pending").alias("pos", "bucket"))


def monotone_notices(
    usage: DataFrame, keys: tuple[str, ...], limit: int = fixed.CONTEXT_WINDOW, slot_us: int = SLOT_US
) -> DataFrame:
    """5% buckets above every earlier bucket of the key; they never reset."""
    bucket = F.expr(f"cast(floor(cast(prompt_tokens as double) / {float(limit)}D * 100 / 5) * 5 as bigint)")
    seq = Sequence(keys=keys, order=SESSION.order)
    df = usage.select(*keys, *seq.order, bucket.alias("bucket"), slot("t_us", slot_us).alias("chunk"))
    df = with_running(df, seq, "max", "bucket", "last_bucket", inclusive=False, reuse=True)
    df = df.withColumn("last_bucket", F.expr("greatest(last_bucket, 0L)"))
    return df.filter("bucket > last_bucket").drop("chunk")


def latest_status(tracked: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Last status text per key; without keys, the last one overall."""
    text = U.status_text(F.col("ratio"), F.col("fired_bucket").isNotNull())
    last = F.max_by(F.struct("t_us", "event_id", text.alias("status")), F.struct("t_us", "event_id"))
    return tracked.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


def trigger_summary(tracked: DataFrame) -> DataFrame:
    """Fired triggers per session and threshold."""
    return tier_triggers(tracked).groupBy("session_id", "fired_bucket").agg(F.count("*").alias("n_fired"))


def reset_summary(tracked: DataFrame) -> DataFrame:
    """Resets per session and reason."""
    return (
        tracked.filter(F.col("reset_reason").isNotNull())
        .groupBy("session_id", "reset_reason")
        .agg(F.count("*").alias("n_resets"))
    )
