"""Session state over a stream of usage samples.

The fold keeps four numbers per session. It gives the columns of the batch form
as long as samples arrive in order across micro-batches; within one they are
sorted first. A micro-batch's rows of one session are folded in one task, so the
source should bound its batches (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import fixed
from tidemark.functions import usage as U
from tidemark.operators.running import flag, named
from tidemark.sources import status as T

OUTPUT = (
    "event_id BIGINT, t_us BIGINT, prompt_tokens BIGINT, max_context BIGINT, ratio DOUBLE, step BIGINT, tier INT, "
    "reset BOOLEAN, last_step BIGINT, last_bucket INT, fired_bucket INT, notice BOOLEAN"
)
STATE = "step BIGINT, bucket BIGINT, tokens BIGINT, t_us BIGINT"


def _before(values: np.ndarray, first: float) -> np.ndarray:
    return np.concatenate([[first], values[:-1]])


def fold(pdf: pd.DataFrame, state: tuple | None, idle_seconds: int = fixed.IDLE_SECONDS) -> tuple[pd.DataFrame, tuple]:
    """State columns of one session's samples that follow ``state``, and the state after them."""
    pdf = pdf.sort_values(["t_us", "event_id"], ignore_index=True)
    step0, bucket0, tokens0, t0 = state or (0, 0, 0, 0)
    tokens, t_us = pdf["prompt_tokens"].to_numpy(np.int64), pdf["t_us"].to_numpy(np.int64)
    limit = pdf["max_context"].to_numpy(np.float64)
    ratio = tokens / limit
    step = np.floor(ratio / fixed.STEP_RATIO).astype(np.int64)
    tier = np.array((0, *fixed.TIERS))[np.searchsorted(fixed.TIERS, ratio * 100, side="right")]

    prev, gap = _before(tokens, tokens0), t_us - _before(t_us, t0)
    both = (prev > 0) & (tokens > 0)
    reset = gap > idle_seconds * 1_000_000
    reset |= both & (prev / limit >= fixed.RESET_FLOOR) & (ratio < fixed.RESET_FLOOR)
    reset |= both & (tokens < prev * fixed.RESET_DROP)
    if state is None:
        reset[0] = False

    epoch = np.cumsum(reset)
    highest = pd.Series(tier).groupby(epoch).cummax().to_numpy()
    highest = np.where(epoch == 0, np.maximum(highest, bucket0), highest)
    last_bucket = np.where(reset, 0, _before(highest, bucket0)).astype(np.int64)
    last_step = np.where(reset, 0, _before(step, step0)).astype(np.int64)
    fired = np.where(tier > last_bucket, tier, -1)
    out = pd.DataFrame({
        "event_id": pdf["event_id"], "t_us": t_us, "prompt_tokens": tokens, "max_context": pdf["max_context"],
        "ratio": ratio, "step": step, "tier": tier, "reset": reset, "last_step": last_step, "last_bucket": last_bucket,
        "fired_bucket": pd.array(fired, dtype="Int64"), "notice": step > last_step,
    })
    out.loc[fired < 0, "fired_bucket"] = pd.NA
    return out, (int(step[-1]), int(highest[-1]), int(tokens[-1]), int(t_us[-1]))


def monitor_stream(usage: DataFrame, idle_seconds: int = fixed.IDLE_SECONDS, late_seconds: int = 600) -> DataFrame:
    """Triggers and notices of a stream (session_id, event_id, t_us, prompt_tokens, max_context).

    Samples older than the watermark are dropped; samples without a session are
    one session, and those without a time have no place. The state of a session goes
    when the watermark has passed its last sample by the idle time: its next
    sample would reset it anyway.
    """
    kind = usage.schema["session_id"].dataType.simpleString()
    name = "session_id"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True)
        out, after = fold(rows, tuple(state.get) if state.exists else None, idle_seconds)
        state.update(after)
        ends = after[3] // 1000 + (idle_seconds + late_seconds) * 1000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        out.insert(0, name, key[0])
        yield out

    samples = named(usage.filter("prompt_tokens != 0 and t_us is not null"), name).select(
        name, flag(name), "event_id", "t_us", "prompt_tokens", "max_context", F.timestamp_micros("t_us").alias("ts")
    )
    return (
        samples.withWatermark("ts", f"{late_seconds} seconds")
        .groupBy(name, flag(name))
        .applyInPandasWithState(step, f"{name} {kind}, {OUTPUT}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def status_rows(monitored: DataFrame) -> DataFrame:
    """Status texts of monitored samples."""
    text = U.status_text(F.col("ratio"), F.col("fired_bucket").isNotNull())
    return monitored.select("session_id", "t_us", "event_id", text.alias("status"))


def status_sink(root: str):
    """For ``foreachBatch``: keep the last status of each session in a versioned table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        T.write_status(status_rows(batch), root, batch_id)

    return write
