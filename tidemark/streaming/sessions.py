"""Session state over a stream of samples, batch by batch, with a place for late ones.

Each micro-batch is one run of the batch operator: windows work per (session, time
slot), one summary row per slot carries the state from slot to slot, and what a
session had at the end of the last batch is one more such row before its slots.
No task holds a session, so one that has a third of all rows is spread over its
slots. The state of sessions that can still go on is a table of one row each.

A sample is late when it cannot be appended any more: its session has a later one
already, or is forgotten and the sample is older than the watermark. Late samples
go to a table of their own, and ``merge_late`` replays the sessions that they
touch, so on-time and late samples together are all samples and the merged
result is that of the batch operator. Samples without a time have no place; they
are kept in ``untimed``.

A session that has been quiet for the idle time and the watermark's delay leaves a
row in ``expired`` with its last state: its next sample would be a reset anyway.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import monitor as M
from tidemark.operators.running import flag, named
from tidemark.session import release, stage
from tidemark.sources import ledger as L

KEY, LATE_SECONDS = "session_id", 600
RAW = (KEY, "event_id", "t_us", "prompt_tokens", "max_context")
COMMIT = "max_t_us BIGINT, n_on_time BIGINT, n_late BIGINT"


def _schemas(kind: str) -> dict[str, str]:
    sample = f"{KEY} {kind}, event_id BIGINT, t_us BIGINT, prompt_tokens BIGINT, max_context BIGINT"
    derived = "ratio DOUBLE, step BIGINT, tier INT, last_step BIGINT, last_bucket INT, fired_bucket INT, notice BOOLEAN"
    return {
        "samples": f"{sample}, unnamed BOOLEAN, {derived}, prev_t_us BIGINT, prev_tokens BIGINT, epoch BIGINT",
        "late": sample,
        "untimed": sample,
        "expired": f"{KEY} {kind}, unnamed BOOLEAN, t_us BIGINT, prompt_tokens BIGINT, expired_us BIGINT",
        "state": f"{sample}, epoch BIGINT, top INT",
        "touched": f"{KEY} {kind}, unnamed BOOLEAN",
    }


class SessionTables:
    """The tables below ``root`` for sessions of SQL type ``kind``."""

    def __init__(
        self, spark: SparkSession, root: str, kind: str = "BIGINT", idle_seconds: int = fixed.IDLE_SECONDS,
        late_seconds: int = LATE_SECONDS, slot_us: int = M.SLOT_US,
    ):
        self.spark, self.root, self.schemas = spark, root, _schemas(kind)
        self.idle_seconds, self.late_us, self.slot_us = idle_seconds, late_seconds * 1_000_000, slot_us
        self.quiet_us = idle_seconds * 1_000_000 + self.late_us

    def _last(self, table: str = L.COMMITS):
        return L.last_commit(self.spark, self.root, COMMIT, table)

    def _upto(self) -> int | None:
        last = self._last()
        return last and last["batch_id"]

    def arrived(self, table: str) -> DataFrame:
        """Rows of ``late`` or ``untimed`` over all committed batches, with the batch they came in."""
        return L.committed(self.spark, self.root, table, self.schemas[table], self._upto())

    def result(self, table: str = "samples") -> DataFrame:
        """``samples`` or ``expired`` as they are after the last merge; samples without a session as the batch operator names them."""
        rows = L.committed(self.spark, self.root, table, self.schemas[table], self._upto())
        done = self._last("merges")
        if done is None:
            return rows.drop("unnamed", "batch_id")
        key = [KEY, "unnamed"]
        merges = L.committed(self.spark, self.root, "touched", self.schemas["touched"], done["batch_id"])
        merges = merges.groupBy(*key).agg(F.max("batch_id").alias("_merge"))  # one row per session that was ever late
        merged = L.committed(self.spark, self.root, f"merged_{table}", self.schemas[table], done["batch_id"])
        # what came after a session's last merge, and what that merge made of all before
        after = rows.join(merges, key, "left").filter(F.col("_merge").isNull() | (F.col("batch_id") > F.col("_merge")))
        replayed = merged.join(merges, key).filter("batch_id = _merge")
        return after.unionByName(replayed).drop("unnamed", "batch_id", "_merge")

    def _state(self, last: int | None) -> DataFrame:
        """State of the sessions that can go on after batch ``last``, corrected by a merge that followed it."""
        rows = L.read_all(self.spark, self.root, "state", self.schemas["state"]).filter(F.lit(False) if last is None else F.col("batch_id") == last)
        done = self._last("merges")
        if last is None or done is None or done["batch_id"] != last:
            return rows.drop("batch_id")
        at = F.col("batch_id") == last
        touched = L.read_all(self.spark, self.root, "touched", self.schemas["touched"]).filter(at)
        fixed_rows = L.read_all(self.spark, self.root, "merged_state", self.schemas["state"]).filter(at)
        kept = rows.withColumn("unnamed", F.col(KEY).isNull())
        kept = named(kept, KEY).join(touched, [KEY, "unnamed"], "left_anti").withColumn(KEY, F.when(~F.col("unnamed"), F.col(KEY)))
        return kept.select(*fixed_rows.columns).unionByName(fixed_rows).drop("batch_id")

    def _track(self, rows: DataFrame, carried: DataFrame | None) -> DataFrame:
        tracked = M.track_sessions(rows.withColumn("unnamed", F.col(KEY).isNull()), self.idle_seconds, self.slot_us, carried)
        return tracked.withColumn("notice", F.coalesce("notice", F.lit(False)))

    def _columns(self, table: str) -> list[str]:
        return [c.split()[0] for c in self.schemas[table].split(", ")]

    def _ends(self, tracked: DataFrame) -> DataFrame:
        ends = M.session_state(tracked, KEY, "unnamed")
        return ends.withColumn(KEY, F.when(~F.col("unnamed"), F.col(KEY))).select(*self._columns("state"))

    def _went_quiet(self, tracked: DataFrame) -> DataFrame:
        """Previous samples that were the last ones for longer than a session's state is kept."""
        quiet = tracked.filter(F.col("t_us") - F.col("prev_t_us") > self.quiet_us)
        return quiet.select(
            KEY, "unnamed", F.col("prev_t_us").alias("t_us"), F.col("prev_tokens").alias("prompt_tokens"),
            (F.col("prev_t_us") + self.quiet_us).alias("expired_us"),
        )

    def _timed_out(self, ends: DataFrame) -> DataFrame:
        rows = ends.withColumn("unnamed", F.col(KEY).isNull())
        return named(rows, KEY).select(KEY, "unnamed", "t_us", "prompt_tokens", (F.col("t_us") + self.quiet_us).alias("expired_us"))

    def _over(self, newest: int | None) -> Column:
        return F.lit(False) if newest is None else F.col("t_us") + self.quiet_us < newest

    def fold(self, batch: DataFrame, batch_id: int, sinks: Iterable[Callable[[DataFrame, int], None]] = ()) -> None:
        """Fold one micro-batch. One that is committed already is left as it is.

        ``sinks`` get the batch's monitored samples and its id before the commit, so
        they see a batch again when a run dies in between.
        """
        last = self._last()
        if last is not None and last["batch_id"] >= batch_id:
            return
        # read in our own session: its settings hold, those of the stream do not
        arrived = stage(batch.filter("prompt_tokens != 0").select(*RAW), "arrived", self.spark)
        untimed = arrived.filter("t_us is null")
        before, newest = last and last["batch_id"], last["max_t_us"] if last else None
        state = self._state(before)
        key = [KEY, flag(KEY)]
        known = named(state, KEY).select(*key, F.struct("t_us", "event_id").alias("_last"))
        timed = named(arrived.filter("t_us is not null"), KEY).join(known, key, "left")
        old = F.lit(False) if newest is None else F.col("t_us") < newest - self.late_us
        is_late = F.coalesce(F.struct("t_us", "event_id") <= F.col("_last"), old)
        judged = timed.withColumn(KEY, F.when(~F.col(flag(KEY)), F.col(KEY))).withColumn("late", is_late).select(*RAW, "late")
        judged = stage(judged, "judged")
        late, on_time = judged.filter("late").drop("late"), judged.filter("not late").drop("late")
        samples = self._columns("samples")
        L.write(self._track(on_time, state).select(*samples), self.root, "samples", batch_id)
        tracked = L.read_all(self.spark, self.root, "samples", self.schemas["samples"]).filter(F.col("batch_id") == batch_id).select(*samples)
        counts = judged.agg(F.max("t_us"), F.count_if(~F.col("late")), F.count_if("late")).first()
        newest = max((t for t in (newest, counts[0]) if t is not None), default=None)

        fresh = self._ends(tracked)
        gone = named(fresh.select(KEY), KEY).select(*key)
        rest = named(state, KEY).join(gone, key, "left_anti").withColumn(KEY, F.when(~F.col(flag(KEY)), F.col(KEY))).select(*fresh.columns)
        ends = stage(fresh.unionByName(rest), "ends")
        L.write(late, self.root, "late", batch_id)
        L.write(untimed, self.root, "untimed", batch_id)
        L.write(self._went_quiet(tracked).unionByName(self._timed_out(ends.filter(self._over(newest)))), self.root, "expired", batch_id)
        L.write(ends.filter(~self._over(newest)), self.root, "state", batch_id)
        for sink in sinks:
            sink(tracked, batch_id)
        L.commit(self.spark, self.root, batch_id, COMMIT, newest, counts[1], counts[2])
        release(arrived, judged, ends)
        if before is not None:
            L.forget(self.spark, self.root, "state", before)

    def merge_late(self) -> bool:
        """Replay the sessions that late samples touch since the last merge; false when there are none.

        Runs between two batches. A merge is named by the last batch it covers.
        """
        last, done = self._last(), self._last("merges")
        if last is None or done is not None and done["batch_id"] >= last["batch_id"]:
            return False
        upto, at = last["batch_id"], F.col("batch_id")
        late = L.committed(self.spark, self.root, "late", self.schemas["late"], upto)
        fresh = late.filter(at > done["batch_id"]) if done is not None else late
        key = [KEY, flag(KEY)]
        touched = stage(named(fresh.select(KEY), KEY).distinct(), "touched")
        if touched.isEmpty():
            release(touched)
            return False
        on_time = L.committed(self.spark, self.root, "samples", self.schemas["samples"], upto)
        on_time = on_time.withColumn(KEY, F.when(~F.col("unnamed"), F.col(KEY))).select(*RAW)
        rows = named(on_time.unionByName(late.select(*RAW)), KEY).join(touched, key, "left_semi")
        rows = rows.withColumn(KEY, F.when(~F.col(flag(KEY)), F.col(KEY))).select(*RAW)
        tracked = stage(self._track(rows, None), "replayed")
        ends = stage(self._ends(tracked), "ends")
        over = self._over(last["max_t_us"])
        L.write(touched.select(KEY, F.col(flag(KEY)).alias("unnamed")), self.root, "touched", upto)
        L.write(tracked.select(*self._columns("samples")), self.root, "merged_samples", upto)
        L.write(self._went_quiet(tracked).unionByName(self._timed_out(ends.filter(over))), self.root, "merged_expired", upto)
        L.write(ends.filter(~over), self.root, "merged_state", upto)
        L.commit(self.spark, self.root, upto, COMMIT, last["max_t_us"], 0, 0, table="merges")
        release(touched, tracked, ends)
        return True


def session_sink(tables: SessionTables, *sinks: Callable[[DataFrame, int], None]):
    """For ``foreachBatch``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.fold(batch, batch_id, sinks)

    return write
