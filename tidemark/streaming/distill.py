"""Distillation of files as they arrive or change, in increments.

An increment is a snapshot of the files of one batch. Of a path that is in several
increments the last one counts; a member without a key says that the path is gone
(tombstone). ``compact`` folds all increments into one snapshot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B
from tidemark.functions import redact as R
from tidemark.operators import index as I
from tidemark.operators import monitor as M
from tidemark.plans.distill_run import distill
from tidemark.session import release, stage
from tidemark.sources import ledger as L
from tidemark.sources import snapshot as N
from tidemark.sources.files import stream_files

RUN = "n_fired BIGINT, n_changed BIGINT, n_gone BIGINT"
KNOWN, DISTILLED = "path STRING, hash STRING", "path STRING, gone BOOLEAN"


def part_name(batch_id: int) -> str:
    return f"part-{batch_id:012d}"


def _write_part(run, gone: DataFrame | None, root: str, batch_id: int, **stamp) -> None:
    """An increment, with a tombstone for each path of ``gone``."""
    if gone is not None:
        names = [f.split() for f in N.SCHEMAS["members"].split(", ")]
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in names if name != "path"]
        run.members = run.members.unionByName(gone.select("path", *empty))
    N.write_snapshot(run, root, part_name(batch_id), **stamp)


def increment_sink(root: str, kinds=B.CODE_KINDS, spark: SparkSession | None = None, literal=R.CODE_TOKENS, **stamp):
    """For ``foreachBatch``: the new files of a batch become a snapshot of their own."""

    def write(files: DataFrame, batch_id: int) -> None:
        rows = stage(files.select("path", "ext", "text", "n_bytes"), "files", spark)
        _write_part(distill(rows, kinds, shard=str(batch_id), literal=literal), None, root, batch_id, **stamp)
        release(rows)

    return write


def distill_new_files(
    spark: SparkSession, folder: str, root: str, checkpoint: str, per_trigger: int = 10_000, kinds=B.CODE_KINDS, literal=R.CODE_TOKENS,
    exts: tuple[str, ...] = fixed.SOURCE_EXTENSIONS, deliveries: bool = False, **stamp,
):
    """Distil all files not seen before, then stop.

    A stream sees each place of a file once. With ``deliveries`` files come in one
    folder per delivery, whose name is no part of their path, so that a path can
    come again.
    """
    files = stream_files(spark, folder, exts, per_trigger)
    if deliveries:
        files = files.withColumn("path", F.regexp_replace("path", "^[^/]*/", ""))
    return (
        files
        .writeStream.foreachBatch(increment_sink(root, kinds, spark, literal, **stamp))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class DeltaRuns:
    """Runs that a fired threshold starts; each distils the files that changed since the last one.

    ``listing(batch_id)`` gives the files (path, ext, text, n_bytes) as they are
    when the batch fires. A batch that fired nothing, or found no change, or was
    committed before, distils nothing. What a run saw of each file is its hash,
    in ``known``; which files it distilled or found gone is in ``distilled``.
    """

    def __init__(
        self, spark: SparkSession, root: str, listing: Callable[[int], DataFrame], kinds=B.CODE_KINDS, literal=R.CODE_TOKENS, **stamp
    ):
        self.spark, self.root, self.listing, self.kinds, self.literal, self.stamp = spark, root, listing, kinds, literal, stamp

    def sink(self, monitored: DataFrame, batch_id: int) -> None:
        """For ``session_sink``, or ``foreachBatch`` over monitored samples."""
        last = L.last_commit(self.spark, self.root, RUN, "runs")
        if last is not None and last["batch_id"] >= batch_id:
            return
        # a full count: a batch that is read in part would not save its state
        fired = M.tier_triggers(monitored).count()
        if fired == 0:
            self._commit(batch_id, 0, 0, 0)
            return
        files = self.listing(batch_id).select("path", "ext", "text", "n_bytes")
        before = self._known(last and last["batch_id"])
        seen = stage(I.content_hashes(files, "path"), "hashes")  # contents are hashed where they lie
        new = seen.join(before, ["path", "hash"], "left_anti")
        gone = before.join(seen, "path", "left_anti").select("path")
        done = stage(new.select("path", F.lit(False).alias("gone")).unionByName(gone.withColumn("gone", F.lit(True))), "done")
        n = done.agg(F.count_if(~F.col("gone")), F.count_if("gone")).first()
        if n[0] + n[1] > 0:
            rows = stage(files.join(done.filter("not gone").select("path"), "path", "left_semi"), "changed")
            run = distill(rows, self.kinds, shard=str(batch_id), literal=self.literal)
            _write_part(run, done.filter("gone"), self.root, batch_id, **self.stamp)
            release(rows)
        L.write(done, self.root, "distilled", batch_id)
        L.write(seen, self.root, "known", batch_id)
        self._commit(batch_id, fired, n[0], n[1])
        release(seen, done)
        L.forget(self.spark, self.root, "known", batch_id)

    def _commit(self, batch_id: int, *figures: int) -> None:
        L.commit(self.spark, self.root, batch_id, RUN, *figures, table="runs")

    def _known(self, upto: int | None) -> DataFrame:
        """Hashes of the files that the last run saw; runs that did nothing keep no list."""
        rows = L.committed(self.spark, self.root, "known", KNOWN, upto)
        newest = rows.agg(F.max("batch_id")).first()[0]
        return rows.filter(F.lit(False) if newest is None else F.col("batch_id") == newest).drop("batch_id")

    def distilled(self) -> DataFrame:
        """(path, gone, batch_id) of all committed runs."""
        last = L.last_commit(self.spark, self.root, RUN, "runs")
        return L.committed(self.spark, self.root, "distilled", DISTILLED, last and last["batch_id"])

    def runs(self) -> DataFrame:
        """(n_fired, n_changed, n_gone, batch_id): one row per batch, idle ones too."""
        return L.read_all(self.spark, self.root, "runs", RUN)


def _rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(f"{N.SCHEMAS[table]}, {N.PLACE}").parquet(f"{root}/{table}")


def _latest(spark: SparkSession, root: str) -> DataFrame:
    """The last member row of each path over all committed increments, with its place; paths that are gone left out."""
    done = N.read_meta(spark, root).select("snapshot_id", "attempt", "ts")
    rows = _rows(spark, root, "members").join(done, ["snapshot_id", "attempt"])
    rest = [c for c in rows.columns if c not in ("path", "ts")]
    last = F.max_by(F.struct(*rest), F.struct("ts", "snapshot_id"))
    return rows.groupBy("path").agg(last.alias("_l")).select("path", "_l.*").filter("key is not null")


def latest_members(spark: SparkSession, root: str) -> DataFrame:
    """Members over all committed increments: the last one of each path that is not gone, with its ``snapshot_id``."""
    return _latest(spark, root).drop("attempt")


def _of_latest(spark: SparkSession, root: str, table: str, key: str) -> DataFrame:
    """Rows of a table over all increments that the latest members point to."""
    place = [key, "snapshot_id", "attempt"]
    return _rows(spark, root, table).join(_latest(spark, root).select(*place).distinct(), place, "left_semi").drop("attempt")


def latest_skeletons(spark: SparkSession, root: str) -> DataFrame:
    """Skeletons and buckets over all committed increments that hold the latest form of some path."""
    return _of_latest(spark, root, "skeletons", "key")


def latest_source_map(spark: SparkSession, root: str) -> DataFrame:
    """The source map over all committed increments: that of the last one of each path."""
    return _of_latest(spark, root, "source_map", "path")


def compact(spark: SparkSession, root: str, drop: bool = True, **stamp) -> str | None:
    """Fold all increments into one snapshot, which then is the only one; gives its id.

    A path keeps its latest form, paths that are gone lose their tombstones, and
    buckets stay as long as one member does. Bucket keys are those of their
    increments, which differ. The increments are deleted once the new snapshot is
    committed, unless ``drop`` is false.
    """
    parts = [r["snapshot_id"] for r in N.read_meta(spark, root).orderBy("ts", "snapshot_id").select("snapshot_id").collect()]  # one per increment
    if not parts or len(parts) == 1 and parts[0].endswith("-base"):
        return parts[0] if parts else None
    name = f"{parts[-1]}-base"
    whole = N.Snapshot(latest_skeletons(spark, root), latest_members(spark, root), latest_source_map(spark, root))
    N.write_snapshot(whole, root, name, **stamp)
    if drop:
        N.drop_attempts(spark, root, parts)
    return name
