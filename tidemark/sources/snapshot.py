"""Versioned snapshots as Parquet tables.

Each attempt to write a snapshot has folders of its own,
``<table>/snapshot_id=<id>/attempt=<name>``, and a row in ``meta`` that is written
last and makes it visible. The newest committed attempt of an id is the snapshot:
writing an id again swaps it in one step, a run that dies midway is never seen,
and a reader that began before goes on with the files it knows.
``drop_attempts`` deletes what no row in ``meta`` names any more.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark import fixed

SCHEMAS = {
    "skeletons": "key STRING, text STRING, n_bytes BIGINT",
    "members": "path STRING, key STRING, pos BIGINT, entry_bytes BIGINT, units BIGINT, oversize BOOLEAN",
    "source_map": "path STRING, pos INT, symbol STRING, type STRING, original_start BIGINT, original_end BIGINT, file_size BIGINT",
}
PLACE = "snapshot_id STRING, attempt STRING"
META = f"{PLACE}, version STRING, ts TIMESTAMP, commit_sha STRING, project_root STRING, committed BIGINT"


@dataclass
class Snapshot:
    skeletons: DataFrame
    members: DataFrame
    source_map: DataFrame
    commit_sha: str | None = None
    snapshot_id: str | None = None


def _folder(root: str, table: str, snapshot_id: str, attempt: str) -> str:
    return f"{root}/{table}/snapshot_id={snapshot_id}/attempt={attempt}"


def write_snapshot(
    snapshot, root: str, snapshot_id: str, version: str = "1", commit_sha: str = "none", project_root: str = "", ts=None
) -> None:
    """Write the tables of a new attempt, then the meta row that makes it the snapshot of its id."""
    attempt = uuid.uuid4().hex
    for table, schema in SCHEMAS.items():
        df: DataFrame = getattr(snapshot, table)
        names = [f.split()[0] for f in schema.split(", ")]
        df.select(*names).write.parquet(_folder(root, table, snapshot_id, attempt))
    spark = snapshot.skeletons.sparkSession
    last = _attempts(spark, root).filter(F.col("snapshot_id") == snapshot_id).agg(F.max("committed")).first()[0]
    at = F.current_timestamp() if ts is None else F.lit(ts).cast("timestamp")
    meta = spark.range(1).select(
        F.lit(version).alias("version"), at.alias("ts"), F.lit(commit_sha).alias("commit_sha"),
        F.lit(project_root).alias("project_root"), F.lit(1 if last is None else last + 1).cast("bigint").alias("committed"),
    )
    meta.coalesce(1).write.parquet(_folder(root, "meta", snapshot_id, attempt))


def _attempts(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(META).parquet(f"{root}/meta")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], META)


def read_meta(spark: SparkSession, root: str) -> DataFrame:
    """One row per committed snapshot: its newest attempt."""
    rows = _attempts(spark, root)
    newest = rows.groupBy("snapshot_id").agg(F.max_by(F.struct(*rows.columns), F.struct("committed", "attempt")).alias("m"))
    return newest.select("m.*")


def drop_attempts(spark: SparkSession, root: str, snapshots: list[str] | None = None) -> int:
    """Delete the folders of attempts that are not a snapshot's newest; gives how many went.

    Their rows in ``meta`` go first, so no reader begins on them. ``snapshots`` are
    ids that go altogether. No writer may be at work.
    """
    keep = {(r["snapshot_id"], r["attempt"]) for r in read_meta(spark, root).select("snapshot_id", "attempt").collect()}  # one row per snapshot
    keep = {k for k in keep if k[0] not in (snapshots or ())}
    path, gone = spark._jvm.org.apache.hadoop.fs.Path, 0
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for table in ("meta", *SCHEMAS):
        for entry in fs.globStatus(path(f"{root}/{table}/snapshot_id=*/attempt=*")) or []:
            at = entry.getPath()
            name = (at.getParent().getName().removeprefix("snapshot_id="), at.getName().removeprefix("attempt="))
            if name not in keep:
                fs.delete(at, True)
                gone += table != "meta"
    return gone


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str | None = None) -> Snapshot:
    """The named or the latest committed snapshot; empty tables when there is none."""
    meta = read_meta(spark, root)
    if snapshot_id is not None:
        meta = meta.filter(F.col("snapshot_id") == snapshot_id)
    last = meta.agg(F.max_by(F.struct("snapshot_id", "attempt", "commit_sha"), F.struct("ts", "snapshot_id")).alias("m")).first()["m"]
    if last is None:
        return Snapshot(*[spark.createDataFrame([], s) for s in SCHEMAS.values()])
    tables = [spark.read.schema(s).parquet(_folder(root, t, last["snapshot_id"], last["attempt"])) for t, s in SCHEMAS.items()]
    return Snapshot(*tables, commit_sha=last["commit_sha"], snapshot_id=last["snapshot_id"])


def prune_snapshot(snapshot: Snapshot, listing: DataFrame, commit_sha: str, by_member: bool = False) -> Snapshot:
    """Keep what still has a file; another commit empties the snapshot.

    Buckets are always kept; with ``by_member`` a bucket goes when its last
    member went.
    """
    if snapshot.commit_sha != commit_sha:
        return Snapshot(
            snapshot.skeletons.filter("false"), snapshot.members.filter("false"), snapshot.source_map.filter("false"),
            commit_sha=snapshot.commit_sha, snapshot_id=snapshot.snapshot_id,
        )
    paths = listing.select("path").distinct()
    is_bucket = F.col("key").startswith(fixed.BUCKET_PREFIX)
    kept = snapshot.members.join(paths, "path", "left_semi")
    buckets = snapshot.skeletons.filter(is_bucket)
    if by_member:
        buckets = buckets.join(kept.select("key").distinct(), "key", "left_semi")
    own = snapshot.skeletons.filter(~is_bucket).join(paths.withColumnRenamed("path", "key"), "key", "left_semi")
    return Snapshot(
        own.unionByName(buckets), kept, snapshot.source_map.join(paths, "path", "left_semi"),
        commit_sha=snapshot.commit_sha, snapshot_id=snapshot.snapshot_id,
    )


def restore_size(skeletons: DataFrame, limit: int = fixed.RESTORE_LIMIT_BYTES) -> DataFrame:
    """One row: total bytes of the texts, and whether a session start may load them."""
    total = F.coalesce(F.sum("n_bytes"), F.lit(0))
    return skeletons.agg(total.alias("total_bytes"), (total <= limit).alias("allowed"))


def restore(skeletons: DataFrame, limit: int = fixed.RESTORE_LIMIT_BYTES) -> DataFrame:
    """The skeletons, or none when they are over the limit."""
    return skeletons.filter(F.lit(bool(restore_size(skeletons, limit).first()["allowed"])))
