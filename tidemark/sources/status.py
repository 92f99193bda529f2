"""Table of the last status per session, in versions.

A version holds the sessions of one batch; every ``fold_every``-th one is a base
that holds all sessions. The row in ``versions`` is written last, so a version
is seen as a whole or not at all, and a repeated batch overwrites its own. A base
makes the versions before the last base superfluous; they are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark import fixed

FOLD_EVERY = 50


def _schema(kind: str) -> str:
    return f"session_id {kind}, t_us BIGINT, event_id BIGINT, status STRING"


def _latest(df: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("t_us", "event_id", "status"), F.struct("t_us", "event_id"))
    return df.groupBy("session_id").agg(last.alias("_l")).select("session_id", "_l.*")


def _versions(spark: SparkSession, root: str, before: int | None) -> list[int]:
    """The newest base and the versions after it; no more than ``fold_every`` numbers."""
    try:
        seen = spark.read.schema("version BIGINT, base BOOLEAN").parquet(f"{root}/versions")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    if before is not None:
        seen = seen.filter(F.col("version") < before)
    base = seen.agg(F.max(F.when(F.col("base"), F.col("version")))).first()[0]
    if base is not None:
        seen = seen.filter(F.col("version") >= base)
    return sorted(r["version"] for r in seen.select("version").collect())


def read_status(spark: SparkSession, root: str, before: int | None = None, kind: str = "BIGINT") -> DataFrame:
    """Last status of each session, over all versions or those below ``before``."""
    folders = [f"{root}/status/v{v}" for v in _versions(spark, root, before)]
    if not folders:
        return spark.createDataFrame([], _schema(kind))
    return _latest(spark.read.schema(_schema(kind)).parquet(*folders))


def write_status(rows: DataFrame, root: str, version: int, fold_every: int = FOLD_EVERY) -> None:
    """Merge status rows (session_id, t_us, event_id, status) into the table as ``version``."""
    spark = rows.sparkSession
    kind = rows.schema["session_id"].dataType.simpleString()
    rows = rows.select("session_id", "t_us", "event_id", "status")
    base, before = version % fold_every == 0, []
    if base:
        before = _versions(spark, root, version)
        rows = rows.unionByName(read_status(spark, root, before=version, kind=kind))
    _latest(rows).write.mode("overwrite").parquet(f"{root}/status/v{version}")
    done = spark.range(1).select(F.lit(base).alias("base")).coalesce(1)
    done.write.mode("overwrite").parquet(f"{root}/versions/version={version}")
    if before:
        _forget(spark, root, before[0])


def _forget(spark: SparkSession, root: str, before: int) -> None:
    """Delete the versions below ``before``; their rows in ``versions`` first."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder, name in ((f"{root}/versions", "version="), (f"{root}/status", "v")):
        for entry in fs.listStatus(path(folder)):
            at = entry.getPath()
            number = at.getName().removeprefix(name)
            if number.isdigit() and int(number) < before:
                fs.delete(at, True)


def start_sessions(sessions: DataFrame) -> DataFrame:
    """Status rows of sessions (session_id, t_us) that begin."""
    return sessions.select("session_id", "t_us", F.lit(-1).cast("bigint").alias("event_id"), F.lit(fixed.STATUS_START).alias("status"))


def status_of(sessions: DataFrame, status: DataFrame) -> DataFrame:
    """Status text of sessions; unknown ones have a text of their own."""
    known = status.select("session_id", "status")
    return sessions.join(known, "session_id", "left").withColumn(
        "status", F.coalesce("status", F.lit(fixed.STATUS_UNKNOWN))
    )


def last_overall(status: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("session_id", "t_us", "event_id", "status"), F.struct("t_us", "event_id"))
    return status.agg(last.alias("_l")).select("_l.*")
