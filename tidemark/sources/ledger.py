"""Tables written by the batches of a stream, made visible by one commit row per batch.

A batch writes its rows below ``<table>/batch_id=<id>`` and then its commit. What a
run that died has left lies above the last commit, so readers do not see it and
the repeated batch overwrites it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

COMMITS = "commits"


def read_all(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """All rows of a table with their ``batch_id``, commits aside; empty when nothing is written."""
    whole = f"{schema}, batch_id BIGINT"
    try:
        return spark.read.schema(whole).parquet(f"{root}/{table}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], whole)


def last_commit(spark: SparkSession, root: str, schema: str, table: str = COMMITS) -> Row | None:
    """The newest commit row, with its ``batch_id``."""
    rows = read_all(spark, root, table, schema)
    return rows.agg(F.max_by(F.struct(*rows.columns), "batch_id").alias("m")).first()["m"]


def write(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{table}/batch_id={batch_id}")


def commit(spark: SparkSession, root: str, batch_id: int, schema: str, *values, table: str = COMMITS) -> None:
    """Make the batch visible."""
    write(spark.createDataFrame([values], schema).coalesce(1), root, table, batch_id)


def committed(spark: SparkSession, root: str, table: str, schema: str, upto: int | None) -> DataFrame:
    """Rows of the batches up to the last commit ``upto``; none when there is none."""
    return read_all(spark, root, table, schema).filter(F.lit(False) if upto is None else F.col("batch_id") <= upto)


def forget(spark: SparkSession, root: str, table: str, before: int) -> None:
    """Delete a table's batches below ``before``, which nobody reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(folder) if fs.exists(folder) else []:
        name = entry.getPath().getName()
        if name.startswith("batch_id=") and int(name.removeprefix("batch_id=")) < before:
            fs.delete(entry.getPath(), True)
