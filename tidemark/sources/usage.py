"""Usage payloads: one JSON text per line.

A line may name its session, event and time beside the payload's own fields.
Without a session it belongs to the unnamed one; without an event it is named by
a hash of the line; without a time it has that of its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.usage import normalize_usage

LINE = "value STRING"
ENVELOPE = "session_id STRING, event_id BIGINT, t_us BIGINT"


def _keyed(raw: DataFrame) -> DataFrame:
    """Add session_id, event_id and t_us to lines."""
    e = F.from_json("value", ENVELOPE)
    df = raw.select("value", e.alias("_e"), F.unix_micros("_metadata.file_modification_time").alias("_file_us"))
    return df.select(
        "value", F.col("_e.session_id").alias("session_id"), F.coalesce("_e.event_id", F.xxhash64("value")).alias("event_id"),
        F.coalesce("_e.t_us", "_file_us").alias("t_us"),
    )


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Normalised payloads of text files with their keys; blank and unknown lines are dropped."""
    return normalize_usage(_keyed(spark.read.schema(LINE).text(path)), "value")


def stream_usage(spark: SparkSession, path: str, per_trigger: int = 1_000) -> DataFrame:
    """The same as a stream of new files; with ``with_limit`` it feeds the monitor."""
    raw = spark.readStream.schema(LINE).option("maxFilesPerTrigger", per_trigger).text(path)
    return normalize_usage(_keyed(raw), "value")
