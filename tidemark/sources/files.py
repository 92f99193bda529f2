"""Source files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B

SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _options(exts: tuple[str, ...]) -> dict[str, str]:
    return {"recursiveFileLookup": "true", "pathGlobFilter": "*.{" + ",".join(exts) + "}"}


def qualified(spark: SparkSession, root: str) -> str:
    """The root as the file source writes it: absolute, with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


SKIPPED = "/(" + "|".join(x.replace(".", r"\.") for x in fixed.SKIPPED_FOLDERS) + ")/"


def _below(raw: DataFrame, root: str) -> Column:
    """The file's path below the root, from its metadata: conditions on it are answered by the listing, others are not opened."""
    base = raw.sparkSession._jvm.org.apache.hadoop.fs.Path(qualified(raw.sparkSession, root)).toUri().getRawPath().rstrip("/")
    path = F.regexp_replace("_metadata.file_path", "^[^:/]+:(//[^/]*)?", "")  # encoded as the base is
    below = F.when(F.startswith(path, F.lit(base + "/")), F.substring(path, len(base) + 2, 1 << 30)).otherwise(path)
    return F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))


def file_rows(raw: DataFrame, root: str) -> DataFrame:
    """(path below root, ext, text, n_bytes, content) of listed files outside the skipped folders.

    Bytes that are no UTF-8 become replacement characters.
    """
    path = _below(raw, root)
    rows = raw.filter(~F.concat(F.lit("/"), path).rlike(SKIPPED)).select(path.alias("path"), F.col("length").alias("n_bytes"), "content")
    return rows.select(
        "path", B.extension(F.col("path")).alias("ext"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "n_bytes", "content"
    )


def scan_files(spark: SparkSession, root: str, exts: tuple[str, ...] = fixed.SOURCE_EXTENSIONS) -> DataFrame:
    """All files of the given extensions below a folder; contents are read only if used.

    Files without bytes are not listed by Spark's file sources.
    """
    raw = spark.read.format("binaryFile").options(**_options(exts)).load(root)
    return file_rows(raw, root)


def stream_files(spark: SparkSession, root: str, exts: tuple[str, ...] = fixed.SOURCE_EXTENSIONS, per_trigger: int = 10_000) -> DataFrame:
    """New files as a stream."""
    raw = (
        spark.readStream.format("binaryFile").schema(SCHEMA).options(**_options(exts))
        .option("maxFilesPerTrigger", per_trigger).load(root)
    )
    return file_rows(raw, root)
