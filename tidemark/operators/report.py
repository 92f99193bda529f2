"""Size report: per file, totals, greatest savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B


def file_sizes(skeletons: DataFrame) -> DataFrame:
    """Original, distilled (aligned) and saved bytes of each file that is not empty.

    ``skeletons`` is (path, n_bytes, skeleton_bytes).
    """
    aligned = B.aligned_size(F.col("skeleton_bytes"))
    return skeletons.filter("n_bytes > 0").select(
        "path", F.col("n_bytes").alias("original"), aligned.alias("distilled"),
        (F.col("n_bytes") - aligned).alias("saving"),
    )


def size_totals(sizes: DataFrame) -> DataFrame:
    pct = "case when original > 0 then cast(saving as double) / cast(original as double) * 100 else 0.0D end"
    return sizes.agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("original"), F.lit(0)).alias("original"),
        F.coalesce(F.sum("distilled"), F.lit(0)).alias("distilled"),
        F.coalesce(F.sum("saving"), F.lit(0)).alias("saving"),
    ).withColumn("saving_pct", F.expr(pct))


def top_savings(sizes: DataFrame, n: int = fixed.TOP_FILES) -> DataFrame:
    """The files that save most; ties in path order."""
    pct = "cast(saving as double) / cast(original as double) * 100"
    return sizes.orderBy(F.desc("saving"), "path").limit(n).withColumn("saving_pct", F.expr(pct))


def compression_ratio(sizes: DataFrame) -> DataFrame:
    ratio = "case when n_bytes = 0 then 1.0D else cast(distilled as double) / cast(n_bytes as double) end"
    return sizes.withColumn("distilled", B.aligned_size(F.col("skeleton_bytes"))).select(
        "path", "n_bytes", "distilled", F.expr(ratio).alias("ratio")
    )
