"""Exact duplicates with a heavy-hitter split.

A Misra-Gries summary of the digests (``approx_top_k`` keeps counters of bounded
number, merged over all partitions) names candidates for frequent digests.
Their exact counts and winners are then aggregated with map-side combining, and
this table of at most ``CANDIDATES`` rows is broadcast: rows of frequent digests
are settled where they lie. All other digests go through one ordinary shuffle,
in which no group is large.

Only the digest, the id and a row number are written and shuffled; texts are
read once. Defined results: null text counts as empty; null ids are smallest;
of rows with the same id and text exactly one stays; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, lower_ascii, packed, row_key
from tidemark.session import stage

CANDIDATES = 1000  # rows of the broadcast table, about 150 bytes each
COUNTERS = 8192  # of the summary; digests above 1/COUNTERS of the rows are never missed


def text_digest(text: Column) -> Column:
    return F.sha2(lower_ascii(text), 256)


def group_copies(rows: DataFrame, candidates: int = CANDIDATES, counters: int = COUNTERS) -> DataFrame:
    """Groups of equal ``digest`` over (id, digest); the row with the largest id stays.

    Gives id, digest, keep_id, group_size, kept.
    """
    keyed = stage(rows.select("id", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    top = keyed.agg(F.expr(f"approx_top_k(digest, {candidates}, {counters})").alias("t"))
    names = top.select(F.explode("t.item").alias("digest"))
    best = F.max(F.struct("id", "row"))
    heavy = keyed.join(F.broadcast(names), "digest", "left_semi").groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    winners = stage(heavy.filter("group_size > 1"), "winners")
    split = keyed.join(F.broadcast(winners), "digest", "left")
    frequent = split.filter("best is not null")
    group = Window.partitionBy("digest")
    rest = (
        split.filter("best is null").drop("best", "group_size")
        .withColumns({"best": best.over(group), "group_size": F.count("*").over(group)})
    )
    both = frequent.unionByName(rest)
    return both.select(
        "id", "digest", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept")
    )


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest of the normalised text."""
    return group_copies(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")), **limits)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = find_duplicates(docs, id_col, text_col, **limits).filter("kept")
    keys = kept.select(row_key(F.col("id"), F.col("digest")).alias("_key"))
    wide = packed(docs, id_col, text_col).select(row_key(F.col(id_col), text_digest(F.col(text_col))).alias("_key"), ROW)
    once = Window.partitionBy("_key").orderBy("_key")
    out = wide.join(keys, "_key", "left_semi").withColumn("_nth", F.row_number().over(once)).filter("_nth = 1")
    return out.select(f"{ROW}.*")
