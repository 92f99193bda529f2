"""Shards of near-equal bytes by sampled splitters.

1. A size-weighted sample of keys is drawn (a record is taken with a chance in
   proportion to its bytes), and its weighted quantiles become the boundaries of
   ``RANGES`` ranges of the key, the hash of the text.
2. Records are dealt to ranges. Ranges over twice the mean are subdivided by
   splitters sampled inside them over (hash, id), so a text that is copied into
   a third of all rows is spread over many ranges.
3. Positions inside ranges come from windows, those of ranges from one row per
   range. A record's byte position then decides its shard, so the shards'
   sizes differ by a record or a small group at most, and shards are
   consecutive in the order, which gives slots without a window per shard.

Equal texts stay together in one shard while their bytes are at most
``WHOLE_SHARE`` of a shard's share; larger groups are cut between records.

Defined results: null text has no bytes, so size 1; null ids sort first; equal
rows get slots of their own; an empty table gives an empty result; columns named
like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, packed, replace_columns, row_key, uniform
from tidemark.session import stage

SHARDS = 16
RANGES = 1024
PER_RANGE = 16  # expected samples of a range
OVERFULL = 2.0
WHOLE_SHARE = 0.02
STEP = 32  # boundaries are searched in two steps of about this many


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"),
    )


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Weighted quantiles of a sample of about ranges * PER_RANGE keys."""
    unit = max(total / (ranges * PER_RANGE), 1.0)
    sample = rows.filter(uniform(F.col("id"), F.col("h"), F.lit("splitter")) < F.col("size") / F.lit(unit)).select(
        "h", F.greatest(F.col("size").cast("double"), F.lit(unit)).alias("w")
    )
    upto = Window.orderBy("h", "w").rowsBetween(Window.unboundedPreceding, 0)  # over the bounded sample
    ranked = sample.withColumn("q", F.floor(F.sum("w").over(upto) * ranges / F.sum("w").over(Window.partitionBy())))
    cuts = ranked.groupBy("q").agg(F.max("h").alias("h")).filter(f"q < {ranges - 1}").orderBy("q").collect()
    return sorted({r["h"] for r in cuts})


def _with_range(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """Range of a key: the number of boundaries below it."""
    if not cuts:
        return rows.withColumn("range", F.lit(0))
    blocks = [cuts[i:i + STEP] for i in range(0, len(cuts), STEP)]
    coarse, fine = F.lit([b[-1] for b in blocks[:-1]]) if len(blocks) > 1 else F.lit([]).cast("array<bigint>"), F.lit(blocks)
    rows = rows.withColumn("_c", F.size(F.filter(coarse, lambda b: b < F.col("h"))))
    inner = F.size(F.filter(F.element_at(fine, F.col("_c") + 1), lambda b: b < F.col("h")))
    return rows.withColumn("range", F.col("_c") * STEP + inner).drop("_c")


def _with_pieces(rows: DataFrame, total: int, n_ranges: int) -> DataFrame:
    """Subdivide the ranges that hold over OVERFULL times the mean."""
    mean = max(total / n_ranges, 1.0)
    full = rows.groupBy("range").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > OVERFULL * mean)
    full = F.broadcast(stage(full.withColumn("parts", F.ceil(F.col("bytes") / mean).cast("int")), "overfull"))  # a row per range at most
    unit = F.col("bytes") / (F.col("parts") * PER_RANGE)
    sample = rows.join(full, "range").filter(uniform(F.col("id"), F.col("h"), F.lit("piece")) < F.col("size") / unit)
    sample = sample.withColumn("w", F.greatest(F.col("size").cast("double"), unit)).withColumn("key", F.struct("h", "id"))
    own = Window.partitionBy("range")
    upto = own.orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sample.withColumn("q", F.floor(F.sum("w").over(upto) * F.col("parts") / F.sum("w").over(own)))
    cuts = ranked.filter("q < parts - 1").groupBy("range", "q").agg(F.max("key").alias("key"))
    cuts = stage(cuts.groupBy("range").agg(F.array_sort(F.collect_set("key")).alias("cuts")), "pieces")  # 2 * RANGES keys in all
    rows = rows.join(F.broadcast(cuts), "range", "left")
    piece = F.size(F.filter("cuts", lambda b: b < F.struct("h", "id")))
    return rows.withColumn("piece", F.when(F.col("cuts").isNull(), 0).otherwise(piece)).drop("cuts")


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES
) -> DataFrame:
    """One row per document: id, size, crc, h, shard, slot (gapless from 0 in each shard)."""
    rows = stage(_narrow(docs, id_col, text_col), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    cuts = _splitters(rows, total, ranges)
    rows = _with_pieces(_with_range(rows, cuts), total, ranges)
    own = Window.partitionBy("range", "piece")
    order = own.orderBy("h", "id")
    rows = rows.withColumns({
        "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "nth": F.row_number().over(order),
        "g_upto": F.sum("size").over(own.orderBy("h").rangeBetween(Window.unboundedPreceding, 0)),
        "g_size": F.sum("size").over(Window.partitionBy("range", "piece", "h")),
    })
    rows = stage(rows, "positions")
    parts = rows.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per range, 3 * RANGES at most
    parts = parts.select(
        "range", "piece", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b_bytes"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b_n")
    )
    whole = F.col("g_size") <= WHOLE_SHARE * total / shards
    middle = 2 * F.col("b_bytes") + F.when(whole, 2 * F.col("g_upto") - F.col("g_size")).otherwise(2 * F.col("upto") - F.col("size"))
    placed = rows.join(F.broadcast(parts), ["range", "piece"]).withColumn("_m", middle * shards).select(
        "id", "size", "crc", "h", F.expr(f"cast(least(_m div {max(2 * total, 1)}, {shards - 1}) as int)").alias("shard"),
        (F.col("nth") - 1 + F.col("b_n")).alias("at"),
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("id", "size", "crc", "h", "shard", (F.col("at") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, ``shard`` and ``slot``."""
    nth = Window.partitionBy("_key").orderBy("_key")

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("_nth", F.row_number().over(nth)).withColumn("_row", F.concat_ws("#", "_key", "_nth")).drop("_key", "_nth")

    got = assign_shards(docs, shards, id_col, text_col)
    got = numbered(got.select(row_key(F.col("id"), F.col("h")).alias("_key"), "shard", "slot"))
    wide = packed(replace_columns(docs, "shard", "slot"), id_col, text_col)
    wide = wide.select(row_key(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("_key"), ROW)
    return numbered(wide).join(got, "_row").select(f"{ROW}.*", "shard", "slot")
