"""Handoff document of a session: six named layers in a fixed order.

Every layer has a byte or row budget that is applied before its rows are
gathered, so a document stays small however long its session was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B

ROW = ("session_id", "layer", "ord", "text")
CHUNK_ROWS, MERGED = 1_000_000, 16  # rows of a session in a window, parts merged at once


def last_turns(turns: DataFrame, key: str = "conv_id", n: int = fixed.RECENT_TURNS) -> DataFrame:
    """The last ``n`` turns of each conversation; the rank limit applies before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn")))
    return turns.withColumn("rank", rank).filter(F.col("rank") <= n)


def within_budget(rows: DataFrame, key: str, order: list, bytes_column: str, budget: int, chunk: int = CHUNK_ROWS) -> DataFrame:
    """The first rows of each key whose bytes sum up to at most ``budget``, with their ``rank``.

    Rows of a key are dealt to parts of about ``chunk`` rows. A part keeps its rows
    up to the first that is over the budget by itself: what comes after is over it
    in the whole order too, and the row that is kept says so to the next round,
    in which parts are merged. So no window sees more of a key than a part, or
    what a few parts have kept. Rows without bytes are gathered with their part.
    """
    largest = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-largest // chunk)
    out = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, parts))))
    while True:
        w = Window.partitionBy(key, "_part").orderBy(*order)
        upto = F.sum(bytes_column).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        if parts <= 1:
            out = out.withColumns({"_total": upto, "rank": F.row_number().over(w)})
            return out.filter(F.col("_total") <= budget).drop("_total", "_part")
        out = out.withColumn("_total", upto).filter(F.col("_total") - F.col(bytes_column) <= budget).drop("_total")
        parts = -(-parts // MERGED)
        out = out.withColumn("_part", F.col("_part") % parts)


def manifest_layer(touched: DataFrame, budget: int = fixed.MANIFEST_BYTES, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Layer 3: paths (session_id, path) in path order, one line each."""
    lines = touched.select("session_id", "path").distinct().withColumn("_n", F.octet_length("path") + 1)
    kept = within_budget(lines, "session_id", ["path"], "_n", budget, chunk)
    return kept.select("session_id", F.lit(3).alias("layer"), F.col("rank").alias("ord"), F.col("path").alias("text"))


def checkpoint_layer(
    touched: DataFrame, skeletons: DataFrame, limit: int = fixed.RESTORE_LIMIT_BYTES, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Layer 4: skeletons (path, skeleton) of the touched paths in path order, as many as fit the limit.

    Where some did not fit, a last line says how many.
    """
    n = skeletons.select("path", B.size(F.col("skeleton")).alias("_n"))
    rows = touched.select("session_id", "path").distinct().join(n, "path")
    fit = within_budget(rows, "session_id", ["path"], "_n", limit, chunk).drop("rank")
    kept = fit.join(skeletons.select("path", "skeleton"), "path")
    all_of, some = (df.groupBy("session_id").agg(F.count("*").alias(name)) for df, name in ((rows, "_all"), (fit, "_fit")))
    cut = all_of.join(some, "session_id", "left").withColumn("_left", F.col("_all") - F.coalesce("_fit", F.lit(0))).filter("_left > 0")
    mark = F.concat(F.lit("... "), F.col("_left").cast("string"), F.lit(" more"))
    # texts of a session are ordered by path when the document is put together
    texts = kept.select("session_id", F.lit(4).alias("layer"), F.lit(0).alias("ord"), F.col("skeleton").alias("text"), "path")
    return texts.unionByName(cut.select("session_id", F.lit(4).alias("layer"), F.lit(1).alias("ord"), mark.alias("text"), F.lit("").alias("path")))


def active_source_layer(touched: DataFrame, files: DataFrame, budget: int, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Layer 5: touched files (session_id, path, turn), latest first, each padded to whole blocks."""
    latest = touched.groupBy("session_id", "path").agg(F.max("turn").alias("turn"))
    sizes = files.select("path", B.aligned_size(F.col("n_bytes")).alias("_n"))
    rows = latest.join(sizes, "path")
    kept = within_budget(rows, "session_id", [F.desc("turn"), F.asc("path")], "_n", budget, chunk)
    full = kept.join(files.select("path", "text"), "path")
    return full.select("session_id", F.lit(5).alias("layer"), F.col("rank").alias("ord"), B.align(F.col("text")).alias("text"))


def recent_layer(turns: DataFrame, key: str = "conv_id", n: int = fixed.RECENT_TURNS) -> DataFrame:
    """Layer 6: the last turns, oldest first."""
    kept = last_turns(turns, key, n)
    return kept.select(
        F.col(key).alias("session_id"), F.lit(6).alias("layer"), (F.lit(n) - F.col("rank")).alias("ord"),
        F.concat_ws(": ", "role", "text").alias("text"),
    )


def handoff(layers: list[DataFrame], constant: dict[int, str]) -> DataFrame:
    """One document per session; ``constant`` holds the layers that are the same for all.

    All six headings are always there, so that documents share their beginning.
    """
    rows = None
    for df in layers:
        path = F.col("path") if "path" in df.columns else F.lit("")
        part = df.select("session_id", "layer", F.struct("ord", path.alias("path"), "text").alias("row"))
        rows = part if rows is None else rows.unionByName(part)
    got = rows.groupBy("session_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("layer") == n, F.col("row")))).alias(f"l{n}") for n in fixed.LAYERS]
    )
    parts = []
    for n, name in fixed.LAYERS.items():
        body = F.lit(constant[n]) if n in constant else F.array_join(f"l{n}.text", "\n")
        parts.append(F.concat(F.lit(f"[{name}]\n"), body))
    return got.select("session_id", F.concat_ws("\n\n", *parts).alias("document"))
