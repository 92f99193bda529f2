"""Back from skeletons to sources, and prompts that need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed

FEW = 1_000  # paths that become a list


def edit_intent(prompt: Column) -> Column:
    return prompt.rlike(fixed.EDIT_VERBS)


def candidate_files(prompt: Column) -> Column:
    """Distinct path-like words in the order they are first seen."""
    return F.array_distinct(F.regexp_extract_all(prompt, F.lit(fixed.CANDIDATE_FILE), F.lit(0)))


def only_asked(files: DataFrame, paths: DataFrame, few: int = FEW) -> DataFrame:
    """The files of ``paths`` (path, distinct).

    Up to ``few`` paths become a list, so that the file listing, or the statistics
    of the files' table, leave the others unopened; more are a semi-join, which
    keeps their contents out of the shuffle where the paths are small enough to
    be broadcast.
    """
    names = [r["path"] for r in paths.limit(few + 1).collect()]
    if len(names) <= few:
        return files.filter(F.col("path").isin(*names)) if names else files.filter("false")
    return files.join(paths, "path", "left_semi")


def rehydrate_blocks(requests: DataFrame, source_map: DataFrame, files: DataFrame, few: int = FEW) -> DataFrame:
    """Add ``block`` to requests (path, symbol, ...): the bytes of the first block of that name.

    Null when there is no such block or file, or when the file's size has changed.
    ``files`` is (path, content or text, n_bytes); a ``sha2`` column on both
    sides is compared as well. Each requested block is cut once; the requests,
    which may all name one block, then join the cut blocks. Files in which no
    block is asked for are not opened where the list of those is short.
    """
    wanted = requests.select("path", "symbol").distinct()
    checks = [c for c in ("sha2",) if c in source_map.columns and c in files.columns]
    first = F.min(F.struct("pos", "original_start", "original_end", "file_size", *checks)).alias("m")
    spans = source_map.join(wanted, ["path", "symbol"], "left_semi").groupBy("path", "symbol").agg(first)
    files = only_asked(files, spans.select("path").distinct(), few)
    content = F.col("content") if "content" in files.columns else F.col("text").cast("binary")
    sources = files.select("path", content.alias("content"), "n_bytes", *checks)
    same = (F.col("m.file_size") == 0) | (F.col("n_bytes") == F.col("m.file_size"))
    for c in checks:
        same = same & (F.col(c) == F.col(f"m.{c}"))
    length = (F.col("m.original_end") - F.col("m.original_start")).cast("int")
    piece = F.substring("content", (F.col("m.original_start") + 1).cast("int"), length)
    blocks = spans.join(sources, "path").select(
        "path", "symbol", F.when(same, F.make_valid_utf8(piece.cast("string"))).alias("block")
    )
    return requests.join(blocks, ["path", "symbol"], "left")


def rehydrate_full(requests: DataFrame, files: DataFrame, few: int = FEW) -> DataFrame:
    """Add the whole ``text`` of each requested path; null when there is no file."""
    asked = only_asked(files, requests.select("path").filter("path is not null").distinct(), few)
    return requests.join(asked.select("path", "text"), "path", "left")


def is_skeletonized(paths: DataFrame, members: DataFrame) -> DataFrame:
    """Add whether a path is in the snapshot, alone or inside a bucket."""
    known = members.select("path").distinct().withColumn("_known", F.lit(True))
    return paths.join(known, "path", "left").withColumn("skeletonized", F.coalesce("_known", F.lit(False))).drop("_known")


def skeletonized_only(paths: DataFrame, members: DataFrame) -> DataFrame:
    return paths.join(members.select("path"), "path", "left_semi")


def match_intents(prompts: DataFrame, members: DataFrame) -> DataFrame:
    """Prompts (prompt_id, text) that ask for an edit: number of files named, and
    whether one of them is in the snapshot."""
    asked = prompts.filter(edit_intent(F.col("text"))).select(
        "prompt_id", F.explode_outer(candidate_files(F.col("text"))).alias("path")
    )
    flagged = is_skeletonized(asked, members)
    return flagged.groupBy("prompt_id").agg(
        F.count("path").alias("n_candidates"), F.max("skeletonized").alias("required")
    )
