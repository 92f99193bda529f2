"""Files to skeletons and source maps.

A file is a row (path, ext, text, n_bytes). All text work stays in the row: no
shuffle carries text, but for the join with lookup counts when one is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B
from tidemark.functions import redact as R
from tidemark.session import small_batches

Kinds = dict[str, B.BlockKind]
Literal = str | dict[str, str]


def redacted(text: Column, ext: Column, literal: Literal) -> Column:
    return R.redact(text, pattern=literal) if isinstance(literal, str) else R.redact_code(text, ext, literal)


def resolved(path: Column) -> Column:
    """A path without ``.``, ``..`` and doubled slashes; above the top ``..`` stays at it, and a relative path keeps it."""
    absolute = path.startswith("/")

    def step(parts: Column, part: Column) -> Column:
        top = F.try_element_at(parts, F.lit(-1))
        up = (part == "..") & (F.size(parts) > 0) & (top != "..")
        nothing = part.isin("", ".") | (part == "..") & absolute & (F.size(parts) == 0)
        return F.when(nothing, parts).when(up, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array_append(parts, part))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def inside_root(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Files below ``root`` and the rejected rest, by their resolved paths; a path that is null is rejected."""
    top = resolved(F.lit(root))
    path = resolved(F.col("path"))
    inside = F.coalesce((path == top) | path.startswith(F.concat(F.rtrim(top, F.lit("/")), F.lit("/"))), F.lit(False))
    return files.filter(inside), files.filter(~inside)


def with_units(files: DataFrame, kinds: Kinds, limit: int = fixed.UNIT_LIMIT) -> DataFrame:
    """Add the unit count of a file and whether it is over the limit."""
    units = B.by_kind(kinds, F.col("ext"), lambda k: B.count_units(F.col("text"), k))
    return files.withColumn("units", units).withColumn("oversize", F.coalesce(F.col("units") > limit, F.lit(False)))


def _pieces(kinds: Kinds, text: Column) -> Column:
    # the scanner gets no text of other kinds or over the limit
    def cut(kind: B.BlockKind) -> Column:
        exts = [e for e, k in kinds.items() if k == kind]
        return B.cut_blocks(F.when(~F.col("oversize") & F.col("ext").isin(*exts), text), kind)

    return F.coalesce(*[cut(k) for k in dict.fromkeys(kinds.values())])


def source_map(files: DataFrame, kinds: Kinds = B.CODE_KINDS, limit: int = fixed.UNIT_LIMIT) -> DataFrame:
    """One row per elided block of the original text; none for oversize or other files."""
    small_batches(files.sparkSession)
    df = with_units(files, kinds, limit)
    return span_rows(df.select("path", "n_bytes", B.spans(_pieces(kinds, F.col("text"))).alias("spans")))


def span_rows(cut_files: DataFrame) -> DataFrame:
    """One row per span of (path, n_bytes, spans)."""
    df = cut_files.select("path", F.col("n_bytes").alias("file_size"), F.posexplode("spans").alias("pos", "_span"))
    return df.select("path", "pos", "_span.*", "file_size")


def block_texts(files: DataFrame, kinds: Kinds = B.CODE_KINDS, limit: int = fixed.UNIT_LIMIT) -> DataFrame:
    """One row per block with its body."""
    small_batches(files.sparkSession)
    df = with_units(files, kinds, limit)
    df = df.select("path", "ext", _pieces(kinds, F.col("text")).alias("_pieces"))
    df = df.select("path", "ext", F.posexplode(F.filter("_pieces", lambda p: p["body"].isNotNull())).alias("pos", "_p"))
    return df.select("path", "ext", "pos", "_p.symbol", "_p.type", "_p.body")


def lookup_counts(lookups: DataFrame, keys: tuple[str, ...] = ("path", "symbol")) -> DataFrame:
    return lookups.groupBy(*keys).agg(F.count("*").alias("n_lookups"))


def hot_symbols(lookups: DataFrame, keys: tuple[str, ...], threshold: int = fixed.HOT_LOOKUPS) -> DataFrame:
    """Keys looked up at least ``threshold`` times."""
    return lookup_counts(lookups, keys).filter(F.col("n_lookups") >= threshold)


def block_replacements(
    blocks: DataFrame, counts: DataFrame, hot: int = fixed.HOT_LOOKUPS, literal: Literal = R.LITERAL
) -> DataFrame:
    """What stands in for each block: first lines of a hot one, else the placeholder with its hint."""
    df = blocks.join(counts, ["path", "symbol"], "left").withColumn("n_lookups", F.coalesce("n_lookups", F.lit(0)))
    kept = B.first_lines(redacted(F.col("body"), F.col("ext"), literal))
    plain = F.concat(B.placeholder(F.col("ext")), B.hint(F.col("n_lookups"), hot))
    return df.withColumn("hot", F.col("n_lookups") >= hot).withColumn(
        "replacement", F.when(F.col("hot"), kept).otherwise(plain)
    )


def cut(
    files: DataFrame,
    kinds: Kinds = B.CODE_KINDS,
    limit: int = fixed.UNIT_LIMIT,
    counts: DataFrame | None = None,
    literal: Literal = R.CODE_TOKENS,
    hot: int = fixed.HOT_LOOKUPS,
) -> DataFrame:
    """Elide and redact: (path, ext, n_bytes, skeleton, units, oversize, spans).

    A text is cut once. ``spans`` are its blocks' places in the original, and the
    skeleton is made of the same pieces, so both hold the same blocks; what is kept
    of a piece is redacted by itself, what is elided need not be. ``literal`` is
    the tokens of each extension, or one pattern of literals for all files. Files of
    other extensions pass through redacted. ``counts`` are lookups per (path,
    symbol); they reach a file as one map.
    """
    small_batches(files.sparkSession)
    df = with_units(files, kinds, limit)
    if counts is not None:
        maps = (
            counts.join(files.select("path"), "path", "left_semi")
            .groupBy("path")
            .agg(F.map_from_entries(F.collect_list(F.struct("symbol", "n_lookups"))).alias("_counts"))
        )
        df = df.join(maps, "path", "left")
    df = df.withColumn("_pieces", _pieces(kinds, F.col("text")))
    safe = lambda text: redacted(text, F.col("ext"), literal)

    def replacement(p: Column) -> Column:
        plain = B.placeholder(F.col("ext"))
        if counts is None:
            return plain
        n = F.coalesce(F.try_element_at(F.col("_counts"), p["symbol"]), F.lit(0))
        return F.when(n >= hot, B.first_lines(safe(p["body"]))).otherwise(F.concat(plain, B.hint(n, hot)))

    text = (
        F.when(F.col("oversize"), B.oversize_summary(F.col("path"), F.col("units"), F.col("n_bytes"), limit))
        .when(F.col("_pieces").isNotNull(), B.rebuild(F.col("_pieces"), replacement, safe))
        .otherwise(safe(F.col("text")))
    )
    return df.select("path", "ext", "n_bytes", text.alias("skeleton"), "units", "oversize", B.spans(F.col("_pieces")).alias("spans"))


def skeletons(files: DataFrame, *args, **options) -> DataFrame:
    """(path, ext, n_bytes, skeleton, units, oversize) of ``cut``."""
    return cut(files, *args, **options).drop("spans")


def split_small(skeletons: DataFrame, limit: int = fixed.SMALL_BYTES) -> tuple[DataFrame, DataFrame]:
    """Skeletons below ``limit`` bytes, and the others."""
    small = F.octet_length("skeleton") < limit
    return skeletons.filter(small), skeletons.filter(~small)
