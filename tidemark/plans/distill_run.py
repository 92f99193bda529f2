"""A distillation run: files to the tables of a snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B
from tidemark.functions import redact as R
from tidemark.operators import distill as D
from tidemark.operators import pack as P
from tidemark.session import stage


@dataclass
class Distilled:
    """``skeletons`` (key, text, n_bytes), ``members`` (path, key, pos, entry_bytes, units, oversize), ``source_map``, ``sizes``, ``rejects``.

    Of an oversize file the text is a summary; ``rejects`` are files outside the
    root, if one was given.
    """

    skeletons: DataFrame
    members: DataFrame
    source_map: DataFrame
    sizes: DataFrame
    rejects: DataFrame | None = None


def distill(
    files: DataFrame,
    kinds: D.Kinds = B.CODE_KINDS,
    limit: int = fixed.UNIT_LIMIT,
    counts: DataFrame | None = None,
    literal: D.Literal = R.CODE_TOKENS,
    small_bytes: int = fixed.SMALL_BYTES,
    shard: str = "",
    root: str | None = None,
) -> Distilled:
    """Large skeletons keep their own key; small ones are packed in path order.

    A file is cut once: skeletons are written with their byte counts and the spans of
    their blocks, which give the source map. Packing reads paths and counts
    only, and its result is written once too, so small texts are
    shuffled to their places and to their buckets and no further. ``shard``
    becomes part of the bucket keys. With ``root``, files outside it are rejected.
    """
    rejects = None
    if root is not None:
        files, rejects = D.inside_root(files, root)
    sk = D.cut(files, kinds, limit, counts, literal)
    sk = sk.select(
        "path", "ext", "n_bytes", "skeleton", "units", "oversize", "spans",
        B.size(F.col("skeleton")).alias("skeleton_bytes"),
        B.size(P.entry_text(F.col("path"), F.col("skeleton"))).alias("entry_bytes"),
    )
    sk = stage(sk, "skeletons")
    is_small = F.col("skeleton_bytes") < small_bytes
    small, large = sk.filter(is_small), sk.filter(~is_small)

    entries = small.select(F.lit(shard).alias("shard"), "path", "entry_bytes", "units", "oversize")
    numbered = P.with_positions(entries, "path")
    packed = P.pack_next_fit(numbered.select("shard", "ord", "entry_bytes")).join(
        numbered.select("shard", "ord", "path", "units", "oversize"), ["shard", "ord"]
    )
    packed = stage(packed.select("path", "shard", "bucket", "pos", "entry_bytes", "units", "oversize"), "packed")
    buckets = P.bucket_texts(packed.join(small.select("path", F.col("skeleton").alias("text")), "path"))

    key = P.bucket_key(F.col("shard"), F.col("bucket"))
    skeletons = large.select(
        F.col("path").alias("key"), B.align(F.col("skeleton")).alias("text"),
        B.aligned_size(F.col("skeleton_bytes")).alias("n_bytes"),
    ).unionByName(buckets.select(key.alias("key"), "text", "n_bytes"))
    members = large.select(
        "path", F.col("path").alias("key"), F.lit(0).cast("bigint").alias("pos"), "entry_bytes", "units", "oversize"
    ).unionByName(
        packed.select("path", key.alias("key"), "pos", "entry_bytes", "units", "oversize")
    )
    sizes = sk.select("path", "n_bytes", "skeleton_bytes", "units", "oversize")
    return Distilled(skeletons, members, D.span_rows(sk), sizes, rejects)
