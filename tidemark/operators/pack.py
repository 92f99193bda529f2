"""Next-fit packing of small texts into blocks, exact and in parallel.

Next-fit walks a shard in order and opens a new bucket when the next entry does
not fit, so the bucket of an entry depends on all entries before it. The shard is
cut into chunks of consecutive entries, and the walk is split in three:

1. Per chunk, for every fill the open bucket may have on arrival: how many
   buckets the chunk opens and what it leaves open. Only the few entries that can
   be the first not to fit matter, since all walks from there on are fixed.
2. Per shard, one pass over these few rows per chunk gives each chunk its true
   start.
3. Per chunk, the buckets of its entries from that start.

The result is the sequential one whatever the chunk size, and a shard that holds
most of the rows is spread over its chunks. Only positions and byte counts go to
Python; texts are joined back afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B
from tidemark.session import cut_lineage

CHUNK_ROWS = 1_000_000
FULL = 2**62  # fill of the bucket before the first: nothing fits, so bucket 0 opens


def entry_text(path: Column, text: Column) -> Column:
    """A file between its marks, fenced by its language."""
    (a, b), (c, d) = fixed.ENTRY_START, fixed.ENTRY_END
    return F.concat(
        F.lit(a), path, F.lit(b), B.extension(path), F.lit("\n"), text, F.lit(c), path, F.lit(d)
    )


def with_positions(df: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """Number rows by a total order that is not numeric.

    The numbers ascend without being dense. They depend on sampled ranges, so the
    rows are written to the shared folder before anything is derived from them.
    """
    return cut_lineage(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))


class _Walk:
    """Consecutive entries of a shard."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.n, self.capacity = len(sizes), capacity
        self.upto = np.cumsum(sizes)
        self.before = self.upto - sizes
        first_misfit = np.searchsorted(self.upto, self.before + capacity, side="right")
        self.next = np.maximum(first_misfit, np.arange(self.n) + 1)

    def first_break(self, fill: int) -> int:
        """The first entry that does not fit on top of ``fill``."""
        if fill > self.capacity:
            return 0
        return int(np.searchsorted(self.upto, self.capacity - fill, side="right"))

    def starts(self, at: int) -> list[int]:
        """First entries of all buckets opened from entry ``at`` on."""
        out, nxt = [], self.next
        while at < self.n:
            out.append(at)
            at = int(nxt[at])
        return out


def _summaries(capacity: int):
    def fn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        walk = _Walk(pdf.sort_values("ord")["entry_bytes"].to_numpy(np.int64), capacity)
        known: dict[int, tuple[int, int]] = {}  # entry -> (buckets opened from it on, last of them)
        rows, hi = [], FULL
        for at in range(walk.n):
            if hi < 0:
                break
            lo = capacity - int(walk.upto[at])
            path, i = [], at
            while i < walk.n and i not in known:
                path.append(i)
                i = int(walk.next[i])
            opened, last = known[i] if i < walk.n else (0, -1)
            for i in reversed(path):
                opened, last = opened + 1, (i if last < 0 else last)
                known[i] = (opened, last)
            opened, last = known[at]
            rows.append((lo, hi, opened, int(walk.upto[-1] - walk.before[last]), walk.n - last))
            hi = lo
        if hi >= 0:  # everything fits on top
            rows.append((-1, hi, 0, int(walk.upto[-1]), walk.n))
        out = pd.DataFrame(rows, columns=["lo", "hi", "opened", "fill", "members"])
        out.insert(0, "shard", key[0])
        out.insert(1, "chunk", key[1])
        return out

    return fn


def _starts(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    fill, bucket, members, out = FULL, -1, 0, []
    pdf = pdf.sort_values(["chunk", "hi"], ascending=[True, False])
    chunks = pdf["chunk"].to_numpy()
    edges = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
    lo, opened = pdf["lo"].to_numpy(), pdf["opened"].to_numpy()
    fills, counts = pdf["fill"].to_numpy(), pdf["members"].to_numpy()
    for e, end in zip(edges, np.r_[edges[1:], len(pdf)]):
        out.append((chunks[e], fill, bucket, members))
        i = e
        while i + 1 < end and fill <= lo[i]:
            i += 1
        if opened[i]:
            fill, bucket, members = int(fills[i]), bucket + int(opened[i]), int(counts[i])
        else:
            fill, members = fill + int(fills[i]), members + int(counts[i])
    res = pd.DataFrame(out, columns=["chunk", "fill", "bucket", "members"])
    res.insert(0, "shard", key[0])
    return res


def _assign(capacity: int):
    def fn(entries: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values("ord")
        walk = _Walk(entries["entry_bytes"].to_numpy(np.int64), capacity)
        fill, bucket, members = (int(start[c].iloc[0]) for c in ("fill", "bucket", "members"))
        opens = np.array(walk.starts(walk.first_break(fill)), dtype=np.int64)
        is_open = np.zeros(walk.n, dtype=np.int64)
        is_open[opens] = 1
        nth = np.cumsum(is_open)
        first = np.r_[-members, opens][nth]
        return pd.DataFrame({
            "shard": entries["shard"].to_numpy(), "ord": entries["ord"].to_numpy(),
            "bucket": bucket + nth, "pos": np.arange(walk.n) - first,
            "entry_bytes": entries["entry_bytes"].to_numpy(),
        })

    return fn


def pack_next_fit(
    entries: DataFrame,
    block: int = fixed.BLOCK_BYTES,
    slack: int = fixed.SLACK_BYTES,
    reserve: int = fixed.MANIFEST_RESERVE,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Buckets of entries (shard, ord, entry_bytes), ``ord`` unique in a shard.

    Gives (shard, ord, bucket, pos, entry_bytes). An entry over the capacity has a
    bucket of its own.
    """
    capacity = block - slack - reserve
    kind = entries.schema["shard"].dataType.simpleString()
    df = entries.select(
        "shard", F.expr(f"ord div {chunk_rows}").alias("chunk"), F.col("ord").cast("bigint").alias("ord"),
        F.col("entry_bytes").cast("bigint").alias("entry_bytes"),
    )
    sums = df.groupBy("shard", "chunk").applyInPandas(
        _summaries(capacity),
        f"shard {kind}, chunk bigint, lo bigint, hi bigint, opened bigint, fill bigint, members bigint",
    )
    starts = sums.groupBy("shard").applyInPandas(
        _starts, f"shard {kind}, chunk bigint, fill bigint, bucket bigint, members bigint"
    )
    return (
        df.groupBy("shard", "chunk")
        .cogroup(starts.groupBy("shard", "chunk"))
        .applyInPandas(_assign(capacity), f"shard {kind}, ord bigint, bucket bigint, pos bigint, entry_bytes bigint")
    )


def build_buckets(members: DataFrame, texts: DataFrame, block: int = fixed.BLOCK_BYTES, slack: int = fixed.SLACK_BYTES) -> DataFrame:
    """Bucket texts: manifest of members, entries in order, footer, padding.

    ``texts`` is (shard, ord, path, text). A bucket holds one block of bytes, or
    one oversize entry.
    """
    return bucket_texts(members.select("shard", "ord", "bucket", "pos").join(texts, ["shard", "ord"]), block, slack)


def bucket_texts(rows: DataFrame, block: int = fixed.BLOCK_BYTES, slack: int = fixed.SLACK_BYTES) -> DataFrame:
    """Bucket texts of placed entries (shard, bucket, pos, path, text)."""
    df = rows.select("shard", "bucket", F.struct("pos", "path", entry_text(F.col("path"), F.col("text")).alias("entry")).alias("m"))
    got = df.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list("m")).alias("m"))
    (a, b), end = fixed.MANIFEST_START, fixed.MANIFEST_END
    body = F.concat(F.lit(a), F.array_join("m.path", ", "), F.lit(b), F.array_join("m.entry", ""), F.lit(end))
    out = got.select("shard", "bucket", F.size("m").cast("bigint").alias("n_members"), B.align(body, block, slack).alias("text"))
    n = B.size(F.col("text"))
    return out.withColumn("n_bytes", n).withColumn("n_blocks", F.expr(f"n_bytes div {block}"))


def bucket_key(shard: Column, bucket: Column) -> Column:
    """Key of a bucket in the skeleton table; an empty shard name gives the plain number."""
    tail = F.when(F.length(shard.cast("string")) > 0, F.concat_ws("_", shard.cast("string"), bucket.cast("string")))
    return F.concat(F.lit(fixed.BUCKET_PREFIX), F.coalesce(tail, bucket.cast("string")))
