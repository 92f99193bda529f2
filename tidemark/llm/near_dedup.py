"""Near duplicates: SimHash fingerprints linked through vantage-point trees.

Distinct fingerprints are the points; copies share one. Two that differ in at
most r of 64 bits differ in one bit at most in one of r // 2 + 1 segments. So
there is one vantage-point tree per segment over the Hamming distance inside it,
a lower bound of the whole distance.

A node has a vantage point v and a median distance m. By the triangle
inequality, points x and y with |d(x, v) - d(y, v)| > 1 are further apart than
one bit, so a pair within one bit lies on one side if the inner side takes all
with d <= m + 1 and the outer side all with d > m: points in the ring at the
boundary belong to both shards. The upper levels of each tree come from a
bounded sample and deal the points to shards; inside a shard the tree is grown
on, until a part is small or no vantage point splits it, and the parts are
compared on all 64 bits, exactly. A shard gives a star for each of its linked
groups, not its pairs. Shards over ``CELL_ROWS`` are cut into blocks, and every
pair of blocks is a task of its own.

A link can also ask for likeness: points then are fingerprints with a sketch of
the text's set of shingles (the least hash of each of ``BINS`` bins, one byte
each), whose shared bins estimate the Jaccard similarity. This allows a wide
radius, which would link unlike texts by itself.

The pipeline's stage asks for a similarity of 0.8. Its first candidates are the
texts whose fingerprints the trees link; the sets of their shingles decide. What
fingerprints miss is found beside them: sets that share a shingle of their
prefixes, which no similar pair can lack, and whose sizes and spreads allow it,
are compared unless they are in one group already.

The stars are joined to components by alternating large-star and small-star
rounds on tables. No fingerprint or link but the sample reaches the driver.

Defined results: null or blank text has fingerprint zero and is linked like any
other; null ids are smallest only where all ids of a group are null; rows are told
apart by id and text, so different texts without an id, or with the same one,
stay apart; repeated rows are repeated in the result; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, packed, pieces, row_key, small_batches
from tidemark.session import free_shuffles, release, stage

SHINGLE = 4
SEED = 42
RADIUS = 4
BINS = 128
LIKE = 0.77  # estimated similarity that a link needs to stand for 0.8; the estimate errs by 0.035
SAMPLE = 262_144  # fingerprints at most that the driver reads to choose vantage points: 2 MB
SHARD_ROWS = 65_536  # points wanted in a shard, before its ring
MOST_SHARDS = 16_384  # of one segment
CELL_ROWS = 262_144  # points of a block of a shard that no vantage point splits
LEAF = 384
WIDE, SIMILAR = 5, (4, 5)  # words of a shingle and least similarity of the pipeline's stage
FEW = 100_000  # sets whose names are broadcast to where the texts lie: 10 MB at most; more are joined
BLOCK = 4_096  # nodes of a key that meet in one task of the last round
MOST_COUNTED = 65_535  # shingles of one first byte that a spread can tell
STARS = 3  # rounds that compare with one node of a key, before all pairs
BUCKETS, COUNTERS = 1 << 20, 1 << 12  # counters of the order of shingles: 8 MB; those of a row that is shuffled
COMPARED = 1 << 21  # distances held at once
LIKENESSES = 1 << 16  # pairs of sketches held at once


def segments(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of the segments; a pair within ``radius`` differs in one bit at most in one of them."""
    edges = np.linspace(0, 64, radius // 2 + 2).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, repeats included; of fewer words than ``width``, of all of them."""
    kept, some = [], False
    for piece in pieces((text or "").encode().lower()):
        words = kept + piece.split()
        kept = words[1 - width:] if width > 1 else []
        if len(words) < width:
            kept = words
            continue
        lengths = list(map(len, words))
        ends = list(accumulate(n + 1 for n in lengths))
        data = b" ".join(words)
        spans = zip([e - n - 1 for e, n in zip(ends, lengths)], ends[width - 1:])
        yield np.array([xxhash.xxh64_intdigest(data[a:b - 1], SEED) for a, b in spans], dtype=np.uint64)
        some = True
    if kept and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], np.uint64)


def simhash(ones: np.ndarray, total: int) -> int:
    """The fingerprint of ``total`` hashes of which ``ones`` have a bit set: the bits that more than half of them have."""
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def sketch_text(text: str | None, width: int = SHINGLE) -> tuple[int, bytes]:
    """SimHash over the word shingles of a text, repeats included, and the sketch of their set."""
    ones, total = np.zeros(64, np.int64), 0
    least = np.full(BINS, 1 << 32, np.int64)
    for hashes in shingle_hashes(text, width):
        ones += ones_of(hashes)
        total += len(hashes)
        np.minimum.at(least, (hashes >> np.uint64(57)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return simhash(ones, total), np.where(least < 1 << 32, 1 + least % 255, 0).astype(np.uint8).tobytes()  # 0: no shingle fell there


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The set of shingle hashes, in order; empty for a text without words."""
    found = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    return sketch_text(text, width)[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of sketches; 1 for texts without words."""
    used = ((a | b) > 0).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, sketches: bool = False) -> DataFrame:
    """(id, h, node, fp, sketch) per document; h is the text's hash, fp the fingerprint as a signed number, node names the point."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sketch_text(t, width) for t in b.column(1).to_pylist()]
            fp = np.array([f for f, _ in got], dtype=np.uint64).view(np.int64)
            sketch = pa.array([s if sketches else b"" for _, s in got], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), sketch, b.column(2)], names=["id", "fp", "sketch", "h"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    rows = texts.mapInArrow(run, f"id {kind.simpleString()}, fp bigint, sketch binary, h bigint")
    return rows.withColumn("node", F.xxhash64("fp", "sketch") if sketches else F.col("fp"))


def _segment(points: np.ndarray, segment: tuple[int, int]) -> np.ndarray:
    low, bits = segment
    return (points >> np.uint64(low)) & np.uint64((1 << bits) - 1)


class Tree:
    """The upper levels of a vantage-point tree, grown on a sample; node i has children 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, radius: int, rng: np.random.Generator):
        self.depth, self.radius = depth, radius
        self.vantage = np.zeros((1 << depth) - 1, np.uint64)
        self.median = np.zeros((1 << depth) - 1, np.uint8)
        parts = [sample]
        for node in range(len(self.vantage)):
            part = parts[node]
            inner = outer = part
            if len(part):
                self.vantage[node] = part[rng.integers(len(part))]
                d = np.bitwise_count(part ^ self.vantage[node])
                # the inner side also takes the ring, so the cut is set below the median
                self.median[node] = m = max(int(np.median(d)) - 1, 0)
                inner, outer = part[d <= m], part[d > m]
            parts += [inner, outer]

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of points and the shards they belong to; points in rings belong to several."""
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            d, m = np.bitwise_count(points[at] ^ self.vantage[node]), self.median[node]
            inner, outer = d <= m + self.radius, d > m
            at = np.concatenate([at[inner], at[outer]])
            node = np.concatenate([2 * node[inner] + 1, 2 * node[outer] + 2])
        return at, node - ((1 << self.depth) - 1)


class Groups:
    """Linked groups of points; ``of`` names the first point of each point's group."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while True:
            ga, gb = of[a], of[b]
            differ = ga != gb
            if not differ.any():
                return
            a, b, ga, gb = a[differ], b[differ], ga[differ], gb[differ]
            low = np.minimum(ga, gb)
            np.minimum.at(of, np.maximum(ga, gb), low)
            while True:
                up = of[of]
                if (up == of).all():
                    break
                of[:] = up


@dataclass
class Points:
    """Points of a cell and what a link between two of them needs."""

    fp: np.ndarray
    radius: int = RADIUS
    sketch: np.ndarray | None = None
    like: float = LIKE

    def linked(self, rows: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (in rows, in rest) of the linked pairs."""
        near = np.bitwise_count(self.fp[rows][:, None] ^ self.fp[rest][None, :]) <= self.radius
        r, c = np.nonzero(near)
        if self.sketch is None or not len(r):
            return r, c
        ok = [
            likeness(self.sketch[rows[r[i:i + LIKENESSES]]], self.sketch[rest[c[i:i + LIKENESSES]]]) >= self.like
            for i in range(0, len(r), LIKENESSES)
        ]
        ok = np.concatenate(ok)
        return r[ok], c[ok]


def _compare(points: Points, part: np.ndarray, groups: Groups) -> None:
    """Link all pairs of a part."""
    step = max(1, COMPARED // len(part))
    for i in range(0, len(part) - 1, step):
        rows, rest = part[i:i + step], part[i + 1:]
        r, c = points.linked(rows, rest)
        later = c + 1 > r  # each pair once, no point with itself
        r, c = r[later], c[later]
        if len(r):
            # one link per point first; most others then lie inside a group
            one = np.unique(c, return_index=True)[1]
            groups.link(rows[r[one]], rest[c[one]])
            groups.link(rows[r], rest[c])


def link_points(points: Points, segment: tuple[int, int], leaf: int = LEAF, seed: int = 1) -> np.ndarray:
    """The first linked point of each point: exact for pairs within one bit of each other in the segment."""
    groups, own, rng = Groups(len(points.fp)), _segment(points.fp, segment), np.random.default_rng(seed)
    parts = [np.arange(len(points.fp))]
    while parts:
        part = parts.pop()
        if len(part) > leaf:
            d = np.bitwise_count(own[part] ^ own[part[rng.integers(len(part))]]).astype(np.int16)
            sides = []
            for m in {max(int(np.median(d)) - 1, 0), int(np.median(d))}:
                sides.append((part[d <= m + 1], part[d > m]))
            inner, outer = min(sides, key=lambda s: max(map(len, s)))
            if max(len(inner), len(outer)) <= 0.9 * len(part):
                parts += [inner, outer]
                continue
        if len(part) > 1:
            _compare(points, part, groups)
    return groups.of


def linked_nodes(
    points: DataFrame, radius: int = RADIUS, like: float | None = None, shard_rows: int = SHARD_ROWS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Stars (a, b), a > b, that join the linked nodes of (node, fp, sketch), all distinct."""
    spark = points.sparkSession
    n = points.count()
    depth = max(0, min(int(np.ceil(np.log2(max(n, 1) / shard_rows))), int(np.log2(MOST_SHARDS))))
    # the sample grows with the shards and is bounded with them
    sample = points.select("fp").orderBy(F.xxhash64("fp", F.lit("sample"))).limit(min(SAMPLE, 16 << depth))
    sample = np.array([r[0] for r in sample.collect()], dtype=np.int64).view(np.uint64)
    rng, parts = np.random.default_rng(7), segments(radius)
    shared = spark.sparkContext.broadcast([Tree(_segment(sample, s), depth, 1, rng) for s in parts])  # 9 bytes a shard and segment

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (tree, segment) in enumerate(zip(shared.value, parts)):
                at, shard = tree.shards(_segment(fp, segment))
                rows = [c.take(pa.array(at)) for c in b.columns]
                yield pa.RecordBatch.from_arrays([pa.array((k << 32) + shard), *rows], names=["shard", "node", "fp", "sketch"])

    dealt = points.select("node", "fp", "sketch").mapInArrow(deal, "shard bigint, node bigint, fp bigint, sketch binary")
    sizes = stage(dealt.groupBy("shard").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("blocks")), "shards")
    # a row per shard and segment, (radius // 2 + 1) * MOST_SHARDS at most
    cells = dealt.join(F.broadcast(sizes), "shard").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("shard", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "fp", "sketch")

    def inside_cell(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("node").combine_chunks()
        node, fp = (t.column(c).to_numpy() for c in ("node", "fp"))
        sketch = None
        if like is not None:
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(node), BINS)
        of = link_points(Points(fp.view(np.uint64), radius, sketch, like or 0), parts[key[0].as_py() >> 32])
        away = np.flatnonzero(of != np.arange(len(node)))
        return pa.table({"a": node[away], "b": node[of[away]]})

    return cells.groupBy("shard", "x", "y").applyInArrow(inside_cell, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node of edges (a, b), a > b, but the roots; root is the smallest node reachable.

    Large-star hangs the greater neighbours of a node on its least neighbour,
    small-star the lesser ones and the node itself; stars remain after rounds of
    the order of the logarithm of the nodes.
    """
    edges, seen = stage(edges, "edges"), None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = stage(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select("a", F.col("b").alias("root"))
        seen = now


def first_document():
    """The document of the smallest id; null ids come last, and of equal ids the smallest text hash is first."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h"))


def grouped(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE,
    like: float | None = None, **sizes: int,
) -> tuple[DataFrame, DataFrame]:
    """(id, h, node, fp, sketch) per document, and (node, least, root) per point; least is its first document, groups share the root."""
    rows = stage(with_fingerprints(docs, id_col, text_col, width, like is not None), "fingerprints")
    points = stage(rows.groupBy("node", "fp", "sketch").agg(first_document().alias("least")), "points")
    roots = components(linked_nodes(points, radius, like, **sizes))
    named = points.join(roots, points["node"] == roots["a"], "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return rows, stage(named, "named")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, fp, component_id) per document; component_id is the smallest id that links reach.

    A link is a distance of ``radius`` at most and, with ``like``, an estimated
    similarity of that at least.
    """
    rows, named = grouped(docs, id_col, text_col, **options)
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    return rows.select("id", "node", "fp").join(named.join(first, "root").select("node", "first"), "node").select("id", "fp", F.col("first.id").alias("component_id"))


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _counter_rows(counts: np.ndarray) -> pa.RecordBatch:
    """(part, at, n) of the counters that are not 0, ``COUNTERS`` a row at most."""
    part, at, n = [], [], []
    for k in range(0, len(counts), COUNTERS):
        own = counts[k:k + COUNTERS]
        if (used := np.flatnonzero(own)).size:
            part.append(k // COUNTERS)
            at.append(used.astype(np.int16))
            n.append(own[used])
    columns = [pa.array(part, pa.int32()), pa.array(at, pa.list_(pa.int16())), pa.array(n, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "at", "n"])


def _add_counters(counts: np.ndarray, batches: Iterable[pa.RecordBatch]) -> np.ndarray:
    for b in batches:
        for part, at, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            counts[part * COUNTERS + at.values.to_numpy().astype(np.int64)] += n.values.to_numpy()
    return counts


def shingle_counts(docs: DataFrame, width: int) -> np.ndarray:
    """In how many documents (text) shingles of each of ``BUCKETS`` stand: all documents, each shingle of its set once.

    It only orders the shingles, so that common ones are rarely compared; links do
    not depend on it. A task hands on its counters, not its shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                np.add.at(counts, (shingle_set(t, width) % BUCKETS).astype(np.int64), 1)
        yield _counter_rows(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _counter_rows(_add_counters(np.zeros(BUCKETS, np.int64), batches))

    schema = "part int, at array<smallint>, n array<bigint>"
    found = docs.select("text").mapInArrow(run, schema).repartition("part").mapInArrow(add, schema)
    return _add_counters(np.zeros(BUCKETS, np.int64), found.toArrow().to_batches())  # 10 MB at most


def with_prefixes(texts: DataFrame, width: int, like: tuple[int, int]) -> DataFrame:
    """(id, h, hash, n, prefix, spread, fp) per (id, h, text): the hash of the shingle set, its size, its first shingles, its spread, its fingerprint.

    In one order of all shingles, rarest first, two sets of n and m shingles that
    share ``like`` of their union share one of the first n - ceil(like * n) + 1
    and m - ceil(like * m) + 1: a link is never missed. The spread counts the
    shingles by their first byte; two sets share no more of a byte than the one
    has that has less.
    """
    shared, kind = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, width)), texts.schema["id"].dataType
    up, down = like

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, first, spread, fp = [], [], [], [], []
            for t in b.column(2).to_pylist():
                own = shingle_set(t, width)
                by = np.lexsort((own, shared.value[(own % BUCKETS).astype(np.int64)]))
                node.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                size.append(len(own))
                fp.append(simhash(ones_of(own), len(own)))
                first.append(own[by[:len(own) + (-up * len(own)) // down + 1]].view(np.int64) if len(own) else own.view(np.int64))
                counts = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256)
                spread.append(np.minimum(counts, MOST_COUNTED).astype("<u2").tobytes())
            node = np.array(node, np.uint64).view(np.int64)
            columns = [pa.array(node), pa.array(size, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(spread, pa.binary())]
            columns.append(pa.array(np.array(fp, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["id", "h", "hash", "n", "prefix", "spread", "fp"])

    schema = f"id {kind.simpleString()}, h bigint, hash bigint, n int, prefix array<bigint>, spread binary, fp bigint"
    return texts.select("id", "h", "text").mapInArrow(run, schema)


def with_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) per (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, width).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def _can_link(x: str, y: str, like: tuple[int, int]) -> Column:
    """Whether sets of this size, with this first common shingle, can share ``like`` of their union."""
    up, down = like
    share = F.lit(1) + F.least(*[F.col(f"{t}.n") - F.col(f"{t}.at") - 1 for t in (x, y)])
    return share * (up + down) >= F.lit(up) * (F.col(f"{x}.n") + F.col(f"{y}.n"))


def can_share(pairs: DataFrame, like: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of (a, b, n, m, p, q) whose sizes and spreads allow ``like``; none that has it is left out."""
    up, down = like

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            p, q = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, 256) for i in (4, 5))
            least = np.minimum(p, q)
            most = least.sum(1, dtype=np.int64)
            full = (least == MOST_COUNTED).any(1)  # a count that may be larger
            keep = pa.array(full | (most * (up + down) >= up * (n + m)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "n", "m", "p", "q").mapInArrow(run, "a bigint, b bigint")


class Alike:
    """Sets of shingles (node, least, n, spread) of texts (id, h, text) and those of them that are made."""

    def __init__(self, points: DataFrame, texts: DataFrame, width: int, like: tuple[int, int]):
        self.points, self.texts, self.width, self.like = points, texts, width, like
        self.sets: list[DataFrame] = []

    def _made(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.sets)

    def _make(self, nodes: DataFrame) -> None:
        """Make the sets of nodes that have none yet, where the texts lie if the nodes are few."""
        for known in self.sets:
            nodes = nodes.join(known, "node", "left_anti")
        keys = self.points.join(nodes, "node").select("node", row_key(F.col("least.id"), F.col("least.h")).alias("_key"))
        keys = stage(keys, "keys")
        few = F.broadcast(keys) if keys.count() <= FEW else keys  # 100 bytes a row at most
        own = self.texts.withColumn("_key", row_key(F.col("id"), F.col("h"))).join(few, "_key").select("node", "text")
        self.sets.append(stage(with_sets(own, self.width).dropDuplicates(["node"]), "sets"))
        release(keys)

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that share ``like`` of their union, exactly."""
        up, down = self.like
        first, second = (
            self.points.select(F.col("node").alias(x), F.col("n").alias(size), F.col("spread").alias(spread)) for x, size, spread in (("a", "n", "p"), ("b", "m", "q"))
        )
        near = stage(can_share(pairs.join(first, "a").join(second, "b"), self.like), "near")
        self._make(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        p, q = (self._made().select(F.col("node").alias(x), F.col("shingles").alias(y)) for x, y in (("a", "p"), ("b", "q")))
        both = near.join(p, "a").join(q, "b").withColumn("same", F.size(F.array_intersect("p", "q")))
        out = stage(both.filter(F.col("same") * (up + down) >= F.lit(up) * (F.size("p") + F.size("q"))).select("a", "b"), "links")
        release(near)
        free_shuffles(out.sparkSession)
        return out

    def done(self) -> None:
        release(*self.sets)


def _all_pairs(met: DataFrame) -> DataFrame:
    """Pairs of nodes of a key that are not in one group; the nodes of a large key meet block by block."""
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    cells = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "n", "at", "root")
    x, y = cells.alias("x"), cells.alias("y")
    cell = (F.col("x.key") == F.col("y.key")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    once = (F.col("x.lo") == F.col("x.hi")) | (F.col("x.own") != F.col("y.own"))
    return x.join(y, cell & once & (F.col("x.node") > F.col("y.node")) & (F.col("x.root") != F.col("y.root")))


def fingerprint_pairs(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a > b, of sets (node, fp): each with the first one of the group that the trees link its fingerprint to."""
    spots = points.select(F.col("fp").alias("node"), "fp", F.lit(b"").alias("sketch")).distinct()
    roots = components(linked_nodes(spots, radius))
    placed = points.join(roots, points["fp"] == roots["a"], "left").select("node", F.coalesce("root", "fp").alias("root"))
    first = placed.groupBy("root").agg(F.min("node").alias("b"), F.count("*").alias("k")).filter("k > 1").select("root", "b")
    return placed.join(first, "root").filter("node <> b").select(F.col("node").alias("a"), "b")


def alike_roots(entries: DataFrame, sets: Alike, near: DataFrame, stars: int = STARS) -> DataFrame:
    """(a, root) of the nodes linked by a similarity of ``like`` or more, but the roots.

    ``near`` (a, b) are compared first: those whose fingerprints are linked.
    ``entries`` (key, node, n, at, degree) are the places of shingles in prefixes.
    In each of the first rounds the nodes of a key are compared with one of them:
    first the one that meets most others over all its keys, which in a group of
    edited copies is the least edited and like most of them, then the one of the
    smallest group left. The last round compares all that share a key and are not
    in one group yet. What has been compared is not compared again, and a large
    group of like texts is settled by stars, not by its pairs.
    """
    tested = [stage(near, "pairs")]
    links = [sets.links(tested[-1])]
    roots = components(links[-1])
    for k in range(stars + 1):
        places = entries.select("key", "node", "n", "at", "degree")
        rows = places.join(roots, places["node"] == roots["a"], "left").select(*places.columns, F.coalesce("root", "node").alias("root"))
        best = F.max(F.struct("degree", F.xxhash64("node", F.lit(k)).alias("by"), "node", "n", "at", "root"))
        groups = rows.groupBy("key", "root").agg(F.count("*").alias("size"), best.alias("best"))
        centre = F.min(F.struct("size", "root", "best"))["best"] if k else F.max("best")
        open_ = groups.groupBy("key").agg(F.sum("size").alias("k"), F.count("*").alias("groups"), centre.alias("c"))
        open_ = open_.filter("groups > 1").select("key", "k", "c")
        met = stage(rows.join(open_, "key").select(*places.columns, "root", "c", "k"), "open-keys")
        release(entries)
        entries = met
        if met.isEmpty():
            break
        if k < stars:
            y = met.select("key", F.struct("node", "n", "at", "root").alias("x"), F.col("c").alias("y")).filter("x.root <> y.root")
        else:
            y = _all_pairs(met)
        pairs = y.filter(_can_link("x", "y", sets.like)).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
        pairs = pairs.join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti")
        tested.append(stage(pairs, "pairs"))
        links.append(sets.links(tested[-1]))
        roots = components(reduce(DataFrame.union, links))
    release(entries, *tested, *links)
    return roots


def alike(docs: DataFrame, id_col: str, text_col: str, width: int, like: tuple[int, int]) -> DataFrame:
    """(node, least, root) per set of shingles; least is its first document, groups share the root.

    Only shingles that two sets have in their prefixes are kept, and only sets that
    some other may be like are made; what has been read for the last time is
    deleted on the way.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    found = with_prefixes(texts, width, like).groupBy("hash").agg(
        first_document().alias("least"), F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"), F.any_value("spread").alias("spread"), F.any_value("fp").alias("fp")
    )
    whole = stage(found.withColumn("node", F.monotonically_increasing_id()), "points")  # small numbers take little room in a shuffle
    free_shuffles(spark)
    entries = whole.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1")
    met = stage(entries.join(shared, "key").select("key", "node", "n", "at", "k"), "shared")
    degrees = met.groupBy("node").agg(F.sum("k").alias("degree"))
    entries = stage(met.drop("k").join(degrees, "node"), "places")
    release(met)
    points = stage(whole.select("node", "least", "n", "spread", "fp"), "sizes")
    release(whole)
    free_shuffles(spark)
    sets = Alike(points, texts, width, like)
    roots = alike_roots(entries, sets, fingerprint_pairs(points))
    named = stage(points.join(roots, points["node"] == roots["a"], "left").select("node", "least", F.coalesce("root", "node").alias("root")), "named")
    sets.done()
    release(points)
    return named


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDE, like: tuple[int, int] = SIMILAR) -> DataFrame:
    """One document of each group with all its columns: that of the smallest id, and of these the smallest text hash.

    A link is a Jaccard similarity of the sets of shingles of ``like`` at least,
    exactly; texts without words are one group.
    """
    named = alike(docs, id_col, text_col, width, like)
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    keys = first.select(row_key(F.col("first.id"), F.col("first.h")).alias("_key"))
    wide = packed(docs, id_col, text_col).select(row_key(F.col(id_col), F.xxhash64(text_col)).alias("_key"), ROW)
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return wide.join(keys, "_key", "left_semi").withColumn("_nth", nth).filter("_nth = 1").select(f"{ROW}.*")
