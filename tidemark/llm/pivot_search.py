"""Exact top-k by inner product with a pivot table.

Each component x of a vector becomes the integer floor(256 * x); the score of two
vectors is their inner product. With distances d to a pivot p, the triangle
inequality gives d(q, x) >= |d(q, p) - d(x, p)|; the largest of these lower bounds
over all pivots bounds the score from above, for
2 q.x = |q|^2 + |x|^2 - d(q, x)^2. Distances to the pivots are computed once, when
the index is made.

1. Pivots are ``PIVOTS`` vectors of a sample of ``SAMPLE`` rows, each as far as
   possible from those before it. They only decide how much is eliminated.
2. Vectors are sorted by nearest pivot and distance to it and packed into shards
   of ``SHARD`` rows with their part of the pivot table and its least and largest
   distance per pivot.
3. A query is answered in its own shard first: its candidates are evaluated in
   the order of their bounds until no other can enter the k best.
4. The k-th score found there eliminates whole shards by their ranges of
   distances, for blocks of queries and bundles of shards at a time.
5. In the shards that are left the rows are eliminated one by one, the rest is
   evaluated in the order of the bounds, and the best of all shards are merged.

Bounds allow for rounding and scores are integers, so a candidate whose bound
ties with the k-th score is left out only if its id is larger. Nothing is
approximate: pivots, shards and thresholds change the work, never the result.

Defined results: vectors that are null or hold a null or non-finite component take
no part; vectors of different lengths are not compared; rows that repeat an id are
candidates of each other; a row without id is never a query and comes last in
ties; empty vectors score 0; an empty table gives an empty result; further columns
are ignored. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered
from tidemark.session import stage

SCALE = 256
PIVOTS = 32
SAMPLE = 2000  # rows the pivots are taken from
SHARD_BITS = 10  # rows of a shard, as a power of two
BLOCK_BITS = 6  # shards whose queries form a block
BUNDLE_BITS = 9  # shards whose ranges are tested together
STEP = 64  # candidates evaluated between two tests for the end
EXACT = 2.0**52  # sums of products below this are exact in doubles
NO_ID = np.iinfo(np.int64).max

QUERIES = (
    "dim int, shard long, at array<int>, id array<long>, parts binary, table binary, kth array<double>, kth_id array<long>"
)


def far_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Up to ``most`` different rows, the longest first, then always the one farthest from those taken."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample**2).sum(1)))]
    least = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < most and least.max() > 0:
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table of rows x: their distance to each pivot."""
    if not len(pivots):
        return np.zeros((len(x), 0))
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of rows x with q; by whole numbers where doubles would round."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < EXACT:
        return x @ q
    whole = [int(v) for v in q]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in x], dtype=object)


def score_bounds(qn: np.ndarray, xn: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Largest integer score of vectors of squared lengths qn and xn that are ``lower`` apart at least, rounding allowed for."""
    slack = 1e-6 * (np.sqrt(qn) + np.sqrt(xn))
    least = np.maximum(lower - slack, 0)
    return np.floor((qn + xn - least**2) / 2 + 1e-9 * (qn + xn) + 1e-6)


class Best:
    """The k best (score, id) of a query; larger scores first, then smaller ids."""

    def __init__(self, k: int, kth: float = -np.inf, kth_id: int = NO_ID):
        self.k, self.rows = k, []
        self.kth, self.kth_id = kth, kth_id  # what a candidate has to beat

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = [(-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s > self.kth or s == self.kth and i <= self.kth_id]
        if keep:
            self.rows = sorted(self.rows + keep)[:self.k]
            if len(self.rows) == self.k and (self.rows[-1][0], self.rows[-1][1]) < (-self.kth, self.kth_id):
                self.kth, self.kth_id = -self.rows[-1][0], self.rows[-1][1]


def search(best: Best, q: np.ndarray, x: np.ndarray, ids: np.ndarray, bounds: np.ndarray, skip: int = -1) -> int:
    """Evaluate candidates in the order of their bounds until none can enter; gives how many were evaluated."""
    open_ = np.flatnonzero((bounds > best.kth) | ((bounds == best.kth) & (ids <= best.kth_id)))
    open_ = open_[open_ != skip]
    open_ = open_[np.lexsort((ids[open_], -bounds[open_]))]
    for at in range(0, len(open_), STEP):
        first = open_[at]
        if bounds[first] < best.kth or bounds[first] == best.kth and ids[first] > best.kth_id:
            return at
        some = open_[at:at + STEP]
        best.add(inner(x[some], q), ids[some])
    return len(open_)


class Shard:
    """Rows of a shard with their part of the pivot table."""

    def __init__(self, dim: int, ids: list[int | None], parts: bytes, table: bytes):
        n = len(ids)
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.x = np.frombuffer(parts).reshape(n, dim)
        self.table = np.frombuffer(table).reshape(n, -1) if n else np.zeros((0, 0))
        self.square = (self.x**2).sum(1)

    def bounds(self, q: Shard) -> np.ndarray:
        """Bounds of the scores of all queries (rows) and candidates, by the best of all pivots."""
        lower = np.zeros((len(q.ids), len(self.ids)))
        for p in range(self.table.shape[1]):
            np.maximum(lower, np.abs(q.table[:, p, None] - self.table[None, :, p]), out=lower)
        return score_bounds(q.square[:, None], self.square[None, :], lower)


def _placed(rows: DataFrame, pivots) -> DataFrame:
    """(_tree, dim, id, asks, vec, cell, near): nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, near = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            dims, vec = b.column(0).to_numpy(), b.column(3)
            for dim in np.unique(dims):
                of = pivots.value.get(int(dim))
                if of is not None and len(of):
                    at = np.flatnonzero(dims == dim)
                    d = distances(whole(vec.take(pa.array(at)), int(dim)), of)
                    cell[at], near[at] = d.argmin(1), d.min(1)
            tree = pa.array([str(d) for d in dims.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([tree, *b.columns, pa.array(cell), pa.array(near)], names=["_tree", *b.schema.names, "cell", "near"])

    kind = rows.schema["vec"].dataType.simpleString()
    return rows.select("dim", "id", "asks", "vec").mapInArrow(run, f"_tree string, dim int, id long, asks boolean, vec {kind}, cell int, near double")


def whole(vec: pa.Array, dim: int) -> np.ndarray:
    """Rows of floor(256 * x), as doubles, which hold them exactly."""
    return np.floor(vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(len(vec), dim)


def _packed(placed: DataFrame, pivots) -> DataFrame:
    """One row per shard: ids, which of them ask, integer vectors, pivot table and its ranges."""
    node = F.struct("pos", "id", "asks", "vec")
    shards = placed.groupBy("dim", F.shiftright("pos", SHARD_BITS).alias("shard")).agg(F.array_sort(F.collect_list(node)).alias("rows"))
    shards = shards.select("dim", "shard", "rows.id", "rows.asks", "rows.vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = b.slice(at, 1)
                dim = row.column(0)[0].as_py()
                x = whole(row.column(4).flatten(), dim)
                table = distances(x, pivots.value.get(dim, np.zeros((0, dim))))
                ends = [table.min(0).tobytes(), table.max(0).tobytes()]
                longest = float((x**2).sum(1).max())
                first = min((i for i in row.column(2)[0].as_py() if i is not None), default=NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:4], *[pa.array([v], pa.binary()) for v in (x.tobytes(), table.tobytes(), *ends)], pa.array([longest]), pa.array([first])],
                    names=["dim", "shard", "id", "asks", "parts", "table", "low", "high", "longest", "first"],
                )

    return shards.mapInArrow(
        run,
        "dim int, shard long, id array<long>, asks array<boolean>, parts binary, table binary, low binary, high binary, longest double, first long",
    )


def _at_home(shards: DataFrame, k: int) -> DataFrame:
    """Queries answered in their own shard: one row per shard, with what their k-th best is and all that was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, shard, ids, asks, parts, table in zip(*(c.to_pylist() for c in b.columns)):
                own = Shard(dim, ids, parts, table)
                at = [i for i, a in enumerate(asks) if a]
                if not at:
                    continue
                q = Shard(dim, [ids[i] for i in at], own.x[at].tobytes(), own.table[at].tobytes())
                kth, kth_id, found, seen = [], [], [], []
                for n, bounds in enumerate(own.bounds(q)):
                    best = Best(k)
                    seen.append(search(best, q.x[n], own.x, own.ids, bounds, skip=at[n]))
                    kth.append(float(best.kth))
                    kth_id.append(int(best.kth_id))
                    found.append([{"vec_id": None if i == NO_ID else i, "score": -int(s)} for s, i in best.rows])
                one = lambda v, t: pa.array([v], t)
                yield pa.RecordBatch.from_arrays(
                    [
                        one(dim, pa.int32()), one(shard, pa.int64()), one(at, pa.list_(pa.int32())), one([ids[i] for i in at], pa.list_(pa.int64())),
                        one(q.x.tobytes(), pa.binary()), one(q.table.tobytes(), pa.binary()), one(kth, pa.list_(pa.float64())), one(kth_id, pa.list_(pa.int64())),
                        one(found, pa.list_(pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())])))), one(seen, pa.list_(pa.int64())),
                    ],
                    names=["dim", "shard", "at", "id", "parts", "table", "kth", "kth_id", "found", "seen"],
                )

    rows = shards.select("dim", "shard", "id", "asks", "parts", "table")
    return rows.mapInArrow(run, f"{QUERIES}, found array<array<struct<vec_id: long, score: long>>>, seen array<long>")


def _surviving(home: DataFrame, shards: DataFrame) -> DataFrame:
    """(dim, shard, queries): the queries that a shard may still answer, from blocks of queries and bundles of shards."""
    query = F.struct("shard", "at", "id", "parts", "table", "kth", "kth_id")
    blocks = home.groupBy("dim", F.shiftright("shard", BLOCK_BITS).alias("block")).agg(F.collect_list(query).alias("queries"))
    ends = F.struct("shard", "low", "high", "longest", "first")
    bundles = shards.groupBy("dim", F.shiftright("shard", BUNDLE_BITS).alias("bundle")).agg(F.collect_list(ends).alias("ranges"))
    bundles = stage(bundles, "bundles")
    many = bundles.groupBy("dim").agg(F.max("bundle").alias("last"))  # one row per length of vectors
    asked = blocks.join(many, "dim").withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    pairs = asked.join(bundles, ["dim", "bundle"]).select("dim", "queries", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, queries, ranges in zip(*(c.to_pylist() for c in b.columns)):
                origin = np.concatenate([np.full(len(p["at"]), p["shard"]) for p in queries])
                at, ids, kth, kth_id = ([v for p in queries for v in p[c]] for c in ("at", "id", "kth", "kth_id"))
                q = Shard(dim, ids, b"".join(p["parts"] for p in queries), b"".join(p["table"] for p in queries))
                limit, last = np.array(kth), np.array(kth_id)
                for r in ranges:
                    low, high = np.frombuffer(r["low"]), np.frombuffer(r["high"])
                    gap = np.maximum(low - q.table, q.table - high).max(1, initial=0)
                    # |x| is at most the longest; the score's bound grows with it while q.x may
                    most = score_bounds(q.square, np.full(len(ids), r["longest"]), gap)
                    left = np.flatnonzero(((most > limit) | (most == limit) & (r["first"] <= last)) & (origin != r["shard"]))
                    if len(left):
                        pick = lambda v: [v[i] for i in left]
                        part = [pick(at), pick(ids), q.x[left].tobytes(), q.table[left].tobytes(), pick(kth), pick(kth_id), origin[left].tolist()]
                        kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([dim], pa.int32()), pa.array([r["shard"]], pa.int64()), *[pa.array([v], t) for v, t in zip(part, kinds)]],
                            names=["dim", "shard", "at", "q_id", "q_parts", "q_table", "kth", "kth_id", "origin"],
                        )

    return pairs.mapInArrow(
        run, "dim int, shard long, at array<int>, q_id array<long>, q_parts binary, q_table binary, kth array<double>, kth_id array<long>, origin array<long>"
    )


def _abroad(left: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """Candidates of other shards that beat what a query has at home."""
    pairs = left.join(shards.select("dim", "shard", "id", "parts", "table"), ["dim", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                row = [c[0].as_py() for c in b.slice(at, 1).columns]
                dim, places, q_ids, q_parts, q_table, kth, kth_id, origin, ids, parts, table = row
                x, out = Shard(dim, ids, parts, table), []
                for first in range(0, len(q_ids), 256):
                    n = len(q_ids[first:first + 256])
                    width = x.table.shape[1]
                    q = Shard(
                        dim, q_ids[first:first + n], q_parts[8 * dim * first:8 * dim * (first + n)], q_table[8 * width * first:8 * width * (first + n)]
                    )
                    for j, bounds in enumerate(x.bounds(q)):
                        i = first + j
                        best = Best(k, kth[i], kth_id[i])
                        seen = search(best, q.x[j], x.x, x.ids, bounds)
                        out += [(dim, origin[i], places[i], q_ids[i], None if c == NO_ID else c, -int(s)) for s, c in best.rows]
                        if seen:
                            out.append((dim, origin[i], places[i], q_ids[i], None, None, seen))
                cols = list(zip(*[(*r, None)[:7] for r in out])) or [[]] * 7
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)], names=["dim", "shard", "at", "query_id", "vec_id", "score", "seen"]
                )

    rows = pairs.select("dim", "at", "q_id", "q_parts", "q_table", "kth", "kth_id", "origin", "id", "parts", "table")
    return rows.mapInArrow(run, "dim int, shard long, at int, query_id long, vec_id long, score long, seen long")


class Index:
    """Shards of vectors (id, vec, asks) with their pivot table."""

    def __init__(self, vectors: DataFrame, id_col: str, vec_col: str, asks: Column, pivots: int = PIVOTS):
        spark = vectors.sparkSession
        vec = F.col(f"`{vec_col}`")
        sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        rows = vectors.filter(vec.isNotNull() & sound).select(
            F.size(vec).alias("dim"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), vec.alias("vec")
        )
        sample: dict[int, list] = {}
        for dim, v in rows.select("dim", "vec").orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).collect():
            sample.setdefault(dim, []).append(v)
        found = {d: far_pivots(np.floor(np.array(v, np.float64).reshape(len(v), d) * SCALE), pivots) for d, v in sample.items()}
        table = spark.sparkContext.broadcast(found)
        self.shards = stage(_packed(numbered(_placed(rows, table), ["cell", "near"]), table), "shards")

    def search(self, k: int) -> tuple[DataFrame, DataFrame]:
        """The k best rows of each query (query_id, rank, vec_id, score), and how many candidates each query evaluated."""
        home = stage(_at_home(self.shards, k), "home")
        abroad = stage(_abroad(_surviving(home, self.shards), self.shards, k), "abroad")
        key = ["dim", "shard", "at"]
        each = home.select("dim", "shard", F.explode(F.arrays_zip("at", "id", "found", "seen")).alias("q"))
        near = each.select("dim", "shard", "q.at", F.col("q.id").alias("query_id"), F.explode("q.found").alias("f")).select(
            *key, "query_id", "f.vec_id", "f.score"
        )
        both = near.unionByName(abroad.filter("score is not null").drop("seen"))
        order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        top = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        seen = each.select("dim", "shard", "q.at", "q.seen").unionByName(abroad.filter("seen is not null").select(*key, "seen"))
        return top.select("query_id", "rank", "vec_id", "score"), seen.groupBy(*key).agg(F.sum("seen").alias("evaluated"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by ``every``."""
    asks = F.col(f"`{id_col}`") % every == 0
    return Index(vectors, id_col, vec_col, asks, pivots).search(k)[0]
