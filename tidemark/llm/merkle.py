"""Merkle manifest of a table by incremental witnesses.

Rows become leaves, one tree per value of a column; the roots of the trees, in
the order of that value, are the leaves of one tree above them. A node is the
hash of two consecutive nodes below it; the last node of a level may be alone and
is then the hash of one. A witness holds, level by level, what a leaf needs to
reach the root: its sibling and its side, or a mark that there is none.

Leaves are appended in order. An aligned subtree of 2^h leaves stays open until
its sibling is complete; then the sibling's root extends the partial witnesses of
all its leaves, and both become one subtree (``Appends``). Appends run in aligned
blocks of ``BLOCK`` leaves, each in some task; the roots of the blocks are
appended in blocks of their own, and so on until one is left. The way back down
hands each block the witness of its root, which completes those of its leaves.

A leaf's position comes from one sort by ranges: rows are numbered along each
range and a small table of one row per range carries the numbers on, so a tree
may hold all rows. A row is one digest and what the caller carries; texts are
hashed where they lie and never shuffled.

Defined results: a null column is hashed as ``-``, an empty text as ``0:``; null
trees and null ids come first; rows with equal ids are ordered by their leaves,
and equal rows take consecutive places; a tree of one leaf is that leaf, with an
empty witness; an empty table gives an empty result; further columns are not
part of the leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import numbered, row_key
from tidemark.session import stage

BLOCK = 1024  # leaves of a block, a power of two
HEIGHT = BLOCK.bit_length() - 1
LONE, LEFT, RIGHT = 0, 1, 2  # a step without sibling, with one on the left, on the right
TAMPERED = 7

LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def node_hash(*nodes: bytes) -> bytes:
    """The node above consecutive nodes; digests are hashed as lower-case hex text."""
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


class Appends:
    """A tree that grows by appends. Open subtrees are (height, root, first leaf, end)."""

    def __init__(self, witnesses: bool = True):
        self.open: list[tuple[int, bytes, int, int]] = []
        self.witnesses: list[bytearray] | None = [] if witnesses else None
        self.n = 0

    def _extend(self, node: tuple[int, bytes, int, int], step: bytes) -> None:
        if self.witnesses is not None:
            for at in range(node[2], node[3]):
                self.witnesses[at] += step

    def _complete(self, node: tuple[int, bytes, int, int]) -> None:
        """Join the node with the open siblings that it completes."""
        while self.open and self.open[-1][0] == node[0]:
            left = self.open.pop()
            self._extend(left, bytes([RIGHT]) + node[1])
            self._extend(node, bytes([LEFT]) + left[1])
            node = (node[0] + 1, node_hash(left[1], node[1]), left[2], node[3])
        self.open.append(node)

    def append(self, digest: bytes) -> None:
        if self.witnesses is not None:
            self.witnesses.append(bytearray())
        self.n += 1
        self._complete((0, digest, self.n - 1, self.n))

    def close(self, height: int | None) -> bytes:
        """The root: of the given height where other blocks follow or precede, else of what there is."""
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            node = self.open.pop()
            self._extend(node, bytes([LONE]))
            self._complete((node[0] + 1, node_hash(node[1]), node[2], node[3]))
        return self.open[0][1]


def block_root(digests: list[bytes], alone: bool, witnesses: bool) -> tuple[bytes, list[bytearray] | None]:
    """Root and witnesses of a block; ``alone`` if it is its tree's only one."""
    tree = Appends(witnesses)
    for d in digests:
        tree.append(d)
    return tree.close(None if alone else HEIGHT), tree.witnesses


def steps(witness: bytes) -> Iterator[tuple[int, bytes]]:
    """(side, sibling) from the leaf upwards; the sibling of a lone step is empty."""
    at = 0
    while at < len(witness):
        side, at = witness[at], at + 1
        size = 0 if side == LONE else 32
        yield side, witness[at:at + size]
        at += size


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that the leaf and its witness lead to."""
    for side, sibling in steps(witness):
        leaf = node_hash(leaf) if side == LONE else node_hash(sibling, leaf) if side == LEFT else node_hash(leaf, sibling)
    return leaf


def witness_digest(witness: bytes) -> bytes:
    """The hash of all siblings, from the leaf upwards."""
    return node_hash(*[s for side, s in steps(witness) if side != LONE])


def leaf_digest(*cols: Column) -> Column:
    """SHA-256 of the columns: ``-`` for a null, else byte count, ``:`` and value."""
    text = [c.cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """One row per aligned block of (_tree, pos, size, digest, ...): its nodes in order, what they carry beside them."""
    node = F.struct("pos", "digest", F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    out = nodes.groupBy("_tree", F.shiftright("pos", HEIGHT).alias("block"), "size").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    return out.select("_tree", "block", "size", F.col("nodes.digest").alias("digests"), F.col("nodes.carry").alias("carried"))


def _roots(blocks: DataFrame) -> DataFrame:
    """The roots of blocks as nodes of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree, block, size, digests = (c.to_pylist() for c in b.columns)
            found = [block_root(d, s <= BLOCK, False)[0] for d, s in zip(digests, size)]
            above = [-(-s // BLOCK) for s in size]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree, pa.string()), pa.array(block, pa.int64()), pa.array(above, pa.int64()), pa.array(found, pa.binary())],
                names=["_tree", "pos", "size", "digest"],
            )

    return blocks.select("_tree", "block", "size", "digests").mapInArrow(run, "_tree string, pos bigint, size bigint, digest binary")


def _complete(blocks: DataFrame) -> DataFrame:
    """(_tree, pos, subroot, root, digest, witness, carry) of the nodes of blocks that know their own ``above``."""
    carry = blocks.schema["carried"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):  # a block at a time
                row = b.slice(at, 1)
                tree, block, size, digests, above, subroot, root = (row.column(i)[0].as_py() for i in range(7))
                _, own = block_root(digests, size <= BLOCK, True)
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * n, pa.string()), pa.array(range(block * BLOCK, block * BLOCK + n), pa.int64()),
                        pa.array([subroot] * n, pa.binary()), pa.array([root] * n, pa.binary()), pa.array(digests, pa.binary()),
                        pa.array([bytes(w) + above for w in own], pa.binary()), row.column(7).flatten(),
                    ],
                    names=["_tree", "pos", "subroot", "root", "digest", "witness", "carry"],
                )

    fields = "_tree string, pos bigint, subroot binary, root binary, digest binary, witness binary"
    schema = T.StructType([*T.StructType.fromDDL(fields).fields, T.StructField("carry", carry)])
    rows = blocks.select("_tree", "block", "size", "digests", "above", "subroot", "root", "carried")
    return rows.mapInArrow(run, schema)


def _grow(nodes: DataFrame, carry: list[str], trees: DataFrame | None) -> DataFrame:
    """Append the nodes (_tree, pos, size, digest) block by block and hand the witnesses down.

    ``trees`` names the value of each tree (_tree, _value); its roots are then the
    leaves of the tree above. Without it the roots are the end.
    """
    rounds = [stage(_blocks(nodes, carry), "blocks")]
    most = rounds[0].agg(F.max("size")).first()[0] or 0
    while most > BLOCK:
        rounds.append(stage(_blocks(stage(_roots(rounds[-1]), "roots"), []), "blocks"))
        most = -(-most // BLOCK)
    tops = stage(_roots(rounds[-1]).select("_tree", F.col("digest").alias("subroot")), "subroots")  # one row per tree
    if trees is None:
        above = tops.select("_tree", "subroot", F.col("subroot").alias("root"), F.lit(b"").alias("above"))
    else:
        named = tops.join(trees, "_tree").select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "_value", F.col("subroot").alias("digest"))
        high = _grow(numbered(named, ["_value"]), ["_name"], None)
        above = high.select(F.col("carry._name").alias("_tree"), F.col("digest").alias("subroot"), "root", F.col("witness").alias("above"))
    done = _complete(rounds[-1].join(stage(above, "above"), "_tree"))
    for blocks in rounds[-2::-1]:
        known = done.select("_tree", F.col("pos").alias("block"), "subroot", "root", F.col("witness").alias("above"))
        done = _complete(blocks.join(stage(known, "above"), ["_tree", "block"]))
    return done


def witnesses(leaves: DataFrame, tree: str, order: list[str], carry: list[str] = ()) -> DataFrame:
    """Witnesses of leaves (``digest``, binary), one tree per value of ``tree``, in ``order`` and then by digest.

    Gives the columns of ``carry``, ``pos`` in the tree, ``leaf``, ``subroot``,
    ``root`` and ``witness`` (a side byte and a digest per level, see ``steps``).
    """
    names = list(dict.fromkeys([tree, *order, *carry]))
    inner = {c: f"_c{i}" for i, c in enumerate(names)}
    rows = leaves.select(row_key(F.col(f"`{tree}`")).alias("_tree"), "digest", *[F.col(f"`{c}`").alias(inner[c]) for c in names])
    placed = stage(numbered(rows, [*[inner[c] for c in order], "digest"]), "placed")
    trees = placed.filter("pos = 0").select("_tree", F.col(inner[tree]).alias("_value"))
    out = _grow(placed, [inner[c] for c in carry], trees)
    return out.select(*[F.col(f"carry.{inner[c]}").alias(c) for c in carry], "pos", F.col("digest").alias("leaf"), "subroot", "root", "witness")


def checked(rows: DataFrame, leaf: str = "leaf", witness: str = "witness") -> DataFrame:
    """Add ``proof`` (hash of the siblings) and ``folded`` (the root that leaf and witness lead to)."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves, paths = (b.column(names.index(c)).to_pylist() for c in (leaf, witness))
            found = [(None, None) if x is None or w is None else (witness_digest(w), fold(x, w)) for x, w in zip(leaves, paths)]
            more = [pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*names, "proof", "folded"])

    extra = [T.StructField("proof", T.BinaryType()), T.StructField("folded", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *extra]))


def manifest(docs: DataFrame) -> DataFrame:
    """Witnesses of documents, one tree per ``lang``, with a tampered copy of the leaf where one is made.

    Gives doc_id, forged (null where nothing is changed), pos, leaf, subroot, root, witness.
    """
    cols = {c: F.col(c) for c in LEAF}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    forged = F.when(hit, leaf_digest(*(cols | {"n_chars": F.try_add(F.col("n_chars"), F.lit(1).cast("long"))}).values()))
    leaves = docs.select("doc_id", "lang", leaf_digest(*cols.values()).alias("digest"), forged.alias("forged"))
    return witnesses(leaves, "lang", ["doc_id"], ["doc_id", "forged"])


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest checked leaf by leaf: what the tampered leaf, else the leaf itself, folds to."""
    rows = manifest(docs).withColumn("tried", F.coalesce("forged", "leaf"))
    out = checked(rows, "tried")
    return out.withColumn("verified", F.col("folded") == F.col("root"))
