"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled documents, toxic and other. Every word
of theirs is a term, and so are beginnings of words and marks of repetition that
tell the classes apart; document frequencies are counted over all documents. A
term weighs its inverse document frequency times how far it tells the classes
apart (likelihood ratio over the examples, against what the best of so many terms
would reach by chance; ``FLOOR`` if not at all). Each text becomes a TF-IDF vector
over these terms, and its ``K`` nearest examples by cosine are found exactly in an
inverted index whose postings are cut into blocks of examples, each with its
largest weight per term. The query's bound of a block is the sum of its weights
times these maxima; blocks are visited from the largest bound on, and the rest
are skipped once the bound is below the K-th best cosine.

The neighbours vote by closeness. A logistic curve fitted on the votes that the
examples get from each other turns votes into chances; texts with no term of the
examples have no neighbours and get the share of toxic ones among such examples.
Sampling of examples is by class, so votes are weighed back to the classes' true
shares.

Defined results: null and empty texts have no words; texts of any length are read
whole, a megabyte at a time; labels that disagree count as toxic; of rows with
one id the smallest text is the example; null labels and ids teach nothing; ties
among neighbours go to the example that comes first; repeated rows are repeated;
further columns are not read; without labels of both kinds every score is the
share of toxic labels, 0 if there are none; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_BYTES, pieces, small_batches
from tidemark.llm.quality import fit_curve
from tidemark.session import stage

EXAMPLES = 3000  # of each class at most
DERIVED = 4096  # beginnings and marks at most, those that tell most
MARGIN = 4.0
SEEN = 3  # examples a term must be in to tell the classes apart
K = 15
BLOCK = 64
FLOOR = 0.03  # weight of a term that tells nothing of the classes
HELD_OUT = 5
PREFIXES = (4, 5, 6, 7)  # bytes
TIMES = (1, 2, 3)
FIRST_BLOCKS = 16  # visited at once, then all that can hold a better example
OFTEN = 8  # a frequent term is in one of so many examples
TOGETHER = 64  # texts whose frequent terms are multiplied at once


def terms(word: bytes) -> list[bytes]:
    """The terms of a word: the word itself and its beginnings, which inflected and compound forms share."""
    return [word, *[b"^" + word[:n] for n in PREFIXES if len(word) >= n]]


def repeated(term: bytes, times: int) -> bytes:
    """The term that stands for ``term`` being there at least so often; a word that recurs tells more than one slip."""
    return term if times == 1 else b"%s#%d" % (term, times)


def text_terms(text: str | None) -> set[bytes]:
    """All terms of a text."""
    counts: Counter = Counter()
    for piece in pieces((text or "").encode().translate(WORD_BYTES), b" "):
        for word, n in Counter(piece.split()).items():
            for t in terms(word):
                counts[t] += n
    return {repeated(t, k) for t, n in counts.items() for k in TIMES if n >= k}


class Vocabulary:
    """Numbers of the terms."""

    def __init__(self, chosen: list[bytes]):
        self.size = len(chosen)
        self.plain: dict[bytes, int] = {}  # word -> number
        self.derived: dict[bytes, list[tuple[int, int]]] = {}  # beginning or repeated term -> (times, number)
        for i, t in enumerate(chosen):
            base, mark, times = t.partition(b"#")
            if mark or t.startswith(b"^"):
                self.derived.setdefault(base, []).append((int(times or 1), i))
            else:
                self.plain[t] = i
        self.heads = {t[1:1 + PREFIXES[0]] for t in self.derived if t.startswith(b"^")}

    def __len__(self) -> int:
        return self.size

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text, by number, and how often each is in it."""
        found: Counter = Counter()
        for piece in pieces((text or "").encode().translate(WORD_BYTES), b" "):
            found.update(piece.split())
        words = np.fromiter(map(self.plain.get, found, repeat(-1)), np.int64, len(found))
        times = np.fromiter(found.values(), np.int64, len(found))
        some = words >= 0
        derived: Counter = Counter()
        for word in found:
            if word[:PREFIXES[0]] in self.heads or word in self.derived:
                for t in terms(word):
                    derived[t] += found[word]
        extra = {i: n if least == 1 else 1 for t, n in derived.items() for least, i in self.derived.get(t, ()) if n >= least}
        return np.r_[words[some], np.array(list(extra), np.int64)], np.r_[times[some], np.array(list(extra.values()), np.int64)]


def spans(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans that start at ``at``, one span after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + sizes, sizes)


@dataclass
class Index:
    """Block-max inverted index of examples (unit TF-IDF vectors).

    A cell is the postings of one term in one block; empty cells are not kept.
    Terms that one in ``OFTEN`` examples holds or more stand in a matrix instead;
    their part of the cosine is computed at once for some texts and all examples.
    """

    idf: np.ndarray  # weight of a term
    example: np.ndarray  # postings by term, then example
    weight: np.ndarray
    cell_at: np.ndarray  # first posting of a cell
    cell_block: np.ndarray
    cell_max: np.ndarray  # largest weight in a cell
    term_at: np.ndarray  # first cell of a term
    n_blocks: int
    row: np.ndarray  # of a term in the matrix, -1 if it is not there
    matrix: np.ndarray  # frequent terms by examples
    ids: np.ndarray
    toxic: np.ndarray
    prior: np.ndarray  # weight of an example of its class
    k: int = K
    block: int = BLOCK

    @classmethod
    def build(cls, vectors: list[tuple], idf: np.ndarray, ids, toxic: np.ndarray, prior: np.ndarray, k: int = K, block: int = BLOCK) -> Index:
        rows = [unit_vector(v, idf) for v in vectors]
        n_blocks = max(1, -(-len(rows) // block))
        word = np.concatenate([w for w, _ in rows] or [np.zeros(0, np.int64)])
        weight = np.concatenate([x for _, x in rows] or [np.zeros(0)])
        example = np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows])
        by = np.lexsort((example, word))
        word, weight, example = word[by], weight[by], example[by]
        frequent = np.flatnonzero(np.bincount(word, minlength=len(idf)) * OFTEN >= max(len(rows), 1))
        row = np.full(len(idf), -1, np.int32)
        row[frequent] = np.arange(len(frequent))
        matrix = np.zeros((len(frequent), len(rows)))
        dense = row[word] >= 0
        matrix[row[word[dense]], example[dense]] = weight[dense]
        word, weight, example = word[~dense], weight[~dense], example[~dense]
        cells, first = np.unique(word * n_blocks + example // block, return_index=True)
        cell_max = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        term_at = np.searchsorted(cells // n_blocks, np.arange(len(idf) + 1))
        return cls(
            idf, example.astype(np.int32), weight.astype(np.float32), np.append(first, len(word)).astype(np.int32), (cells % n_blocks).astype(np.int32), cell_max.astype(np.float32), term_at.astype(np.int32), n_blocks, row, matrix,
            np.asarray(ids), toxic, prior, k=k, block=block,
        )

    def search(self, counts: list[tuple], skips: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """``nearest`` of each text, from (terms, counts)."""
        for at in range(0, len(counts), TOGETHER):
            vectors = [unit_vector(c, self.idf) for c in counts[at:at + TOGETHER]]
            frequent = np.zeros((len(vectors), len(self.matrix)))
            for i, (words, weights) in enumerate(vectors):
                rows = self.row[words]
                frequent[i, rows[rows >= 0]] = weights[rows >= 0]
            for i, (v, known) in enumerate(zip(vectors, frequent @ self.matrix)):
                yield self.nearest(*v, known, skips[at + i] if skips else -1)

    def nearest(self, words: np.ndarray, weights: np.ndarray, known: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """The k examples with the largest cosine above 0, the cosines, and the blocks visited.

        ``known`` is the frequent terms' part of the cosine with each example.
        """
        best, cosine, visited = np.zeros(0, np.int64), np.zeros(0), 0
        if not len(words) or not len(known):
            return best, cosine, visited
        rare = self.row[words] < 0
        words, weights = words[rare], weights[rare]
        n_cells = self.term_at[words + 1] - self.term_at[words]
        cells, x = spans(self.term_at[words], n_cells), np.repeat(weights, n_cells)
        block = self.cell_block[cells]
        bound = np.bincount(block, x * self.cell_max[cells], self.n_blocks) + np.maximum.reduceat(known, np.arange(0, len(known), self.block))
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        place = np.full(self.n_blocks, self.n_blocks)
        place[order] = np.arange(len(order))
        at, at_example = place[block], np.repeat(place, self.block)[:len(known)]
        stop = FIRST_BLOCKS
        while visited < len(order):
            if len(best) == self.k:  # what is left of the blocks that can hold a better one
                stop = int(np.count_nonzero(bound[order] >= cosine[-1] - 1e-6))
                if stop <= visited:
                    break
            mine = np.flatnonzero((at >= visited) & (at < stop))
            first = self.cell_at[cells[mine]]
            sizes = self.cell_at[cells[mine] + 1] - first
            postings = spans(first, sizes)
            sums = np.bincount(self.example[postings], np.repeat(x[mine], sizes) * self.weight[postings], len(known)) + known
            sums[(at_example < visited) | (at_example >= stop)] = 0
            if skip >= 0:
                sums[skip] = 0
            some = np.flatnonzero(sums > (cosine[-1] - 1e-9 if len(best) == self.k else 0))
            if len(some) > 8 * self.k:  # no more than ties can be among the best
                some = some[sums[some] >= np.partition(sums[some], -self.k)[-self.k] - 1e-9]
            ids, cs = np.r_[best, some], np.r_[cosine, sums[some]]
            top = np.lexsort((ids, -np.round(cs, 10)))[:self.k]
            best, cosine = ids[top], cs[top]
            visited = min(stop, len(order))
            stop = 2 * visited
        return best, cosine, visited

    def votes(self, counts: list[tuple], skips: list[int] | None = None) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """Share of toxic among the nearest by closeness and class share, and the neighbours; None without any."""
        for near, cosine, _ in self.search(counts, skips):
            w = cosine * self.prior[near] / np.maximum(1 - cosine, 0.05)
            yield (float((w * self.toxic[near]).sum() / w.sum()) if len(near) else None), near, cosine


def calibrated(votes: list[float | None], toxic: np.ndarray, prior: np.ndarray) -> tuple[tuple[float, float], float]:
    """The curve from votes to chances, and the score of texts without neighbours."""
    curve = 0.0, 0.0
    some = np.array([v is not None for v in votes], bool)
    repeats = np.maximum(np.round(prior / max(prior.min(initial=1.0), 1e-9)), 1).astype(int)
    if some.any():
        x, y, r = np.array([v for v in votes if v is not None]), toxic[some].astype(float), repeats[some]
        curve = fit_curve(np.repeat(x, r), np.repeat(y, r))
    total = prior[~some].sum()
    share = (prior * toxic).sum() / max(prior.sum(), 1e-9)
    return curve, float((prior * toxic)[~some].sum() / total) if total else float(share)


def chance(vote: float | None, curve: tuple[float, float], none: float) -> float:
    return none if vote is None else float(1 / (1 + np.exp(-np.clip(curve[0] * vote + curve[1], -30, 30))))


def unit_vector(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms, ascending, and weights of a TF-IDF vector of length 1, from (terms, counts)."""
    words, times = counts
    w = (1 + np.log(times)) * idf[words]
    by = np.argsort(words)
    by = by[w[by] > 0]
    w = w[by]
    return words[by], w / np.sqrt((w * w).sum()) if len(w) else w


def held_out(id_col, parts: int = HELD_OUT):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == 0, F.lit(False))


def _examples(texts: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """Sampled examples (id, text, toxic) and the labelled rows of each class."""
    known = labels.select(F.col("doc_id").alias("id"), "toxic").filter("id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = stage(known.select("id", (F.col("toxic") > 0).cast("int").alias("toxic")), "labels")
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64("id", F.lit("example"))
    picked = [known.filter(F.col("toxic") == c).orderBy(order, "id").limit(most) for c in (0, 1)]
    rows = texts.join(F.broadcast(picked[0].union(picked[1])), "id")  # 2 * most rows of two numbers
    return stage(rows.groupBy("id", "toxic").agg(F.min("text").alias("text")).select("id", "text", "toxic"), "examples"), sizes


def _vocabulary(examples: DataFrame, derived: int, margin: float) -> tuple[list[bytes], np.ndarray]:
    """All words of the examples and the derived terms that tell the classes apart, and the weight of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list(text_terms(text))
                plain = [not t.startswith(b"^") and b"#" not in t for t in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.binary()), pa.array([toxic] * len(found), pa.int32()), pa.array(plain, pa.bool_())], names=["word", "toxic", "plain"]
                )

    sizes = {r[0]: r[1] for r in examples.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return [], np.zeros(0)
    seen = examples.select("text", "toxic").mapInArrow(run, "word binary, toxic int, plain boolean")
    seen = seen.groupBy("word", "plain").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("n"))
    seen = stage(seen.filter((F.col("n") >= SEEN) | F.col("plain")), "terms")
    share = n1 / (n0 + n1)
    a, b, n = F.col("a"), F.col("n") - F.col("a"), F.col("n")

    def part(observed, expected):
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    inside = part(a, n * share) + part(b, n * (1 - share))
    outside = part(n1 - a, (n0 + n1 - n) * share) + part(n0 - b, (n0 + n1 - n) * (1 - share))
    bar = 2 * math.log(max(seen.filter(n >= SEEN).count(), 1)) + margin
    told = seen.withColumn("told", F.when(n >= SEEN, 2 * (inside + outside) / bar).otherwise(0.0)).select("word", "plain", "told")
    best = told.filter(~F.col("plain") & (F.col("told") >= 1)).orderBy(F.desc("told"), "word").limit(derived)
    got = told.filter("plain").union(best).orderBy("word").toArrow()  # as many rows as the examples have words
    return got.column("word").to_pylist(), FLOOR + (1 - FLOOR) * np.clip(got.column("told").to_numpy(), 0, 1) ** 2


def _document_frequency(texts: DataFrame, shared: Broadcast) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents, counted over the whole table."""
    size = len(shared.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                df[shared.value.counts(text)[0]] += 1
            df[-1] += b.num_rows
        met = np.flatnonzero(df)
        for at in range(0, len(met), 10_000):
            m = met[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(df[m])], names=["word", "n"])

    rows = texts.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, np.int64)
    df[rows.column("word").to_numpy()] = rows.column("n").to_numpy()
    return df[:-1], int(df[-1])


def _votes(rows: DataFrame, vocabulary: Broadcast, shared: Broadcast) -> list[float | None]:
    """The vote on each example, itself left out, computed in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        place = {v: i for i, v in enumerate(index.ids)}
        for b in batches:
            at = [place[v] for v in b.column(0).to_pylist()]
            votes = [v for v, _, _ in index.votes([vocabulary.value.counts(t) for t in b.column(1).to_pylist()], at)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(votes, pa.float64())], names=["at", "vote"])

    got = rows.select("id", "text").repartition("id").mapInArrow(run, "at bigint, vote double").collect()
    return [r["vote"] for r in sorted(got, key=lambda r: r["at"])]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES,
    derived: int = DERIVED, margin: float = MARGIN, k: int = K,
) -> tuple[Broadcast, Broadcast, tuple[float, float], float]:
    """Vocabulary, index, curve and the score of texts without neighbours; what reaches the driver is bounded by the examples' texts."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, sizes = _examples(texts, labels, examples)
    chosen, told = _vocabulary(rows, derived, margin)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(chosen))
    df, n = _document_frequency(texts, shared)
    idf = (np.log((1 + n) / (1 + df)) + 1) * told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [shared.value.counts(t) for t in b.column(1).to_pylist()]
            lists = [pa.array([c[i] for c in counts], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *lists], names=["id", "toxic", "words", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, toxic int, words array<int>, counts array<int>").toArrow()
    vectors = [(w.values.to_numpy(), c.values.to_numpy()) for w, c in zip(got.column("words"), got.column("counts"))]
    ids, toxic = got.column("id").to_pylist(), got.column("toxic").to_numpy().astype(np.int64)
    # like examples share blocks, so bounds are tight: those of the same heaviest terms
    order = sorted(range(len(ids)), key=lambda i: (vectors[i][0][np.lexsort((vectors[i][0], -idf[vectors[i][0]]))[:3]].tolist(), str(ids[i])))
    vectors, ids, toxic = [vectors[i] for i in order], [ids[i] for i in order], toxic[order]
    share = {c: sizes.get(c, 0) / max(int((toxic == c).sum()), 1) for c in (0, 1)}
    prior = np.where(toxic == 1, share[1], share[0]).astype(float)
    index = Index.build(vectors, idf, ids, toxic, prior, k)
    index = docs.sparkSession.sparkContext.broadcast(index)
    curve, none = calibrated(_votes(rows, shared, index), toxic, prior)
    return shared, index, curve, none


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, score, evidence) per document; evidence lists the nearest examples: their ids, cosines and labels."""
    vocabulary, index, curve, none = train(docs, labels, id_col, text_col, **options)
    kind = docs.schema[id_col].dataType
    entry = pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ix = vocabulary.value, index.value
        names = [str(i) for i in ix.ids]
        for b in batches:
            scores, evidence = [], []
            for vote, near, cosine in ix.votes([known.counts(t) for t in b.column(1).to_pylist()]):
                scores.append(chance(vote, curve, none))
                evidence.append([{"id": names[i], "cosine": c, "toxic": y} for i, c, y in zip(near, cosine.tolist(), ix.toxic[near].tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(entry))], names=["id", "score", "evidence"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {kind.simpleString()}, score double, evidence array<struct<id: string, cosine: double, toxic: int>>")
