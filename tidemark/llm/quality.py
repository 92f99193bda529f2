"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are compared: the target model counts
the unigrams and bigrams of documents labelled good, the raw model those of all
documents. A document's log weight is the mean log ratio of its n-grams, shrunk
for short texts and scaled to a text of ``LENGTH`` n-grams. Documents are then
drawn without replacement in proportion to their weights: Gumbel noise is added
to the log weights and the largest k are kept (Gumbel top-k).

k is given, or is the number of documents whose chance to be good, by a
logistic curve fitted on labelled documents, is at least ``LEAST``. The k-th
largest value is found by histograms that narrow down on it, so no rows are
sorted or gathered.

The raw model counts all documents; the target model those of at most ``LABELS``
labels, taken by a hash of their ids, whose ids are broadcast, so texts are never
shuffled. Only the models of ``2 * BUCKETS`` counts and the scores of these
labels reach the driver. Words are split at white space and keep their case
and signs.

Defined results: null text is empty; a text without n-grams has log weight 0;
rows without id take their noise from the text; equal rows stay or go together,
so k may be passed by rows that tie with the last; with no good label the
weights are all equal and everything is kept; an empty table gives an empty
result; further columns are passed on by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ROW, packed, pieces, small_batches, uniform
from tidemark.session import stage

BUCKETS = 1 << 16
SMOOTHING = 1.0
SHRINK = 8  # n-grams of weight 0 added to every text
LENGTH = 64
LEAST = 0.1
LABELS = 50_000  # labelled documents at most, good and bad, that the target model and the curve are fitted on
BINS = 4096
HELD_OUT = 5  # labels of documents with crc32(id) mod 5 = 0 are left for tests


def ngram_buckets(text: str | None, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the unigrams (from 0) and bigrams (from ``buckets``) of a text, piece by piece."""
    last = None
    for piece in pieces((text or "").encode()):
        words = piece.split()
        h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        if not len(h):
            continue
        pairs = h if last is None else np.r_[last, h]
        mixed = (pairs[:-1] * np.uint64(0x9E3779B97F4A7C15) + pairs[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
        yield np.concatenate([h % np.uint64(buckets), mixed % np.uint64(buckets) + np.uint64(buckets)]).astype(np.int64)
        last = h[-1:]


def _counts(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n_raw, n_good) of texts (text, good): each task sends a row per bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 2 * buckets), np.int64)
        for b in batches:
            for text, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for found in ngram_buckets(text, buckets):
                    n = np.bincount(found, minlength=1)
                    counts[0, :len(n)] += n
                    if good:
                        counts[1, :len(n)] += n
        met = np.flatnonzero(counts[0])
        for at in range(0, len(met), 10_000):
            m = met[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(counts[0, m]), pa.array(counts[1, m])], names=["bucket", "n_raw", "n_good"])

    part = texts.mapInArrow(run, "bucket bigint, n_raw bigint, n_good bigint")
    return part.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_good").alias("n_good"))


def log_ratios(raw: np.ndarray, good: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p(target) - log p(raw) per bucket, unigrams and bigrams as models of their own."""
    out = np.zeros(len(raw))
    if not good.sum():
        return out
    half = len(raw) // 2
    for s in (slice(0, half), slice(half, None)):
        p = lambda n: np.log((n[s] + smoothing) / (n[s].sum() + smoothing * half))
        out[s] = p(good) - p(raw)
    return out


@dataclass
class Models:
    """Counts of the raw and the target model, unigrams and bigrams as models of their own."""

    raw: np.ndarray
    good: np.ndarray
    ratios: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, good: np.ndarray) -> Models:
        return cls(raw, good, log_ratios(raw, good))

    def log_weight(self, text: str | None, labelled_good: bool = False, shrink: int = SHRINK, length: int = LENGTH) -> float:
        """Log weight of a text; one that the target model was fitted on is judged by the model without it."""
        total, n, size = 0.0, shrink, len(self.raw)
        own = np.zeros(size, np.int64) if labelled_good else None
        for found in ngram_buckets(text, size // 2):
            n += len(found)
            if own is None:
                total += float(self.ratios[found].sum())
            else:
                own += np.bincount(found, minlength=size)
        if own is not None:
            m = np.flatnonzero(own)
            second = m >= size // 2
            sums = np.array([self.good[:size // 2].sum(), self.good[size // 2:].sum()])
            rest = sums - np.array([own[:size // 2].sum(), own[size // 2:].sum()])
            p = (self.good[m] - own[m] + SMOOTHING) / (rest[second.astype(int)] + SMOOTHING * size / 2)
            q = (self.good[m] + SMOOTHING) / (sums[second.astype(int)] + SMOOTHING * size / 2)
            total = float((own[m] * (self.ratios[m] + np.log(p) - np.log(q))).sum())
        return length * total / n


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a little ridge."""
    if not len(x) or y.min() == y.max():
        return 0.0, 30.0 if not len(x) or y.min() else -30.0
    w, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def labels_of(labels: DataFrame, label: str, held_out: int = HELD_OUT, most: int = LABELS) -> DataFrame:
    """(label_id, good): ids that are not held out, ``most`` at most; of labels that disagree the least counts."""
    rows = labels.select(F.col("doc_id").alias("label_id"), F.col(label).alias("good")).filter("label_id is not null and good is not null")
    rows = rows.filter(F.crc32(F.col("label_id").cast("string").cast("binary")) % held_out != 0)
    rows = rows.groupBy("label_id").agg(F.min("good").cast("int").alias("good"))
    return stage(rows.orderBy(F.xxhash64("label_id"), "label_id").limit(most), "labels")


class Resampler:
    """Models, curve and threshold, fitted on documents and labels."""

    def __init__(self, docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS):
        spark = docs.sparkSession
        small_batches(spark)
        self.known = labels_of(labels, "quality")
        self.id_col, self.text_col = id_col, text_col
        marked = self._marked(docs.select(id_col, text_col))
        counts = np.zeros((2, 2 * buckets), np.int64)
        for bucket, raw, good in _counts(marked.select("_text", F.col("_good") == 1), buckets).collect():  # 2 * buckets rows at most
            counts[:, bucket] = raw, good
        self.models = spark.sparkContext.broadcast(Models.of(counts[0], counts[1]))
        scored = self._weighed(marked, [id_col, "_good", "_key"])
        self.scores = stage(scored.withColumnRenamed(id_col, "id"), "weights")
        fit = self.scores.filter("_good is not null").select("log_weight", "_good", "_key").distinct()
        fit = fit.orderBy(F.xxhash64("_key"), "_key").limit(LABELS).collect()  # an id may have many rows
        self.curve = fit_curve(np.array([r[0] for r in fit]), np.array([float(r[1]) for r in fit]))
        self.k = self.scores.filter(self.chance() >= LEAST).count() if k is None else k
        self.least = kth_largest(self.scores.select(self.noisy().alias("value")), self.k) if self.k else None

    def _marked(self, docs: DataFrame) -> DataFrame:
        """The documents' columns, _text, _key of id and text, and _good, the label that teaches."""
        ids = F.broadcast(self.known.select(F.col("label_id").alias("_label_id"), F.col("good").alias("_good")))
        rows = docs.join(ids, F.col(self.id_col) == F.col("_label_id"), "left").drop("_label_id")
        return rows.withColumn("_key", F.xxhash64(self.id_col, self.text_col)).withColumn("_text", F.col(self.text_col))

    def _weighed(self, marked: DataFrame, carry: list[str]) -> DataFrame:
        """``carry`` and log_weight."""
        models = self.models
        n = len(carry)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = [models.value.log_weight(t, g == 1) for t, g in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(w, pa.float64())], names=[*carry, "log_weight"])

        rows = marked.select(*carry, F.col("_text").alias("_t"), F.col("_good").alias("_g"))
        return rows.mapInArrow(run, T.StructType([*[marked.schema[c] for c in carry], T.StructField("log_weight", T.DoubleType())]))

    def chance(self) -> Column:
        """The chance to be good by the curve."""
        slope, offset = self.curve
        return 1 / (1 + F.exp(-(F.col("log_weight") * slope + offset)))

    def noisy(self) -> Column:
        """The log weight with Gumbel noise."""
        return F.col("log_weight") - F.log(-F.log((uniform(F.col("_key"), F.lit("gumbel")) * (1 - 2e-12)) + 1e-12))

    def kept(self) -> Column:
        return F.lit(False) if self.least is None else self.noisy() >= self.least

    def result(self) -> DataFrame:
        """(id, log_weight, p_good, noisy, kept) per document."""
        return self.scores.select("id", "log_weight", self.chance().alias("p_good"), self.noisy().alias("noisy"), self.kept().alias("kept"))

    def drawn(self, docs: DataFrame) -> DataFrame:
        """The documents that are kept, with all their columns; they are weighed again where they lie."""
        rows = self._marked(packed(docs, self.id_col, self.text_col))
        return self._weighed(rows, [ROW, "_key"]).filter(self.kept()).select(f"{ROW}.*")


def kth_largest(values: DataFrame, k: int, bins: int = BINS) -> float | None:
    """The k-th largest of (value), by histograms of ``bins`` rows that narrow down on it."""
    low, high = values.agg(F.min("value"), F.max("value")).first()
    while low is not None and low < high:
        width = (high - low) / bins
        if low + width <= low:
            break
        inside = values.filter(F.col("value").between(low, high))
        at = F.least(F.floor((F.col("value") - low) / width), F.lit(bins - 1))
        rows = sorted(inside.groupBy(at.alias("bin")).agg(F.count("*"), F.min("value"), F.max("value")).collect(), reverse=True)
        for _, n, least, most in rows:
            if k <= n:
                low, high = least, most
                break
            k -= n
        if k == 1:
            return high
    return low


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(id, log_weight, p_good, noisy, kept) per document."""
    return Resampler(docs, labels, **options).result()


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents drawn, with all their columns."""
    return Resampler(docs, labels, **options).drawn(docs)
