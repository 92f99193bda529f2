"""Importance resampling towards a target distribution, counted by distinct lines.

Features are the runs of one and two words of a text, hashed into ``BUCKETS``. The
gain of a bucket is the log ratio of its smoothed share among the features of the
target texts and of all texts. A document's weight is the mean gain of its
features; with Gumbel noise added, the largest scores are a draw without
replacement.

Counting (segment deduplication): line feeds cut texts into lines, and a line is
taken as its sequence of words. Each task hands on the different lines it met with
their counts; a shuffle by line leaves every distinct line once, with its
occurrences over the corpus. Its features are counted once and multiplied by them.
Runs that cross from a line to the next one with words belong to no line; they are
counted where the text is read and go along in the same shuffle as (bucket,
count). Line, count and bucket rows meet with map-side combining, so a line that
every text holds is one row per task.

Only the counts of the buckets reach the driver, ``BUCKETS`` rows at most. Scores
are computed where the texts lie; the rank is a sort by ranges with one row per
range carrying the numbers on.

Defined results: null and empty texts have no words, no features and weight 0; a
null id draws its noise from ``7:`` alone and comes last in ties; equal rows take
consecutive ranks; an empty corpus gives an empty result; without target texts
the gains follow from smoothing alone; a text of one long line is one segment;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_BYTES, numbered, pieces, small_batches
from tidemark.session import stage

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25  # of the documents of LEAST_WORDS words and more
LINES = 1 << 14  # different lines a task holds before it hands them on
LINE_BYTES = 4 << 20
WORDS = 1 << 17  # of lines whose features are counted at once

KEEP_LINES = WORD_BYTES[:10] + b"\n" + WORD_BYTES[11:]
# CRC-32 table of the reversed polynomial, to append a space to many checksums at once
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1)


def lines_of(text: str | None) -> list[list[bytes]]:
    """The words of each line that has any."""
    found = map(bytes.split, (text or "").encode().translate(KEEP_LINES).split(b"\n"))
    return [words for words in found if words]


def word_sums(words: list[bytes]) -> np.ndarray:
    """CRC-32 of each word."""
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def pair_sums(first: np.ndarray, second: list[bytes]) -> np.ndarray:
    """CRC-32 of pairs joined by a space, from the checksums of their first words."""
    open_ = first ^ np.uint32(0xFFFFFFFF)
    spaced = (_TABLE[(open_ ^ np.uint32(32)) & np.uint32(255)] ^ (open_ >> np.uint32(8))) ^ np.uint32(0xFFFFFFFF)
    return np.fromiter(map(zlib.crc32, second, spaced.tolist()), np.uint32, len(second))


def _segments(texts: DataFrame, buckets: int) -> DataFrame:
    """(line, bucket, n): different lines with their counts, and counts of runs that cross lines, of (text)."""
    names = ["line", "bucket", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crossing, lines, held = np.zeros(buckets, np.int64), Counter(), 0

        def flush() -> pa.RecordBatch:
            n = len(lines)
            out = [pa.array(lines.keys(), pa.binary()), pa.nulls(n, pa.int32()), pa.array(lines.values(), pa.int64())]
            lines.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        for b in batches:
            for text in b.column(0).to_pylist():
                found = lines_of(text)
                if len(found) > 1:
                    sums = pair_sums(word_sums([w[-1] for w in found[:-1]]), [w[0] for w in found[1:]])
                    crossing += np.bincount(sums % np.uint32(buckets), minlength=buckets)
                for words in found:
                    line = b" ".join(words)
                    held += 0 if line in lines else len(line)
                    lines[line] += 1
                if len(lines) >= LINES or held >= LINE_BYTES:
                    yield flush()
                    held = 0
        yield flush()
        met = np.flatnonzero(crossing)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(met), pa.binary()), pa.array(met, pa.int32()), pa.array(crossing[met])], names=names)

    return texts.mapInArrow(run, "line binary, bucket int, n long")


def _line_features(segments: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) per task of distinct segments: the features of a line, once, times its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            line, bucket, n = b.column(0), b.column(1), b.column(2).to_numpy()
            crossing = bucket.is_valid().to_numpy(zero_copy_only=False)
            np.add.at(counts, bucket.filter(pa.array(crossing)).to_numpy(), n[crossing])
            words, lengths, times = [], [], []
            for text, k in zip(line.filter(pa.array(~crossing)).to_pylist(), n[~crossing].tolist()):
                last = None
                for piece in pieces(text, b" "):  # a long line piece by piece
                    found = piece.split()
                    if last:
                        counts[pair_sums(word_sums(last), found[:1])[0] % np.uint32(buckets)] += k
                    words += found
                    lengths.append(len(found))
                    times.append(k)
                    last = found[-1:]
                    if len(words) >= WORDS:
                        _count_lines(words, lengths, times, counts)
                        words, lengths, times = [], [], []
            _count_lines(words, lengths, times, counts)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met])], names=["bucket", "n"])

    return segments.mapInArrow(run, "bucket int, n long")


def _count_lines(words: list[bytes], lengths: list[int], times: list[int], counts: np.ndarray) -> None:
    """Add the features of segments, given as words one after another, their numbers of words and their occurrences."""
    nth, sums, size = np.repeat(np.arange(len(lengths)), lengths), word_sums(words), np.uint32(len(counts))
    times = np.repeat(np.array(times, np.int64), lengths)
    counts += _summed(sums % size, times, len(counts))
    inside = nth[1:] == nth[:-1]
    pairs = pair_sums(sums[:-1], words[1:])
    counts += _summed(pairs[inside] % size, times[1:][inside], len(counts))


def _summed(buckets: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """Whole sums of ``times`` per bucket; lines that occur once are counted, the others added."""
    once = times == 1
    out = np.bincount(buckets[once], minlength=size)
    np.add.at(out, buckets[~once], times[~once])
    return out


def bucket_counts(texts: Column, rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket."""
    distinct = _segments(rows.select(texts), buckets).groupBy("line", "bucket").agg(F.sum("n").alias("n"))
    parts = _line_features(distinct, buckets).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.collect():  # at most one row per bucket
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000-fold log ratios of the smoothed shares per bucket."""
    s, t, size = raw.astype(np.float64), target.astype(np.float64), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weight(text: str | None, gain: np.ndarray) -> tuple[int, int]:
    """(features, floored mean gain) of a whole text, piece by piece."""
    total, n, size, last = 0, 0, np.uint32(len(gain)), None
    for piece in pieces((text or "").encode().translate(WORD_BYTES), b" "):
        words = piece.split()
        if not words:
            continue
        sums = word_sums(words)
        pairs = pair_sums(sums[:-1], words[1:]) if last is None else pair_sums(np.r_[last, sums[:-1]], words)
        total += int(gain[sums % size].sum()) + int(gain[pairs % size].sum())
        n += len(sums) + len(pairs)
        last = sums[-1:]
    return n, total // n if n else 0


def _weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_features, weight) of (id, text)."""
    known = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [weight(t, known.value) for t in b.column(1).to_pylist()]
            n, w = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), n, w], names=["id", "n_features", "weight"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Floored 1000-fold Gumbel noise of an id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text",
    buckets: int = BUCKETS,
) -> DataFrame:
    """(id, n_features, weight, score, rank) per document; rank is null where a document is not drawn."""
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").alias("text")
    gain = gains(bucket_counts(text, docs, buckets), bucket_counts(text, target, buckets))
    weighed = _weighed(docs.select(F.col(f"`{id_col}`").alias("id"), text), gain)
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(F.col("id"))), "scores")
    fit = F.col("n_features") >= max(1, 2 * least_words - 1)  # w words are w runs of one and w - 1 of two
    order = {"_down": -F.col("score"), "_no_id": F.col("id").isNull()}
    placed = numbered(scored.filter(fit).withColumns({"_tree": F.lit(""), **order}), [*order, "id"])
    drawn = F.col("pos") < F.floor(F.col("size") * percent / 100)
    ranked = placed.withColumn("rank", F.when(drawn, F.col("pos") + 1))
    cols = ["id", "n_features", "weight", "score", "rank"]
    return ranked.select(*cols).unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")).select(*cols))
