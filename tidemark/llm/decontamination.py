"""Benchmark decontamination with suffix arrays over the training text.

Documents are cut into words. A task gathers the words of its documents into
shards of bounded size and builds a suffix array of each by prefix doubling.
Every suffix of every benchmark item is then binary-searched in it: all suffixes
at once, word by word comparison of the probed places. The places where a whole
window matches form one interval of the array, which gives their documents and
positions; the match at each place of it is followed to its end, which gives each
document its longest verbatim match.

Only places that can match need sorting: a window lies inside a run of words that
the benchmark has, so places in runs shorter than the shortest window are left
out of the array. No match is lost.

Benchmark items are broadcast in blocks of at most ``BLOCK_BYTES``; each block is
one pass in the same stage, and passes add up per document. Long texts are cut
into overlapping shards, so memory is bounded by the shard and the row.

Defined results: null or wordless text has no words and no hits; an item
without text has no window, one without id is found but not named; equal items count by their ids; repeated rows are repeated; empty
tables give no hits; further columns are passed on or ignored, those named like
a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD_BYTES, pieces, replace_columns, small_batches

WINDOW = 13
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 1 << 20
SHARE = 20  # a document is contaminated if SHARE * hit words >= words

FOUND = "n_words bigint, hits array<struct<first: int, last: int>>, items array<string>, longest int, longest_at int, longest_item string"


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text in pieces: ASCII letters and digits, lower-cased, and all non-ASCII characters."""
    for piece in pieces((text or "").encode().translate(WORD_BYTES), b" "):
        yield piece.split()


def word_ids(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of the words of a text, -1 for those the vocabulary lacks."""
    found = [np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words)) for words in words_of(text)]
    return found[0] if len(found) == 1 else np.concatenate(found)


@dataclass
class Suffixes:
    """All suffixes of a block of items: words one after another, an end mark after each item."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    starts: np.ndarray  # first word of each suffix
    lengths: np.ndarray  # its words
    windows: np.ndarray  # words of the window that begins there, 0 if none does
    item: np.ndarray
    names: list[str | None]

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int) -> Suffixes:
        vocabulary: dict[bytes, int] = {}
        words, starts, lengths, windows, item, at = [], [], [], [], [], 0
        for k, (_, text) in enumerate(items):
            ids = [vocabulary.setdefault(w, len(vocabulary)) for part in words_of(text) for w in part]
            n = len(ids)
            words.append(np.array([*ids, -2], np.int32))
            starts.append(at + np.arange(n))
            lengths.append(n - np.arange(n))
            size = min(window, n)
            windows.append(np.where(np.arange(n) <= n - size, size, 0))
            item.append(np.full(n, k))
            at += n + 1
        cat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        return cls(vocabulary, cat(words), cat(starts), cat(lengths), cat(windows), cat(item), [i for i, _ in items])


def indexed_places(words: np.ndarray, shortest: int) -> np.ndarray:
    """Places in runs of at least ``shortest`` words that the benchmark has (number 0 and up)."""
    edges = np.diff(np.r_[False, words >= 0, False].astype(np.int8))
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = end - first >= shortest
    first, length = first[long], (end - first)[long]
    return np.repeat(first - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())


def suffix_array(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of the words that follow them, by at least ``depth`` words.

    Prefix doubling: ranks by k words give ranks by 2k. Each run ends in a -1,
    the least of all; what comes after it does not matter to a search.
    """
    rank = np.r_[words, -1].astype(np.int64)
    order, k = places[np.argsort(rank[places], kind="stable")], 1
    while k < depth and len(order):
        high, low = rank[order], rank[np.minimum(order + k, len(words))]
        by = np.lexsort((low, high))
        order, high, low = order[by], high[by], low[by]
        new = np.cumsum(np.r_[False, (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        rank[order] = new
        if new[-1] == len(order) - 1:
            break
        k *= 2
    return order


def _common(words: np.ndarray, p: np.ndarray, test: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that the suffixes at p and q have in common, ``most`` at most."""
    n, active = np.zeros(len(p), np.int64), np.flatnonzero(most > 0)
    while len(active):
        same = words[p[active] + n[active]] == test[q[active] + n[active]]
        active = active[same]
        n[active] += 1
        active = active[n[active] < most[active]]
    return n


def _search(words: np.ndarray, order: np.ndarray, test: np.ndarray, q: np.ndarray, most: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all suffixes q at once, by their first ``most`` words: the first place not below, or above."""
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(order))
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) // 2
        p, qo = order[mid], q[open_]
        n = _common(words, p, test, qo, most[open_])
        equal = n >= most[open_]
        right = np.where(equal, after, words[p + n] < test[qo + n])
        low[open_] = np.where(right, mid + 1, low[open_])
        high[open_] = np.where(right, high[open_], mid)
        open_ = open_[low[open_] < high[open_]]
    return low


def search_shard(words: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Search a shard (word numbers, -1 between texts and last).

    Gives the words hit, pairs of (place, item) for the windows found, and the
    matches that cannot be longer, at every place, as (suffix, place, words).
    """
    hit, none = np.zeros(len(words), bool), np.zeros(0, np.int64)
    shortest = int(s.windows[s.windows > 0].min()) if len(s.windows) else 0
    places = indexed_places(words, shortest) if shortest else none
    if not len(places):
        return hit, none, none, (none, none, none)
    order = suffix_array(words, places, int(s.lengths.max()))
    at = _search(words, order, s.words, s.starts, s.lengths, after=False)
    best = np.zeros(len(at), np.int64)
    for side in (at - 1, at):
        ok = np.flatnonzero((side >= 0) & (side < len(order)))
        p = order[side[ok]]
        n = _common(words, p, s.words, s.starts[ok], s.lengths[ok])
        best[ok] = np.maximum(best[ok], n)
    found = np.flatnonzero((s.windows > 0) & (best >= s.windows))
    if not len(found):
        return hit, none, none, (none, none, none)
    size = s.windows[found]
    low = _search(words, order, s.words, s.starts[found], size, after=False)
    high = _search(words, order, s.words, s.starts[found], size, after=True)
    # equal windows share an interval; their places are marked once
    _, one = np.unique(np.stack([low, size]), axis=1, return_index=True)
    edge = np.zeros(len(words) + 1, np.int64)
    pairs = []
    for k in range(len(found)):
        p = order[low[k]:high[k]]
        pairs.append(np.stack([p, np.full(len(p), found[k])]))
    for k in one:
        p = order[low[k]:high[k]]
        np.add.at(edge, p, 1)
        np.add.at(edge, p + size[k], -1)
    hit = np.cumsum(edge[:-1]) > 0
    place, suffix = np.concatenate(pairs, axis=1)
    # a match that goes on to the left is a part of the longer one that begins there
    q = s.starts[suffix]
    begins = np.flatnonzero((place == 0) | (q == 0) | (words[place - 1] != s.words[q - 1]))
    length = _common(words, place[begins], s.words, q[begins], s.lengths[suffix[begins]])
    return hit, place, s.item[suffix], (suffix[begins], place[begins], length)


def _shards(docs: list[np.ndarray], overlap: int, size: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Parts (document, first word, words) in shards of about ``size`` words; parts of one text overlap."""
    shard, n = [], 0
    for d, ids in enumerate(docs):
        at = 0
        while at < len(ids):
            part = ids[at:at + max(size - n, 2 * overlap)]
            shard.append((d, at, part))
            n += len(part) + 1
            if n >= size:
                yield shard
                shard, n = [], 0
            if at + len(part) >= len(ids):
                break
            at += len(part) - overlap
    if shard:
        yield shard


def _spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Joined spans (first, last) in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def search_texts(texts: list[str | None], s: Suffixes, size: int = SHARD_WORDS) -> list[dict]:
    """Per text: n_words, spans of hit words, items with windows in it, its longest match of a window or more."""
    docs = [word_ids(t, s.vocabulary) for t in texts]
    out = [{"n_words": len(d), "hits": [], "items": set(), "longest": 0, "longest_at": None, "longest_item": None} for d in docs]
    overlap = int(s.lengths.max()) if len(s.lengths) else 0
    for shard in _shards(docs, overlap, size):
        words = np.concatenate([x for _, _, part in shard for x in (part, [-1])]).astype(np.int64)
        starts = np.cumsum([0] + [len(part) + 1 for _, _, part in shard])
        hit, place, item, (suffix, where, length) = search_shard(words, s)
        edges = np.diff(np.r_[False, hit, False].astype(np.int8))
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
        for a, b, k in zip(first, last, np.searchsorted(starts, first, side="right") - 1):
            d, at, _ = shard[k]
            out[d]["hits"].append((int(a - starts[k] + at), int(b - starts[k] + at)))
        for k, i in np.unique(np.stack([np.searchsorted(starts, place, side="right") - 1, item]), axis=1).T:
            if s.names[i] is not None:
                out[shard[k][0]]["items"].add(s.names[i])
        # each part keeps the longest of all its matches, of equal ones the first
        part = np.searchsorted(starts, where, side="right") - 1
        by = np.lexsort((suffix, where, -length, part))
        by = by[np.unique(part[by], return_index=True)[1]]
        for j, p, n, k in zip(suffix[by], where[by], length[by], part[by]):
            d, at, _ = shard[k]
            if n > out[d]["longest"]:
                out[d] |= {"longest": int(n), "longest_at": int(p - starts[k] + at), "longest_item": s.names[s.item[j]]}
    return out


def _pass(block, text_at: int, carried: list[int], names: list[str], first: bool, clean: bool):
    """One pass over the documents for a block of items; the last columns hold what earlier passes found."""
    kinds = [
        ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ("items", pa.list_(pa.string())), ("longest", pa.int32()), ("longest_at", pa.int32()), ("longest_item", pa.string()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = search_texts(b.column(text_at).to_pylist(), block.value)
            if not first:
                earlier = zip(*[b.column(b.num_columns - len(kinds) + k).to_pylist() for k in range(len(kinds))])
                for f, (_, hits, items, longest, at, item) in zip(found, earlier):
                    f["hits"] += [(h["first"], h["last"]) for h in hits]
                    f["items"] |= set(items)
                    if longest > f["longest"]:
                        f |= {"longest": longest, "longest_at": at, "longest_item": item}
            for f in found:
                f["hits"] = [{"first": a, "last": z} for a, z in _spans(f["hits"])]
                f["items"] = sorted(f["items"])
            columns = [b.column(i) for i in carried] + [pa.array([f[k] for f in found], kind) for k, kind in kinds]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            if clean:
                bad = [contaminated(sum(h["last"] - h["first"] + 1 for h in f["hits"]), f["n_words"]) for f in found]
                out = out.filter(pa.array([not x for x in bad], pa.bool_()))
            yield out

    return run


def contaminated(n_hit, n_words, share: int = SHARE):
    return (n_hit > 0) & (share * n_hit >= n_words)


def find_matches(
    docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False,
) -> DataFrame:
    """The documents' columns ``carry`` (all if None) and what was found in them.

    n_words, hits (spans of word positions), items (with a window in the text),
    longest, longest_at, longest_item (longest verbatim match, its place and
    item). With ``clean``, contaminated documents are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = T._parse_datatype_string(FOUND)
    docs = replace_columns(docs, *found.names)
    carry = [c for c in (docs.columns if carry is None else carry)]
    texts = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    texts = texts.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(blocks)))
    df = docs
    for k in range(blocks):
        items = [(r["name"], r["text"]) for r in texts.filter(F.col("block") == k).collect()]  # about block_bytes
        block = spark.sparkContext.broadcast(Suffixes.of(items, window))
        last = k == blocks - 1
        kept = carry if last else docs.columns
        schema = T.StructType([docs.schema[c] for c in kept] + found.fields)
        carried = [docs.columns.index(c) for c in kept]
        df = df.mapInArrow(_pass(block, docs.columns.index(text_col), carried, schema.names, k == 0, clean and last), schema)
    return df


def hit_words() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = [f.name for f in T._parse_datatype_string(FOUND).fields]
    return find_matches(docs, benchmark, clean=True, **options).drop(*found)
