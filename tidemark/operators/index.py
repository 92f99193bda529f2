"""Changed notes and a BM25 index over them.

An index is a table of blocks: up to ``BLOCK`` postings of one term, from the
largest impact to the smallest, with the largest of the block beside them. The
impact is what a posting adds to a score, but for the term's weight. A search
reads the few best blocks of its terms, which gives a score that the k best reach
at least. A document of a block whose largest impact, with the best of all other
terms, stays below that score is not among them, so only the other blocks are
read; the condition is a filter on the blocks' own columns, which the files'
statistics answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.binding import let
from tidemark.session import release, stage

BLOCK = 128
LIST = 16  # a range of terms is dealt by its rows, so they must not differ much
K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"


def content_hashes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.sha2("text", 256).alias("hash"))


def changed_docs(docs: DataFrame, previous: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that are new or whose text differs from the previous hash table."""
    current = docs.withColumn("hash", F.sha2("text", 256))
    return current.join(previous.select(key, "hash"), [key, "hash"], "left_anti")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def posting_lists(docs: DataFrame, key: str = "doc_id", only: list[str] | None = None) -> DataFrame:
    """(term, keys, lengths, tfs, total): up to ``LIST`` postings of a term, and the sum of their tfs.

    Words are counted where the texts lie, and what a task has of a term goes on as
    lists, not as a row per posting. Only rows of a repeated key can share a posting,
    which takes those of the same length together; they alone are shuffled. With
    ``only``, other terms are dropped before.
    """
    again = stage(docs.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_again")), "repeated")
    if again.isEmpty():
        return _lists(docs, key, only)
    same = docs[key].eqNullSafe(again["_again"])
    parts = _exploded(_lists(docs.join(again, same, "left_semi"), key, only), key)
    whole = parts.groupBy("term", key, "length").agg(F.sum("tf").alias("tf"))
    merged = whole.select(
        "term", F.array(key).alias("keys"), F.array("length").alias("lengths"), F.array("tf").alias("tfs"), F.col("tf").alias("total")
    )
    return _lists(docs.join(again, same, "left_anti"), key, only).unionByName(merged)


def postings(docs: DataFrame, key: str = "doc_id", only: list[str] | None = None) -> DataFrame:
    """(term, key, tf, length): occurrences of a term in a document of ``length`` terms; of ``only`` these terms, if given."""
    return _exploded(posting_lists(docs, key, only), key)


def _lists(docs: DataFrame, key: str, only: list[str] | None) -> DataFrame:
    words = docs.select(key, tokens(F.col("text")).alias("_words"))
    kept = F.col("_words") if only is None else F.filter("_words", lambda w: w.isin(*only))
    words = words.select(key, F.size("_words").cast("bigint").alias("length"), kept.alias("_words"))
    kind = docs.schema[key].dataType.simpleString()
    return words.mapInArrow(_count, f"term string, keys array<{kind}>, lengths array<bigint>, tfs array<bigint>, total bigint")


def _exploded(lists: DataFrame, key: str) -> DataFrame:
    rows = lists.select("term", F.explode(F.arrays_zip("keys", "lengths", "tfs")).alias("p"))
    return rows.select("term", F.col("p.keys").alias(key), F.col("p.lengths").alias("length"), F.col("p.tfs").alias("tf"))


def _cuts(codes: np.ndarray, most: int) -> np.ndarray:
    """Where lists begin: at each new code, and after ``most`` entries of one."""
    start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    of = np.repeat(start, np.diff(np.r_[start, len(codes)]))
    return np.flatnonzero((np.arange(len(codes)) - of) % most == 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of the documents (key, length, words) of a batch."""
    for b in batches:
        n = np.nan_to_num(b.column(2).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        if not n.sum():
            continue
        words = b.column(2).flatten().dictionary_encode()
        pair = words.indices.to_numpy().astype(np.int64) * len(n) + np.repeat(np.arange(len(n)), n)
        pair, tfs = np.unique(pair, return_counts=True)
        codes, at = pair // len(n), pa.array(pair % len(n))
        first = _cuts(codes, LIST)
        ends = pa.array(np.r_[first, len(codes)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, c) for c in (b.column(0).take(at), b.column(1).take(at), pa.array(tfs.astype(np.int64)))]
        total = pa.array(np.add.reduceat(tfs, first).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [words.dictionary.take(pa.array(codes[first])), *lists, total], names=["term", "keys", "lengths", "tfs", "total"]
        )


def counted(words: Column) -> Column:
    """Array of (term, tf): runs of the sorted words."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        return let(starts, lambda at: F.zip_with(
            at, F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s) + 1)),
            lambda a, b: F.struct(F.element_at(s, a).alias("term"), (b - a).cast("bigint").alias("tf")),
        ))

    return F.when(F.size(words) > 0, let(F.array_sort(words), runs))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: number of documents and their mean length."""
    n = F.size(tokens(F.col("text"))).cast("bigint")
    return docs.agg(F.count("*").alias("n_docs"), (F.sum(n).cast("double") / F.count("*")).alias("mean_length"))


def term_weights(post: DataFrame, stats: DataFrame) -> DataFrame:
    """Document frequency and idf of each term."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    n_docs = stats.select("n_docs").scalar()
    return df.withColumn("idf", F.log(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def search(post: DataFrame, stats: DataFrame, query: str, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The ``k`` best documents for a query text.

    Only postings of the query's terms are read. Their weights are one row per
    query term, which bounds the broadcast.
    """
    terms = query_terms(query)
    hits = post.filter(F.col("term").isin(*terms))
    weights = F.broadcast(term_weights(hits, stats).select("term", "idf"))
    mean = stats.select("mean_length").scalar()
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / mean)
    score = F.sum(F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score")
    found = hits.join(weights, "term").groupBy(key).agg(score)
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), key).limit(k)


def search_docs(docs: DataFrame, query: str, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The same without an index: one pass over the texts keeps lengths and the query's terms."""
    words = docs.select(key, tokens(F.col("text")).alias("_words"))
    own = counted(F.filter("_words", lambda w: w.isin(*query_terms(query))))
    rows = stage(words.select(key, F.size("_words").cast("bigint").alias("length"), own.alias("_own")), "hits")
    stats = rows.agg(F.count("*").alias("n_docs"), (F.sum("length").cast("double") / F.count("*")).alias("mean_length"))
    post = rows.select(key, "length", F.explode("_own").alias("_t")).select("_t.term", key, "length", "_t.tf")
    return search(post, stats, query, k, key)


def query_terms(query: str) -> list[str]:
    return sorted(set("".join(c if c.isalnum() else " " for c in query.lower()).split()))


def _pack(mean: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks from posting lists sorted by term: those of a batch together, by falling impact."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            words = b.column(0).dictionary_encode()
            codes = np.repeat(words.indices.to_numpy(), b.column(1).value_lengths().to_numpy())
            keys, lengths, tfs = (b.column(i).flatten() for i in (1, 2, 3))
            impacts = impact(tfs.to_numpy(), lengths.to_numpy(), mean)
            order = np.lexsort((-impacts, codes))
            codes, impacts, taken = codes[order], impacts[order], pa.array(order)
            first = _cuts(codes, BLOCK)
            ends = pa.array(np.r_[first, len(codes)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, c.take(taken)) for c in (keys, lengths, tfs)]
            terms = words.dictionary.take(pa.array(codes[first]))
            n = pa.array(np.diff(np.r_[first, len(codes)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([terms, pa.array(impacts[first]), n, *lists], names=["term", "largest", "n", "keys", "lengths", "tfs"])

    return run


def write_index(docs: DataFrame, folder: str, key: str = "doc_id", partitions: int | None = None) -> None:
    """Blocks sorted by term, and one row of statistics; texts are cut into words once."""
    lists = stage(posting_lists(docs, key), "postings")
    n_docs, total = docs.count(), lists.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    mean = total / n_docs if n_docs else 0.0
    stats = docs.sparkSession.createDataFrame([(n_docs, mean)], "n_docs bigint, mean_length double")
    by = [F.col("term"), F.get("keys", F.lit(0))]  # lists of a frequent term can go to several tasks
    rows = lists.drop("total")
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("keys", "lengths", "tfs"))
    packed = dealt.sortWithinPartitions(*by).mapInArrow(_pack(mean), f"term string, largest double, n bigint, {kinds}")
    packed.write.mode("overwrite").parquet(f"{folder}/blocks")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")
    release(lists)


def impact(tf, length, mean):
    """What a posting adds to a score for each unit of its term's weight; of columns or of arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _read(blocks: DataFrame, least: dict[str, float]) -> DataFrame:
    """The postings of blocks whose largest impact is that of their term or more."""
    wanted = F.lit(False)
    for term, floor in least.items():
        wanted = wanted | ((F.col("term") == term) & (F.col("largest") >= F.lit(floor)))
    rows = blocks.filter(wanted).select("term", F.explode(F.arrays_zip("keys", "lengths", "tfs")).alias("p"))
    return rows.select("term", F.col("p.keys").alias("key"), F.col("p.lengths").alias("length"), F.col("p.tfs").alias("tf"))


def _scores(rows: DataFrame, idf: dict[str, float], mean: float) -> DataFrame:
    weight = F.lit(0.0)
    for term, w in idf.items():
        weight = F.when(F.col("term") == term, F.lit(w)).otherwise(weight)
    return rows.groupBy("key").agg(F.sum(weight * impact(F.col("tf"), F.col("length"), F.lit(mean))).alias("score"))


def search_plan(spark: SparkSession, folder: str, query: str, k: int = 10) -> tuple[dict[str, float], dict[str, float], float]:
    """Weight of each query term, the least largest impact of the blocks to read, and the mean length.

    Reads the blocks' terms, largest impacts and sizes, and the best blocks of each term.
    """
    blocks = spark.read.parquet(f"{folder}/blocks").filter(F.col("term").isin(*query_terms(query)))
    stats = spark.read.parquet(f"{folder}/stats").first()
    n_docs, mean = stats["n_docs"], stats["mean_length"]
    heads = blocks.select("term", "largest", "n")
    per = heads.groupBy("term").agg(F.sum("n").alias("df"), F.max("largest").alias("most"))
    per = per.withColumn("idf", F.log(F.lit(1.0) + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    terms = {r["term"]: r for r in per.collect()}  # one row per query term
    idf = {t: r["idf"] for t, r in terms.items()}
    best = Window.partitionBy("term").orderBy(F.desc("largest"))
    seeds = max(2, -(-2 * k // BLOCK))  # blocks of a term that are sure to be read
    top = heads.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= seeds).groupBy("term").agg(F.min("largest").alias("m"))
    first = _scores(_read(blocks, {r["term"]: r["m"] for r in top.collect()}), idf, mean)
    reached = [r["score"] for r in first.orderBy(F.desc("score")).limit(k).collect()]
    bar = reached[-1] - 1e-6 if len(reached) == k else float("-inf")  # scores are compared when rounded
    bound = {t: idf[t] * r["most"] for t, r in terms.items()}
    others = {t: sum(bound.values()) - bound[t] for t in bound}
    return idf, {t: max(0.0, (bar - others[t]) / idf[t] * (1 - 1e-12)) for t in terms}, mean


def search_index(spark: SparkSession, folder: str, query: str, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The ``k`` best documents for a query text: those of ``search``, from the blocks that can hold them."""
    idf, least, mean = search_plan(spark, folder, query, k)
    found = _scores(_read(spark.read.parquet(f"{folder}/blocks"), least), idf, mean).withColumnRenamed("key", key)
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), key).limit(k)
