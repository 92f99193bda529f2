"""From raw documents to shards of training data.

Five stages, each over all rows that the one before kept: documents that the
quality classifier rejects go, one document of each group of near duplicates
stays, contaminated documents go, sources are mixed to their target weights
(documents are repeated or left out), and the result is dealt to shards. All
stages but the last return the columns of ``documents``; the last adds ``shard``
and ``slot``.

Null and empty texts have no words: the classifier judges them by its offset, the
near-dedup stage keeps one of them, nothing contaminates them, and they take no
room in the mix. A null id is no id: rows are told apart by id and text. Ties go
to the smallest id, then to the smallest text hash. Repeated rows are repeated
until near-dedup keeps one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, mixing, near_dedup, quality, sharding
from tidemark.llm.common import table
from tidemark.session import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that importance resampling draws."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup of operator 5: SimHash fingerprints linked through vantage-point trees, judged by the sets of five-word shingles.

    A link is an exact similarity of 0.8 or more, also where the fingerprints miss it; the smallest id of each group stays.
    """
    return near_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: rows as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: the documents with their shard and slot."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

# the models, fingerprints and random numbers of the first stages are beyond SQL; tests/llm holds a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES = [pipeline]
SQL: dict[str, str] = {}
