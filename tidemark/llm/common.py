"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PIECE_BYTES = 1 << 20

# bytes of words: ASCII letters (lower-cased), digits and every byte of a non-ASCII character
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the batches that go to Python, so that long texts do not add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) decided by the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") / float(1 << 53)


def replace_columns(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns whose names the operator gives its own meaning (case aside, as Spark resolves them)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


ROW = "_given_row"


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all given ones as a single struct, so that no name of ours clashes with one of them."""
    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys(names)], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def row_key(*cols: Column) -> Column:
    """One string that is never null and tells apart different values, nulls included."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.base64(c.cast("string").cast("binary"))), F.lit("~")) for c in cols])


def running(df: DataFrame, order: list[Column], sums: dict[str, str], index: str) -> DataFrame:
    """Add ``index`` (from 0) in a total order and running sums up to and with the row.

    Rows are dealt by ranges of the order; windows run inside a range, and one
    row per range carries the totals on. Ranges are sampled, so the rows are
    written once before anything is derived from them. ``sums`` maps new names
    to existing columns.
    """
    placed = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    rows = stage(placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))), "ranges")
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    parts = parts.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ["_n", *[f"_t_{n}" for n in sums]]])
    out = rows.withColumns({n: F.sum(c).over(upto) for n, c in sums.items()}).join(parts, "_part")
    return out.withColumns({index: F.col("_at") - 1 + F.col("_b_n"), **{n: F.col(n) + F.col(f"_b_t_{n}") for n in sums}}).drop(
        "_part", "_at", "_b_n", *[f"_b_t_{n}" for n in sums]
    )


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the task and the row's number among its tree's rows in the task; trees come one after another."""
    part, at, last = TaskContext.get().partitionId(), 0, None
    for b in batches:
        numbers = []
        for tree in b.column(b.schema.get_field_index("_tree")).to_pylist():
            at, last = (at + 1 if tree == last else 0), tree
            numbers.append(at)
        fields = [*b.schema.names, "_part", "_at"]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())], names=fields)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0, in ``order`` within each ``_tree``) and ``size`` (rows of the tree).

    Rows are dealt by ranges of the order and numbered along each range; one row
    per range and tree carries the numbers on.
    """
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "unnumbered")  # equal rows still part
    by = ["_tree", *order, "_row"]
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    along = stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_number, schema), "ordered")
    tree = Window.partitionBy("_tree")  # one row per range and tree
    starts = along.groupBy("_tree", "_part").agg(F.count("*").alias("n")).select(
        "_tree", "_part", F.sum("n").over(tree).alias("size"),
        F.coalesce(F.sum("n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    placed = along.join(stage(starts, "starts"), ["_tree", "_part"])
    return placed.withColumn("pos", F.col("_at") + F.col("before")).drop("_part", "_at", "_row", "before")


def pieces(data: bytes, separators: bytes = b" \t\n\r\x0b\x0c", size: int = PIECE_BYTES) -> Iterator[bytes]:
    """Consecutive pieces of about ``size`` bytes that end at a separator, so that no word is cut."""
    at, end = 0, len(data)
    while end - at > size:
        stop = at + size
        while stop < end and data[stop] not in separators:
            stop += 1
        yield data[at:stop]
        at = stop
    yield data[at:] if at else data
