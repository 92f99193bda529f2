"""Running values over long ordered sequences.

A plain window over ``partitionBy(key)`` puts all rows of a key into one task.
Here every key is cut into chunks that are contiguous in its order (a time
slot, a range of positions). Windows run per (key, chunk); one small row per
chunk carries the state from chunk to chunk. A key that holds a third of all
rows is therefore spread over as many tasks as it has chunks, and the wide rows
are shuffled once, by (key, chunk).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed


@dataclass(frozen=True)
class Sequence:
    """Rows with equal ``keys`` in the order ``order``; ``chunk`` never decreases along it."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str = "chunk"

    @property
    def flags(self) -> list[str]:
        return [flag(k) for k in self.keys]

    @property
    def parts(self) -> list[str]:
        """What tells keys apart: a key that is null has a flag, whatever stands in for it."""
        return [*self.keys, *self.flags]

    @property
    def cut(self) -> list[str]:
        return [*self.parts, self.chunk]

    def rows(self, *also: str):
        return Window.partitionBy(*self.cut, *also).orderBy(*self.order)

    def chunks(self, *also: str):
        return Window.partitionBy(*self.parts, *also).orderBy(self.chunk)

    def position(self) -> Column:
        return F.struct(*self.order)


def slot(t_us: str, width_us: int) -> Column:
    """The time slot of a time in microseconds."""
    return F.expr(f"{t_us} div {width_us}")


def flag(key: str) -> str:
    """The column that is true where the key is null."""
    return f"_no_{key}"


def named(df: DataFrame, *keys: str) -> DataFrame:
    """Rows without a key share one: a name for text, -1 for numbers, and a flag that keeps it apart from a real one."""
    kinds = {c: df.schema[c].dataType for c in keys}
    fill = {c: F.lit(fixed.NO_KEY) if isinstance(k, T.StringType) else F.lit(-1).cast(k) for c, k in kinds.items()}
    marked = df.withColumns({flag(c): F.col(c).isNull() for c in keys})
    return marked.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items()})


def placed(df: DataFrame, seq: Sequence) -> DataFrame:
    """Rows with a place in their key's order; the others are what ``unplaced`` gives.

    Said once here, the condition is the same wherever the rows are read, which
    lets one shuffle serve the rows and their chunk summary.
    """
    return named(df, *seq.keys).filter(F.col(seq.chunk).isNotNull())


def unplaced(df: DataFrame, *order: str) -> DataFrame:
    """Rows that lack a part of their order: they have no place and are left out of running values."""
    lacking = F.lit(False)
    for c in order:
        lacking = lacking | F.col(c).isNull()
    return df.filter(lacking)


def with_previous(df: DataFrame, seq: Sequence, columns: list[str], name: str = "prev") -> DataFrame:
    """Add struct ``name``: ``columns`` of the previous row of the key, null on its first row.

    The last row of each chunk is found by a second, narrow pass that is
    combined before its shuffle.
    """
    df = placed(df, seq)
    value = F.struct(*columns)
    ends = df.groupBy(*seq.cut).agg(F.max_by(value, seq.position()).alias("_end"))
    before = ends.select(*seq.cut, F.lag("_end").over(seq.chunks()).alias("_before"))
    return (
        df.withColumn("_here", F.lag(value).over(seq.rows()))
        .join(before, seq.cut)
        .withColumn(name, F.coalesce("_here", "_before"))
        .drop("_here", "_before", *seq.flags)
    )


def with_running(
    df: DataFrame, seq: Sequence, fn: str, column: str, name: str, inclusive: bool = True, reuse: bool = False
) -> DataFrame:
    """Add ``name``: running ``sum`` or ``max`` of ``column``, with or without the row itself.

    The chunk totals come from a second, narrow pass over ``df`` that is combined
    before its shuffle. With ``reuse`` they come from the shuffled rows instead,
    so that an expensive source is read once; this pays only where ``df`` has no
    more columns than keys, order, chunk and ``column``.
    """
    df = placed(df, seq)
    agg = {"sum": F.sum, "max": F.max}[fn]
    upto = seq.rows().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = Window.currentRow if inclusive else -1
    if reuse:
        rows = df.withColumn("_upto", agg(column).over(upto))
        totals = rows.groupBy(*seq.cut).agg(F.max_by("_upto", seq.position()).alias("_total"))
    else:
        totals = df.groupBy(*seq.cut).agg(agg(column).alias("_total"))
    carried = agg("_total").over(seq.chunks().rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select(*seq.cut, carried.alias("_before"))
    here = agg(column).over(seq.rows().rowsBetween(Window.unboundedPreceding, last))
    if fn == "sum":
        both = F.coalesce("_here", F.lit(0)) + F.coalesce("_before", F.lit(0))
    else:
        both = F.greatest("_here", "_before")
    return (
        df.withColumn("_here", here).join(before, seq.cut).withColumn(name, both).drop("_here", "_before", *seq.flags)
    )
