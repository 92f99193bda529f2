"""Lookup tiers: the first lookup of a key misses, later ones hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import Sequence, slot, unplaced, with_running

DAY_US = 86_400_000_000


def lookup_tiers(lookups: DataFrame, keys: tuple[str, ...] = ("key",), slot_us: int = DAY_US) -> DataFrame:
    """Add the running count of a key's lookups and its tier: ``L2`` first, then ``L1``.

    Lookups without a time have no place in a key's order: see ``untimed_lookups``.
    """
    seq = Sequence(keys=keys, order=("t_us", "event_id"))
    df = lookups.withColumns({"_one": F.lit(1).cast("bigint"), "chunk": slot("t_us", slot_us)})
    df = with_running(df, seq, "sum", "_one", "n_lookups")
    return df.withColumn("tier", F.expr("case when n_lookups = 1 then 'L2' else 'L1' end")).drop("_one", "chunk")


def untimed_lookups(lookups: DataFrame) -> DataFrame:
    """Lookups without a time: left out of ``lookup_tiers``, counted by ``distill.lookup_counts``."""
    return unplaced(lookups, "t_us")
