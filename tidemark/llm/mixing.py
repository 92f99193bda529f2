"""Mix sources to target weights by pivotal dependent rounding.

A document of a source is wanted target / source_size times. The whole part is
taken as it is; the fractions are rounded by the pivotal method: two documents
meet, and mass in words moves from one to the other, at random but fair on
average, until one fraction is 0 or 1. The other goes on. At the end one document
of a source has a fraction left, which is rounded to the nearer side, so the
words taken of a source are within half a document of its target.

The pairings form a tree: a chunk of about ``CHUNK`` documents is folded inside
one row, its one leftover meets the leftovers of other chunks on the next
level, and so on, so a source of any size is spread over all tasks. Rows with
equal id and text are one unit with a count. All randomness is hashed from ids,
so reruns agree.

Defined results: null text has size 0; documents of size 0 take nothing; null is
a source of its own and comes last; equal rows share what their unit takes; an
empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, packed, row_key, running, uniform
from tidemark.session import stage

WEIGHTS = (5, 2, 1)
MOST = 3
CHUNK = 128
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of (source, source_size): shares of all words by weight, stopped at ``most`` times the size.

    The excess goes to the others by weight until none is above its limit. A
    source stops if, at the level where it just reaches its limit, all words
    together would not yet be shared out; so one pass in the order of
    limit / weight settles all of them.
    """
    named = running(sizes, [F.col("source").asc_nulls_last()], {}, "at")
    weight = F.element_at(F.lit(list(weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double")
    named = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)).withColumn("level", F.expr("cap / weight"))
    ranked = stage(running(named, [F.col("level"), F.col("at")], {"caps": "cap", "weights": "weight"}, "nth"), "levels")
    total, sum_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    stops = F.col("caps") + F.col("level") * (F.lit(sum_weight) - F.col("weights")) <= F.lit(total)
    ranked = ranked.withColumn("stops", stops)
    caps, weights_ = ranked.filter("stops").agg(F.sum("cap"), F.sum("weight")).first()
    words, shares = (total or 0) - (caps or 0.0), (sum_weight or 0.0) - (weights_ or 0.0)
    level = F.lit(words / shares if shares > 1e-9 else 0.0)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least(level * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def _let(value: Column, body) -> Column:
    """Bind a value to a name inside an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _meet(acc: Column, b: Column) -> Column:
    """The unit carried on meets the next one; one of them is settled, the other is carried on.

    Mass moves to the carried unit or away from it, as far as the first fraction
    to become integral allows. The next unit's random number picks the way, with
    the chance that keeps both fractions fair on average.
    """
    a = acc["left"]
    ratio = b["size"] / a["size"]
    moves = F.struct(
        F.least(1 - a["p"], b["p"] * ratio).alias("up"), F.least(a["p"], (1 - b["p"]) * ratio).alias("down"),
        (1 - a["p"] <= b["p"] * ratio).alias("a_up"), (a["p"] <= (1 - b["p"]) * ratio).alias("a_down"),
    )

    def settle(m: Column) -> Column:
        up = b["u"] * (m["up"] + m["down"]) < m["down"]
        way = F.struct(up.alias("up"), F.when(up, m["up"]).otherwise(-m["down"]).alias("by"), F.when(up, m["a_up"]).otherwise(m["a_down"]).alias("a_ends"))
        return _let(way, shift)

    def shift(w: Column) -> Column:
        rest = F.when(w["a_ends"], b["p"] - w["by"] / ratio).otherwise(a["p"] + w["by"])
        rest = F.greatest(F.least(rest, F.lit(1.0)), F.lit(0.0))
        left = F.when(w["a_ends"], b).otherwise(a).withField("p", rest)
        done = F.struct(F.when(w["a_ends"], a).otherwise(b).alias("unit"), (w["a_ends"] == w["up"]).alias("extra"))
        return F.struct(left.alias("left"), F.array_append(acc["done"], done).alias("done"))

    return _let(moves, settle)


UNIT = ("id", "h", "size", "copies", "whole", "p")


def _folded(units: DataFrame, level: int) -> DataFrame:
    """Fold the units of each (source, chunk): ``done`` holds the settled ones, ``left`` the one to go on."""
    seed = [F.col("id"), F.col("h"), F.col("source")]
    item = F.struct(
        uniform(*seed, F.lit(f"order {level}")).alias("o"),
        F.struct(*UNIT, uniform(*seed, F.lit(f"meeting {level}")).alias("u")).alias("x"),
    )
    rows = units.groupBy("source", "chunk").agg(F.transform(F.array_sort(F.collect_list(item)), lambda v: v["x"]).alias("units"))
    none = F.filter(F.transform("units", lambda x: F.struct(x.alias("unit"), F.lit(True).alias("extra"))), lambda _: F.lit(False))
    start = F.struct(F.element_at("units", 1).alias("left"), none.alias("done"))
    fold = F.aggregate(F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(0))), start, _meet)
    return rows.select("source", "chunk", fold.alias("f")).select("source", "chunk", "f.left", "f.done")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", chunk: int = CHUNK,
) -> DataFrame:
    """What the mix takes of each unit of equal rows.

    Gives source, id, h, size, copies (rows of the unit), times (how often all
    of them are taken together), source_size, target.
    """
    rows = docs.select(
        F.col(source_col).alias("source"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
        word_count(F.col(text_col)).alias("size"),
    )
    units = stage(rows.groupBy("source", "id", "h", "size").agg(F.count("*").alias("copies")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    targets = stage(source_targets(sizes, weights, most), "targets")
    largest = targets.agg(F.max("n")).first()[0] or 0

    want = targets.select(
        F.col("source").alias("_s"), F.expr("target / source_size").alias("rate"),
        F.ceil(F.col("n") / chunk).alias("chunks"),
    ).filter("source_size > 0")
    each = units.filter("size > 0").join(want, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    wanted = F.round(F.col("rate") * F.col("copies"), 9)
    each = each.withColumn("whole", F.floor(wanted)).withColumn("p", wanted - F.col("whole"))
    plain = each.filter("p = 0").select("source", *UNIT[:-1], F.lit(False).alias("extra"))
    spot = F.pmod(F.xxhash64("id", "h", "source", F.lit("chunk")), F.col("chunks"))
    level_units = each.filter("p > 0").select("source", *UNIT, spot.alias("chunk"))
    settled = [plain]
    for level in range(1 + max(1, math.ceil(math.log(max(largest, 2), chunk)))):
        folded = stage(_folded(level_units, level), f"level{level}")
        done = folded.select("source", F.explode("done").alias("d"))
        settled.append(done.select("source", *[f"d.unit.{c}" for c in UNIT[:-1]], "d.extra"))
        level_units = folded.select("source", *[f"left.{c}" for c in UNIT], F.expr(f"chunk div {chunk}").alias("chunk"))
    settled.append(level_units.select("source", *UNIT[:-1], (F.col("p") >= 0.5).alias("extra")))  # one a source
    settled.append(units.filter("size = 0").select("source", "id", "h", "size", "copies", F.lit(0).cast("long").alias("whole"), F.lit(False).alias("extra")))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    out = out.withColumn("times", F.col("whole") + F.col("extra").cast("long"))
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return out.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "whole", "extra")


def times_of(nth: Column) -> Column:
    """How often the nth row (from 1) of a unit is taken: what its unit takes, spread evenly."""
    return F.expr("times div copies") + F.when(nth <= F.col("times") % F.col("copies"), 1).otherwise(0)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed data set: each document as often as the mix takes it, with all its columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    units = mix(docs, **options).select(row_key(F.col("id"), F.col("h"), F.col("source")).alias("_key"), "copies", "times")
    units = units.select("_key", F.struct("copies", "times").alias("_unit")).filter("_unit.times > 0")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    wide = packed(docs, id_col, text_col, source_col).withColumn("_key", row_key(F.col(id_col), hashed, F.col(source_col)))
    wide = wide.select("_key", ROW).join(units, "_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    wide = wide.withColumn("_nth", nth).withColumn("_n", F.expr("_unit.times div _unit.copies + if(_nth <= _unit.times % _unit.copies, 1, 0)"))
    wide = wide.filter("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return wide.select(f"{ROW}.*")
