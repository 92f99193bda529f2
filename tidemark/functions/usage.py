"""Column expressions over usage payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed


def whole(text: Column) -> Column:
    """Text as a whole number; null where it is none."""
    return text.try_cast("double").try_cast("bigint")


def first_nonzero(*texts: Column) -> Column:
    """The first number that is neither missing nor 0; 0 when there is none."""
    return F.coalesce(*[F.nullif(whole(x), F.lit(0).cast("bigint")) for x in texts], F.lit(0).cast("bigint"))


def first_text(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in values])


def normalize_model(name: Column) -> Column:
    s = F.lower(F.coalesce(name, F.lit("")))
    s = F.regexp_replace(s, r"\([^)]*\)", " ")
    s = F.regexp_replace(s, "[^a-z0-9]+", "-")
    return F.trim(s, F.lit("-"))


def max_context(model: Column) -> Column:
    """Context size of a model name; the order of the rules matters."""
    m = normalize_model(model)

    def word(*names: str) -> Column:
        return m.rlike("(^|-)(" + "|".join(names) + ")(-|$)")

    size = F
    for prefix, tokens in fixed.CONTEXT_PREFIX_SIZES.items():
        size = size.when(m.startswith(prefix), F.lit(tokens))
    size = (
        size.when(word("claude", "sonnet", "opus"), F.lit(fixed.CONTEXT_SMALL))
        .when(word("gemini") & ~word("pro"), F.lit(fixed.CONTEXT_STANDARD))
        .when(word("gemini"), F.lit(fixed.CONTEXT_LARGE))
        .when(word("flash"), F.lit(fixed.CONTEXT_STANDARD))
        .when(word("pro"), F.lit(fixed.CONTEXT_LARGE))
        .otherwise(F.lit(fixed.CONTEXT_STANDARD))
    )
    return size.cast("bigint")


def step_of(ratio: Column) -> Column:
    return F.floor(ratio / F.lit(fixed.STEP_RATIO)).cast("bigint")


def tier_of(ratio: Column, tiers: tuple[int, ...] = fixed.TIERS) -> Column:
    """The highest threshold that the percentage has reached; 0 for none."""
    reached = [F.when(ratio * 100 >= F.lit(b), F.lit(b)) for b in tiers]
    return F.coalesce(F.greatest(*reached), F.lit(0))


def one_decimal(x: Column) -> Column:
    """Text with one decimal: nearest by exact binary value, exact ties upwards."""
    tie = x * 4 == F.floor(x * 4)
    s = F.when(tie, F.format_number(F.round(x, 1), 1)).otherwise(F.format_number(x, 1))
    return F.replace(s, F.lit(","), F.lit(""))


def status_text(ratio: Column, fired: Column) -> Column:
    pct = one_decimal(ratio * 100)
    left, right = fixed.STATUS_FIRED
    return F.when(fired, F.concat(F.lit(left), pct, F.lit(right))).otherwise(
        F.concat(F.lit(fixed.STATUS_TEXT), pct, F.lit("%"))
    )
