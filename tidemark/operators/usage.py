"""Usage payloads to saturation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import usage as U


COUNTS = (
    "promptTokenCount STRING, candidatesTokenCount STRING, cachedContentTokenCount STRING, "
    "input_tokens STRING, output_tokens STRING, cache_creation_input_tokens STRING, cache_read_input_tokens STRING"
)
# Leaves are text, so that numbers and quoted numbers read alike and an object in
# a text field reads as its JSON.
PAYLOAD = (
    "model STRING, "
    "context_window STRUCT<total_input_tokens STRING, total_output_tokens STRING, context_window_size STRING, "
    "current_usage STRUCT<cache_read_input_tokens STRING>>, "
    "llm_request STRUCT<model STRING>, "
    f"llm_response STRUCT<model STRING, usageMetadata STRUCT<{COUNTS}>, usage STRUCT<{COUNTS}>>"
)


def normalize_usage(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Read both payload shapes into typed columns; other payloads are dropped.

    A payload with ``context_window`` is a status line; else one with
    ``llm_response`` is a model reply. One pass over the JSON yields all fields.
    """
    keep = [c for c in payloads.columns if c != payload]
    # A filter on the parsed value would be pushed below it and parse again for
    # each condition; generating the value's fields keeps it at one parse.
    parsed = F.array(F.from_json(payload, PAYLOAD))
    known = F.filter(parsed, lambda p: p["context_window"].isNotNull() | p["llm_response"].isNotNull())
    df = payloads.select(*keep, F.inline(known).alias("_model", "_w", "_q", "_r")).select(
        *keep, "_model", "_w",
        F.expr("case when _w is null then coalesce(_r.usageMetadata, _r.usage) end").alias("_u"),
        U.first_text(F.col("_r.model"), F.col("_q.model")).alias("_reply_model"),
    )
    status, w, u = F.col("_w").isNotNull(), F.col("_w"), F.col("_u")
    status_model = F.when(F.col("_model").startswith("{"), F.get_json_object("_model", "$.id")).otherwise(F.col("_model"))
    model = F.when(status, U.first_text(status_model)).otherwise(F.col("_reply_model"))
    cached = [u.cachedContentTokenCount, u.cache_creation_input_tokens, u.cache_read_input_tokens]
    return df.select(
        *keep,
        F.lower(F.coalesce(model, F.lit(fixed.DEFAULT_MODEL))).alias("model"),
        U.first_nonzero(w.total_input_tokens, u.promptTokenCount, u.input_tokens).alias("prompt_tokens"),
        U.first_nonzero(w.total_output_tokens, u.candidatesTokenCount, u.output_tokens).alias("output_tokens"),
        U.first_nonzero(w.current_usage.cache_read_input_tokens, *cached).alias("cached_tokens"),
        U.whole(w.context_window_size).alias("context_size"),
    )


def skip_zero(usage: DataFrame) -> DataFrame:
    return usage.filter(F.col("prompt_tokens") != 0)


def with_limit(usage: DataFrame) -> DataFrame:
    """Replace the size stated in the payload by the limit in force."""
    size = F.when(F.col("context_size") > 0, F.col("context_size")).otherwise(U.max_context(F.col("model")))
    return usage.withColumn("max_context", size).drop("context_size")


def with_saturation(usage: DataFrame) -> DataFrame:
    """Add ratio, 5% step, tier and the 80% flag."""
    df = usage.withColumn("ratio", F.expr("cast(prompt_tokens as double) / cast(max_context as double)"))
    ratio = F.col("ratio")
    return df.withColumns(
        {"step": U.step_of(ratio), "tier": U.tier_of(ratio), "critical": ratio >= F.lit(fixed.CRITICAL_RATIO)}
    )


def should_distill(usage: DataFrame, threshold: int = fixed.DISTILL_TOKENS) -> DataFrame:
    return usage.filter(F.col("prompt_tokens") >= F.lit(threshold))
