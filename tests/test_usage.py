import json
import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from tidemark.functions import usage as U
from tidemark.operators import usage as S
from tidemark.sources.usage import read_usage


def norm(spark, payloads):
    rows = [(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "i int, payload string")
    return {r.i: r for r in S.normalize_usage(df).collect()}


def test_payload_shapes(spark):
    w = {"total_input_tokens": 7, "total_output_tokens": 2, "context_window_size": 500, "current_usage": {"cache_read_input_tokens": 3}}
    got = norm(spark, [
        {"context_window": w, "model": {"id": "Gemini-X"}},
        {"context_window": w, "model": "Opus"},
        {"context_window": {**w, "context_window_size": 0}, "model": {"name": "no id"}},
        {"context_window": {**w, "context_window_size": "700", "total_input_tokens": "9"}},
        {"context_window": w, "llm_response": {"usage": {"input_tokens": 99}}},
        {"llm_response": {"usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 6, "cachedContentTokenCount": 0, "cache_read_input_tokens": 8}, "model": "A"}, "llm_request": {"model": "B"}},
        {"llm_response": {"usage": {"input_tokens": 5, "output_tokens": 6, "cache_creation_input_tokens": 0, "cache_read_input_tokens": 4}, "model": ""}, "llm_request": {"model": "B"}},
        {"llm_response": {"usageMetadata": {"promptTokenCount": 0, "input_tokens": 4}, "usage": {"input_tokens": 9}}},
        {"llm_response": {"usageMetadata": None, "usage": {"input_tokens": 9}}},
        {"llm_response": {}},
        {"other": 1}, "", "{bad", None, "[]", "7",
        {"context_window": {}},
    ])
    cols = ("model", "prompt_tokens", "output_tokens", "cached_tokens", "context_size")
    assert {i: tuple(r[c] for c in cols) for i, r in got.items()} == {
        0: ("gemini-x", 7, 2, 3, 500),
        1: ("opus", 7, 2, 3, 500),
        2: ("gemini-2.5-flash", 7, 2, 3, 0),
        3: ("gemini-2.5-flash", 9, 2, 3, 700),
        4: ("gemini-2.5-flash", 7, 2, 3, 500),
        5: ("a", 5, 6, 8, None),
        6: ("b", 5, 6, 4, None),
        7: ("gemini-2.5-flash", 4, 0, 0, None),
        8: ("gemini-2.5-flash", 9, 0, 0, None),
        9: ("gemini-2.5-flash", 0, 0, 0, None),
        16: ("gemini-2.5-flash", 0, 0, 0, None),
    }


def test_context_sizes(spark):
    want = {
        "GPT-OSS-120B (x)": 131072, "claude": 200000, "my sonnet 4": 200000, "Opus": 200000, "gemini pro": 2097152,
        "gemini-2.5-flash": 1048576, "flash-pro": 1048576, "Pro": 2097152, "profile": 1048576, "": 1048576,
        "(claude)": 1048576, "x_opus_y": 200000, "geminipro": 1048576,
    }
    df = spark.createDataFrame([(k,) for k in want], "m string")
    assert {r.m: r.c for r in df.select("m", U.max_context(F.col("m")).alias("c")).collect()} == want
    names = {"  Claude  Sonnet (a) (b)": "claude-sonnet", "--A__b--": "a-b", "é": ""}
    df = spark.createDataFrame([(k,) for k in names], "m string")
    assert {r.m: r.c for r in df.select("m", U.normalize_model(F.col("m")).alias("c")).collect()} == names


def test_stated_size_wins(spark):
    df = spark.createDataFrame([("pro", 10, 500), ("pro", 10, 0), ("pro", 10, None)], "model string, prompt_tokens long, context_size long")
    assert [r.max_context for r in S.with_limit(df).collect()] == [500, 2097152, 2097152]


def test_steps_and_tiers_in_doubles(spark):
    df = spark.createDataFrame([(15, 100), (20, 100), (70, 100), (99, 100), (4, 100), (80, 100)], "prompt_tokens long, max_context long")
    got = [(r.step, r.tier, r.critical) for r in S.with_saturation(df).collect()]
    assert got == [(math.floor(t / 100 / 0.05), tier, t >= 80)
                   for t, tier in [(15, 0), (20, 20), (70, 70), (99, 70), (4, 0), (80, 70)]]
    assert got[0][0] == 2


def test_one_decimal_rounds_the_exact_value(spark):
    xs = [1.45, 12.25, 12.75, 0.05, 99.95, 1234.56, 0.0, 100.0, 2.5, 3.35, 0.25, 33.333333]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    want = [str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP)) for x in xs]
    assert [r.s for r in df.select(U.one_decimal(F.col("x")).alias("s")).collect()] == want


def test_should_distill_is_inclusive(spark):
    df = spark.createDataFrame([(399999,), (400000,)], "prompt_tokens long")
    assert [r.prompt_tokens for r in S.should_distill(df).collect()] == [400000]


def test_text_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"llm_response":{"usage":{"input_tokens":3}}}\n{"x":1}\nnot json\n')
    assert [r.prompt_tokens for r in read_usage(spark, str(tmp_path)).collect()] == [3]
