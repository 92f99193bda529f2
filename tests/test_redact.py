import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import redact as R

RANDOM = "aB3$kZ9!qW7@eR5^tY1&uI8*oP2(pL6)mN4_cV0-xJ"


def run(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def entropy(s):
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def test_keyword_literals(spark):
    assert run(spark, ['a "my API_KEY" b', 'a "b" token "c"', '"x" password', 'no'], R.redact_keyword_literals) == [
        'a "[REDACTED]" b', 'a "b" token "c"', '"x" password', 'no',
    ]


def test_assigned_secrets(spark):
    texts = ['my_token = "v"', 'Password: "v"', '{"secret": "v", "a": "b"}', 'token "v"', 'x = "v"', 'credential_id := "v"', 'token: str = "v"']
    assert run(spark, texts, R.redact_assigned_secrets) == [
        'my_token = "[REDACTED]"', 'Password: "[REDACTED]"', '{"secret": "[REDACTED]", "a": "b"}', 'token "v"', 'x = "v"',
        'credential_id := "[REDACTED]"', 'token: str = "[REDACTED]"',
    ]


def test_a_name_inside_a_literal_is_no_assignment(spark):
    assert run(spark, ['say "token: " + "x"'], R.redact_assigned_secrets) == ['say "token: " + "x"']


def test_private_keys(spark):
    pem = "a\n-----BEGIN RSA PRIVATE KEY-----\nMII\nxyz\n-----END RSA PRIVATE KEY-----\nb"
    assert run(spark, [pem], R.redact_private_keys) == [
        'a\n"[REDACTED]"\nMII\nxyz\n-----END RSA PRIVATE KEY-----\nb'
    ]
    assert run(spark, [pem], lambda t: R.redact_private_keys(t, whole_block=True)) == ['a\n"[REDACTED]"\nb']
    open_end = "-----BEGIN PRIVATE KEY-----\n-----BEGIN EC PRIVATE KEY-----\nq"
    assert run(spark, [open_end], lambda t: R.redact_private_keys(t, whole_block=True)) == [
        '-----BEGIN PRIVATE KEY-----\n"[REDACTED]"\nq'
    ]


def test_entropy_limit(spark):
    assert entropy(RANDOM) > 4.5 and len(RANDOM) > 32
    low, short = "ab" * 20, RANDOM[:32]
    texts = [f'x "{RANDOM}" y', f'x "{low}" y', f'x "{short}" y', f'token = "{RANDOM}"', f"x '{RANDOM}'"]
    assert run(spark, texts, R.redact_high_entropy) == [
        'x "[REDACTED_HIGH_ENTROPY]" y', texts[1], texts[2], texts[3], texts[4],
    ]
    assert run(spark, texts[4:], lambda t: R.redact_high_entropy(t, pattern=R.CODE_LITERAL)) == ['x "[REDACTED_HIGH_ENTROPY]"']


def test_all_rules_together(spark):
    texts = [f'token = "{RANDOM}" and "{RANDOM}" and "no secret" "ok"']
    assert run(spark, texts, R.redact) == ['token = "[REDACTED]" and "[REDACTED_HIGH_ENTROPY]" and "[REDACTED]" "ok"']


def test_one_literal_many_places(spark):
    # equal literals are judged where they stand
    assert run(spark, ['token = "v"; x = "v"'], R.redact) == ['token = "[REDACTED]"; x = "v"']


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(['"', "token", " = ", "x", "\n", RANDOM, ": ", "é"]), max_size=14).map("".join), min_size=1, max_size=25))
def test_redaction_settles_and_keeps_the_rest(spark, texts):
    once = run(spark, texts, R.redact)
    for t, x in zip(texts, once):
        if '"' not in t:
            assert x == t
    twice = run(spark, once, R.redact)
    # a marker is itself a literal and holds no keyword
    assert twice == once


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcé漢😀 1", max_size=40), min_size=1, max_size=20))
def test_entropy_value(spark, texts):
    for t, h in zip(texts, run(spark, texts, R.shannon_entropy)):
        assert h == pytest.approx(entropy(t), abs=1e-9)
        assert h <= math.log2(max(len(t), 1)) + 1e-9


def test_strings_of_all_forms(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import redact as R

    q = '"' * 3
    rows = [
        (f"password = {q}hunter2\n\"x\" {q}\nn = 1", 'password = "[REDACTED]"\nn = 1'),
        ('token = f"abc{1}"', 'token = "[REDACTED]"'),
        ('d = "a\\"b password"', 'd = "[REDACTED]"'),
        ("k = 'it\\'s a secret'; x = 'y'", "k = \"[REDACTED]\"; x = 'y'"),
        ("const apiKey = `a\nb`", 'const apiKey = "[REDACTED]"'),
        ("buf\"a\" + 'b'", "buf\"a\" + 'b'"),
        ('x = "open\ny = "secret"', 'x = "open\ny = "[REDACTED]"'),
        ('"' + "\\a" * 20_000 + '"', '"' + "\\a" * 20_000 + '"'),
        (q + '"" ' * 20_000, q + '"" ' * 20_000),
    ]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.t for r in df.select("i", R.redact(F.col("t"), pattern=R.CODE_LITERAL).alias("t")).collect()}
    assert [got[i] for i in range(len(rows))] == [b for _, b in rows]


GONE = '"[REDACTED]"'


@pytest.mark.parametrize("ext, text, want", [
    ("py", "# it's the password = 'hunter2'\nx = 1\n", f"# it's the password = {GONE}\nx = 1\n"),
    ("py", "x = 1  # use `a\ny = 2  # and `b\n", None),
    ("py", "password = (  # it's\n    'v')\nname = 'it'  # isn't\n", None),
    ("py", "password = \\\n  # it's\n  # here\n  'v'\n", None),
    ("py", "password = # it's\n  'v'\n", f"password = # it's\n  {GONE}\n"),
    ("py", "s = \"\"\"# no comment's\"\"\"; token = 'v'\n", f"s = \"\"\"# no comment's\"\"\"; token = {GONE}\n"),
    ("js", "// use ` here\nfunction token() { return 1 }\n// and ` there\n", None),
    ("js", "/* don't */ const password = /* it's */ // \"\n 'v';\n", f"/* don't */ const password = /* it's */ // \"\n {GONE};\n"),
    ("js", "const u = \"http://x/?q='\"; token = `a\n'b'`;\n", f"const u = \"http://x/?q='\"; token = {GONE};\n"),
    ("ts", "if (/['\"`]/.test(x)) { secret = 'v' } // it's\n", f"if (/['\"`]/.test(x)) {{ secret = {GONE} }} // it's\n"),
    ("tsx", "return /token='x'/.test(a / b / 'c')\n", None),
    ("js", "/* api_key: \"k\" it's */ a = 'b'\n", f"/* api_key: {GONE} it's */ a = 'b'\n"),
    ("md", "it's the password = 'hunter2', isn't it\n", f"it's the password = {GONE}, isn't it\n"),
    ("md", 'say "my token" and it\'s gone', f"say {GONE} and it's gone"),
    ("md", None, None),
    ("py", "", None),
])
def test_comments_and_literals_by_language(spark, ext, text, want):
    df = spark.createDataFrame([(ext, text)], "ext string, text string")
    got = df.select(R.redact_code(F.col("text"), F.col("ext")).alias("t")).first().t
    assert got == (text if want is None else want)


def test_long_code_is_redacted_in_linear_time(spark):
    parts = ["x = 'abc'  # it's\n" * 60_000, "/* a * b **" + " x" * 400_000 + "*/ let s = 'x'\n" + "let a = /x/; b = 'q'\n" * 30_000]
    df = spark.createDataFrame(list(zip(["py", "js"], parts)), "ext string, text string")
    assert [r.t for r in df.select(R.redact_code(F.col("text"), F.col("ext")).alias("t")).collect()] == parts


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5])
def test_comments_before_a_literal(spark, n):
    between = "# it's\n  " * n
    df = spark.createDataFrame([("py", f"y = 'a'\npassword = {between}'v'\n")], "ext string, text string")
    value = GONE if n <= 3 else "'v'"
    assert df.select(R.redact_code(F.col("text"), F.col("ext")).alias("t")).first().t == f"y = 'a'\npassword = {between}{value}\n"


def test_a_text_that_holds_the_mark_is_cut_alike(spark):
    rows = [("py", f"{R.MARK}'a'{R.MARK} token = 'v{R.MARK}'{R.MARK}", f"{R.MARK}'a'{R.MARK} token = {GONE}{R.MARK}"), ("ts", R.MARK, R.MARK)]
    df = spark.createDataFrame(rows, "ext string, text string, want string")
    assert [r.t == r.want for r in df.select(R.redact_code(F.col("text"), F.col("ext")).alias("t"), "want").collect()] == [True, True]


def test_random_texts_are_judged_by_their_whole_entropy(spark):
    texts = [RANDOM, "ab" * 20, "ä€😀 " * 12 + RANDOM, "the quick brown fox jumps over the lazy dog " * 3, "abcdefghijklmnopqrstuvwxyz0123456789", "a" * 500 + RANDOM, ""]
    for limit in (0.0, 3.5, 4.0, 4.3, 4.5, 5.1):
        inner = [t.strip("\"' ") for t in texts]
        assert run(spark, texts, lambda t: R.is_random(t, 32, limit)) == [len(t) > 32 and entropy(t) > limit for t in inner], limit
