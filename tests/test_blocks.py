import ast
import glob
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B
from tidemark.operators import distill as D
from workloads import fixtures as X

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def files_of(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string")
    return df.select("path", B.extension(F.col("path")).alias("ext"), "text", B.size(F.col("text")).alias("n_bytes"))


def python_functions(text):
    """Outermost functions by the language's own parser: name and byte span of the body."""
    starts, total = [], 0
    for line in text.encode().splitlines(keepends=True):
        starts.append(total)
        total += len(line)
    out = []

    def walk(node):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a, b = child.body[0], child.body[-1]
                out.append((child.name, starts[a.lineno - 1] + a.col_offset, starts[b.end_lineno - 1] + b.end_col_offset))
            else:
                walk(child)

    walk(ast.parse(text))
    return out


def test_python_bodies_match_the_parser(spark):
    rows = []
    for p in glob.glob(f"{ROOT}/tidemark/**/*.py", recursive=True):
        with open(p, encoding="utf-8") as f:
            rows.append((os.path.relpath(p, ROOT), f.read()))
    got = D.source_map(files_of(spark, rows)).collect()
    by_path = {}
    for r in got:
        by_path.setdefault(r.path, []).append((r.pos, r.symbol, r.original_start, r.original_end))
    n = 0
    for path, text in rows:
        want = python_functions(text)
        assert [x[1:] for x in sorted(by_path.get(path, []))] == want, path
        n += len(want)
    assert n > 60


def test_python_skeleton_still_parses(spark):
    text = (
        "import os\n\n\n@deco\ndef f(\n    a,\n    b: int = g(1),\n):\n    '''doc'''\n    return a\n\n\n"
        "class C:\n    x = 1\n\n    async def m(self) -> dict:  # note\n        def inner():\n            pass\n        return {}\n\n"
        "    def n(self): return 'é'\n\n\ny = 2\n"
    )
    r = D.skeletons(files_of(spark, [("a.py", text)])).first()
    assert r.skeleton == (
        "import os\n\n\n@deco\ndef f(\n    a,\n    b: int = g(1),\n):\n     pass\n\n\n"
        "class C:\n    x = 1\n\n    async def m(self) -> dict:  # note\n         pass\n\n"
        "    def n(self):  pass\n\n\ny = 2\n"
    )
    ast.parse(r.skeleton)
    sm = D.source_map(files_of(spark, [("a.py", text)])).orderBy("pos").collect()
    assert [(x.symbol, x.original_start, x.original_end) for x in sm] == python_functions(text)


def test_brace_functions(spark):
    text = (
        "export function f(a, b) {\n  if (a) {\n    return 1;\n  }\n  return 2;\n}\n\n"
        "const g = async (x) => {\n  return x;\n};\n\nclass K {\n  run(a): void {\n    while (a) {\n    }\n  }\n}\n"
        "call({\n  a: 1\n});\nexport default function () {\n  go();\n}\n"
    )
    df = files_of(spark, [("a.ts", text)])
    assert D.skeletons(df).first().skeleton == (
        "export function f(a, b)  ...\n\nconst g = async (x) =>  ...;\n\nclass K {\n  run(a): void  ...\n}\n"
        "call({\n  a: 1\n});\nexport default function ()  ...\n"
    )
    assert [r.symbol for r in D.source_map(df).orderBy("pos").collect()] == ["f", "g", "run", "anonymous"]


def test_every_span_cuts_its_block(spark, sf_dir):
    files = X.source_files(spark, sf_dir)
    sm = D.source_map(files, B.PAGE_KINDS)
    texts = D.block_texts(files, B.PAGE_KINDS).select("path", "pos", "body")
    rows = sm.join(files.select("path", "text"), "path").join(texts, ["path", "pos"]).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.text.encode()[r.original_start : r.original_end].decode() == r.body
        assert r.file_size == len(r.text.encode())


def test_spans_count_bytes_not_characters(spark):
    text = "é<nav>ü</nav>ß<NAV>x</NAV>"
    rows = D.source_map(files_of(spark, [("a.js", text)]), B.PAGE_KINDS).orderBy("pos").collect()
    assert [(r.symbol, r.type, r.original_start, r.original_end) for r in rows] == [
        ("nav_0", "nav", 2, 15), ("nav_1", "nav", 17, 29),
    ]
    none = D.source_map(files_of(spark, [("a.js", "no block"), ("b.js", ""), ("c.md", text)]), B.PAGE_KINDS)
    assert none.count() == 0


def test_oversize_file_becomes_a_summary(spark):
    text = "def f():\n    return 'ü'\n" * 5
    df = files_of(spark, [("big.py", text), ("small.py", "x = 1\n")])
    sk = {r.path: r for r in D.skeletons(df, limit=20).collect()}
    n = len(text.encode())
    assert sk["big.py"].skeleton == f"# [GCS CIRCUIT BREAKER] big.py\n# Nodes: 21 > 20\n# Size: {n} bytes\n"
    assert sk["small.py"].skeleton == "x = 1\n"
    assert D.source_map(df, limit=20).count() == 0


def test_secrets_go_before_elision(spark):
    text = "token = 'abc'\n\n\ndef f():\n    password = 'x'\n    return 1\n"
    df = files_of(spark, [("a.py", text), ("b.md", 'my token: "abc"')])
    counts = spark.createDataFrame([("a.py", "f", 7), ("a.py", "other", 9)], "path string, symbol string, n_lookups long")
    sk = {r.path: r.skeleton for r in D.skeletons(df, counts=counts).collect()}
    assert sk["a.py"] == (
        'token = "[REDACTED]"\n\n\ndef f():\n     password = "[REDACTED]"\n    return 1\n        ... (semantic truncation)\n'
    )
    assert sk["b.md"] == 'my token: "[REDACTED]"'


@pytest.mark.parametrize("n, want", [(1, " # [SEMANTIC_L2]"), (4, " # [SEMANTIC_L1]"), (5, " # [SEMANTIC_L1] [HOT_SYMBOL]"), (0, "")])
def test_hints(spark, n, want):
    assert spark.range(1).select(B.hint(F.lit(n)).alias("h")).first().h == want


@pytest.mark.parametrize("body", ["a\nb\n", "\n".join(str(i) for i in range(15)), "x", "a\r\nb\rc", "\n".join(str(i) for i in range(10)) + "\n"])
def test_first_lines(spark, body):
    want = " " + "\n".join(body.splitlines()[:10]) + "\n        ... (semantic truncation)"
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(B.first_lines(F.col("b")).alias("h")).first().h == want


def test_containment(spark):
    df = spark.createDataFrame([("/repo/a.py",), ("/repository/a.py",), ("/repo",), ("/x/repo/a.py",)], "path string")
    kept, rest = D.inside_root(df, "/repo")
    assert {r.path for r in kept.collect()} == {"/repo/a.py", "/repo"}
    assert rest.count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20), st.integers(0, 9000))
def test_alignment(spark, texts, more):
    rows = [(t.encode("utf-8", "ignore").decode() + "x" * more,) for t in texts]
    df = spark.createDataFrame(rows, "t string").select("t", B.align(F.col("t")).alias("a"), B.aligned_size(B.size(F.col("t"))).alias("n"))
    for t, a, n in df.collect():
        size = len(t.encode())
        assert len(a.encode()) == n and n % 4096 == 0 and 64 <= n - size < 64 + 4096
        assert a.startswith(t) and a[len(t):].startswith(f"\n<!-- GCS_HYSTERESIS_PADDING_{n - size} -->")


def test_short_padding_is_spaces(spark):
    got = spark.range(1).select(B.align(F.lit("abc"), block=8, slack=1).alias("a")).first().a
    assert got == "abc     "


def test_hot_symbols_threshold(spark):
    rows = [("a",)] * 5 + [("b",)] * 4
    df = spark.createDataFrame(rows, "key string")
    assert [(r.key, r.n_lookups) for r in D.hot_symbols(df, ("key",)).collect()] == [("a", 5)]
    assert fixed.HOT_LOOKUPS == 5


def test_functions_of_all_layouts():
    from tidemark.functions import scan as S

    ts = """export function f({a, b}: P, c = {x: 1}): { ok: boolean } {
  return {};
}
const g = async (x) => { return `a${x ? `}` : "{"}`; };
const h = x => {
  y();
};
class K<T> {
  constructor(private a: string) { super(); }
  async run<T>(
    a: T,
  ): Promise<Map<string, T>> {
    while (a) { }
  }
  get v() { return 1 }
}
items.map((i) => { return i; }).forEach(function (k) { k(); });
if (a) { b(); } else { c(); }
export default function () {
  go(/[}]/g);
}
const o = { m() { return 1; }, n: function* gen() { yield 1; }, p: 3 };
interface I { run(a: string): { x: number }; q(): void }
"""
    got = [(symbol, kind) for _, _, _, kind, symbol in S.brace_blocks(ts)]
    fn, arrow, method = "function_declaration", "arrow_function", "method_definition"
    assert got == [
        ("f", fn), ("g", arrow), ("h", arrow), ("constructor", method), ("run", method), ("v", method), ("anonymous", arrow),
        ("anonymous", fn), ("anonymous", fn), ("m", method), ("gen", "generator_function_declaration"),
    ]
    for _, body, end, _, _ in S.brace_blocks(ts):
        assert ts[body] == "{" and ts[end - 1] == "}"
    py = "def f(a):  # x\n# zero\n    '''\ntext\n'''\n# zero\n    return a\n# after\ny = 2\nasync def g(): return {\n1: 2}\n"
    assert [py[b:e] for _, b, e, _, _ in S.python_blocks(py)] == ["'''\ntext\n'''\n# zero\n    return a", "return {\n1: 2}"]


@pytest.mark.parametrize("name, part", [
    ("page_blocks", "<nav>"), ("page_blocks", "<nav "), ("page_blocks", "<nav>x</nav>"), ("python_blocks", "# c\n"), ("python_blocks", '"""'),
    ("brace_blocks", "f() {\n"), ("brace_blocks", "`${"), ("brace_blocks", "a=/[x"), ("brace_blocks", "function f() { a(); }\n"),
])
def test_scanners_are_linear(name, part):
    import time

    from tidemark.functions import scan as S

    def seconds(n):
        start = time.perf_counter()
        getattr(S, name)("def f():\n" + part * n)
        return time.perf_counter() - start

    assert seconds(20_000) < 2
    # the best of a few runs: other work on the machine only adds
    least = lambda n: min(seconds(n) for _ in range(4))
    assert least(40_000) < 2.5 * max(least(20_000), 0.2)


PROBES = [
    ("a.js", "// use ` here\nfunction token() { return 'it' }\n// and ` there\nlet password = /* it's */ 'hunter2';\n"),
    ("b.py", "# it's the password = 'hunter2'\nx = 1  # `a\ndef f(a):\n    # don't\n    token = 'hunter2'\n    return a\n\ny = 2  # `b\n"),
    ("c.ts", "const secret = 'hunter2'; class A { m() { return /['\"]/ } }\n// it's\nfunction g() { return `${1}` }\n"),
]


def test_skeletons_and_spans_hold_the_same_blocks(spark):
    files = spark.createDataFrame([(p, p.split(".")[1], t, len(t.encode())) for p, t in PROBES], "path string, ext string, text string, n_bytes long")
    spans = {}
    for r in D.source_map(files).collect():
        spans.setdefault(r.path, []).append((r.original_start, r.original_end))
    made = {r.path: r for r in D.cut(files).collect()}
    for path, text in PROBES:
        assert [(s.original_start, s.original_end) for s in made[path].spans] == sorted(spans[path])
        skeleton, at, data = made[path].skeleton, 0, text.encode()
        assert "hunter2" not in skeleton
        mark = " pass" if path.endswith("py") else " ..."
        assert skeleton.replace("password", "").count(mark) == len(spans[path])
        # what is between the blocks is in the skeleton, but for the secret values
        for a, b in [*sorted(spans[path]), (len(data), len(data))]:
            kept = data[at:a].decode().replace("'hunter2'", '"[REDACTED]"')
            assert kept in skeleton
            at = b
    assert "function token()" in made["a.js"].skeleton and "x = 1  # `a" in made["b.py"].skeleton


def test_texts_reach_the_scanners_in_small_batches(spark):
    files = files_of(spark, [(f"p{i}.py", f"def f{i}():\n    return {i}\n") for i in range(2500)]).coalesce(1)
    for run in (D.cut, D.source_map, D.block_texts):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        assert run(files).count() == 2500
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
