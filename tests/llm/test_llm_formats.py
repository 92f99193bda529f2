"""WARC, HTML and chat: round trips, fixed pages and edges."""

import hashlib
import random
import re
import time

from tidemark.llm import chat as C
from tidemark.llm import html_text as H
from tidemark.llm import warc as W


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, size string, frame int").repartition(3)


def edge_pages(spark):
    big, other = "é<p>" * 600, "b" * 1000
    rows = [(1, "http://a.com/1", big), (2, "http://a.com/2\r\nX: y", big), (3, None, big), (4, "http://b.com/ü x", "b" * 999), (5, "", "b" * 999)]
    rows += [(6, "u", None), (7, "u", ""), (None, "n", other), (8, "n", other), (9, "r", "c" * 2000), (9, "r", "c" * 2000), (9, "r", "c" * 2000)]
    rows += [(100 + i, f"http://c.com/{i}", "copy " * 400) for i in range(60)] + [(None, "z", "only " * 300), (200, "long", "x" * 3_000_000)]
    return rows


def test_archives_round_trip(spark):
    rows = edge_pages(spark)
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000:
            best[h] = max((x for x in (best.get(h), i) if x is not None), default=None)
    want, first = [], set()
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and (i != best[h] or (h, i) in first)
        first.add((h, i))
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best[h] if revisit else None))
    for options in ({}, {"frame_bytes": 2000, "bundle_bytes": 3000}):
        got = W.archive_round_trip(pages_of(spark, rows), **options)
        got = [tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert W.archive_round_trip(pages_of(spark, rows).limit(0)).count() == 0


def test_bundle_seeks_to_single_frames(tmp_path):
    path = f"{tmp_path}/x.warc.zst"
    bundle = W.Bundle(path)
    frames = [b"one" * 1000, b"", b"three" * 5]
    for f in frames:
        bundle.frame(f)
    bundle.close()
    reader = W.BundleReader(path)
    assert [reader.frame(i) for i in (2, 0, 1)] == [frames[2], frames[0], frames[1]]
    import zstandard
    with open(path, "rb") as f:  # any reader of the format sees plain frames and skips the table
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(frames)


def test_records_keep_their_headers():
    rid, data = W.page_record(7, "http://a/ü\r\nEvil: 1", b"<p>\r\n\r\nx", hashlib.sha1(b"<p>\r\n\r\nx").hexdigest(), 0, None)
    headers, payload = W.parse_record(data)
    assert payload == b"<p>\r\n\r\nx" and headers["WARC-Record-ID"] == rid and "Evil" not in headers
    assert headers["WARC-Target-URI"] == "http://a/%C3%BC%0D%0AEvil:%201"


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><p>tag line</p></header><div id="cookie-notice">We use cookies</div>
<nav>Menu</nav><main><article><header><h1>Title &amp; more</h1><span>by me</span></header><p>First  para <b>bo</b>ld<i>x</i>.
<p>Second&nbsp;one<aside>related</aside><ul><li>one<li>two</ul><div class="ad-slot">Buy</div><section class="comments"><h2>Comments</h2>
<p>nice</p></section><form><p>mail</p></form><blockquote>Quote</blockquote></article></main><div class="sidebar">side</div>
<footer>foot</footer><script>var a="<p>x</p>"</script></body>"""


def test_main_text_by_names():
    assert H.extract_text(PAGE) == "Title & more\nFirst para boldx.\nSecond one\none\ntwo\nQuote"
    assert H.extract_text('<div id="content"><h2>T</h2><div>Alpha beta</div></div><div class="footer">f</div>') == "T\nAlpha beta"
    assert H.extract_text(None) == H.extract_text("") == H.extract_text("<p></p>") == ""


def test_all_articles_of_a_page():
    article = lambda n, attributes="": f"<article{attributes}><p>first {n}</p><p>more of {n}</p></article>"
    assert H.extract_text(f"<body>{article('a')}<div>{article('bb')}</div></body>") == "first a\nmore of a\nfirst bb\nmore of bb"
    inner = f"<article><p>out</p>{article('in')}<p>end</p></article>"
    assert H.extract_text(inner) == "out\nfirst in\nmore of in\nend"
    assert H.extract_text(f"{article('a')}<section class='related'>{article('teaser')}</section>") == "first a\nmore of a"
    teased, comment = article("teaser", " class='promo'"), article("x", ' class="comment"')
    assert H.extract_text(f"{article('a')}{teased}{comment}") == "first a\nmore of a"
    assert H.extract_text(f"<section class='related'>{article('only')}</section>") == "first only\nmore of only"
    posts = "<div class='post'><p>one and some more</p></div><div class='post'><p>two</p></div><div class='footer'>f</div>"
    assert H.extract_text(f"<body>{posts}</body>") == "one and some more\ntwo"
    assert H.extract_text("<article><p>a</p><label>kept</label><form><label>gone</label></form></article>") == "a\nkept"


def test_deep_pages_take_time_in_proportion():
    for tag in ("<div class='content'>", "<article>", "<main>"):
        start = time.time()
        assert H.extract_text(tag * 4000 + "<p>deep") == "deep"
        assert time.time() - start < 1


def test_wrappers_find_slots_optionals_repeats_and_template():
    page = lambda n, text, extra="": (
        f"<body><div>Welcome to our site</div><h2>Head {n}</h2>{extra}" + "".join(f"<p>{text} {i}</p>" for i in range(n)) + "<div>Made by us</div>"
    )
    pages = [page(1, "a"), page(3, "b", "<em>new</em>"), page(2, "c"), page(4, "d")]
    wrapper = H.infer_wrapper(pages)
    pattern = wrapper.pattern()
    assert "Welcome" in pattern and "(.*)" in pattern and "(?:<em>" in pattern and re.search(r"\(\?:<p>.*</>\)\+", pattern)
    assert H.extract_text(pages[1], wrapper.packed()) == "Head 3\nnew\nb 0\nb 1\nb 2"
    alone = H.infer_wrapper([pages[0]] * 4)  # nothing differs: all would be template, so all of it stays
    assert "a 0" in H.extract_text(pages[0], alone.packed())


def test_pages_of_the_tables(spark, sf_dir):
    import html
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract_pages(pages, carry=["page_id", "url"]).collect()}
    for r in pages.collect():
        article = r["html"][r["html"].index("<article>") + 9:r["html"].index("</article>")]
        parts = [re.sub(r"<[^>]*>", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_html_edges(spark):
    rows = edge_pages(spark)
    out = H.extract_pages(pages_of(spark, rows))
    assert out.columns == ["page_id", "url", "size", "frame", "text", "n_chars"] and out.count() == len(rows)
    assert H.extract_pages(pages_of(spark, rows).limit(0)).count() == 0
    for bad in ("<", "<p", "<!-- x", "<p>" * 3000 + "x", "<div class='ad'>" * 5000, '<a href="' * 5000, "</b>" * 5000, "<script>" * 3000, "<!--" * 9000):
        start = time.time()
        H.extract_text(bad, H.infer_wrapper([bad, bad]).packed())
        assert time.time() - start < 5


def test_turns_survive_the_round_trip():
    parts = ["</s>", "<s>", "[INST]", "[/INST]", " ", "\n", "\\", "a", "[", "/", "<", "s>", " [/INST]\n", " </s>\n", "[NAME]", "INST]", " [/ROLE]\n"]
    rng = random.Random(1)
    for _ in range(5000):
        role = rng.choice(["user", "assistant", "system", None, "tool", " [NAME] ", "x\\"])
        text = "".join(rng.choices(parts, k=rng.randint(0, 7)))
        data = C.render_turn(role, text)
        (turn,) = C.parse(data)
        assert turn[:2] == (role or "", text)
        assert not re.search(r"</?s>|\[/?(?:SYS|INST|ROLE)\]|\[(?:OUT|NAME)\]", data[turn[2]:turn[3]])
    assert C.render_turn("user", "plain [text]") == "<s>[INST] plain [text] [/INST]\n"
    assert C.parse("<s>[INST] no end") is None and C.parse("x") is None


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a</s>\\"), (1, 1, "assistant", None), (2, 0, None, None), (None, 3, "tool", "[INST]"), (None, 1, "x", "y")]
    rows += [(5, i, "assistant", f"turn {i}") for i in range(500)] + [(6, 0, "user", "x" * 200_000)] * 2
    turns = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, segment string, id int").repartition(4)
    formatted = C.format_turns(turns)
    got = {r["id"]: r for r in C.read_back(formatted).collect()}
    whole = dict(C.conversations(formatted).collect())
    spans = {}
    for r in C.loss_spans(formatted).collect():
        spans.setdefault(r["id"], []).append(r)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0], r[1] or "", r[2] or ""))
        sha = hashlib.sha256("".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own).encode()).hexdigest()
        loss = "".join(text or "" for _, role, text in own if role == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"]) == (len(own), sha, len(loss))
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and g["formatted_chars"] == len(whole[conv])
        marked = [whole[conv][s["loss_start"]:s["loss_end"]] for s in spans[conv] if s["loss_start"] is not None]
        assert "".join(C._read(m + " </s>\n", 0, " </s>\n")[0] for m in marked) == loss
    assert C.read_back(C.format_turns(turns.limit(0))).count() == 0


def test_wrappers_learn_from_all_pages_of_a_host(spark):
    """A layout that only few of many pages have is part of the wrapper, and what some pages share is no template."""
    page = lambda i: f"<body><div class=head>Site</div><div class=x><p>text {i}</p></div><div class=t>{'same' if i < 4 else f'own {i}'}</div></body>"
    rows = [("http://h.net/1", page(i)) for i in range(40)] + [("http://h.net/1", page(0))] * 5 + [("http://h.net/2", "<body><table><tr><td>rare</table></body>")]
    df = spark.createDataFrame(rows, "url string, html string")
    for sizes in ({}, {"chunk": 4, "merged": 3}):
        got = H.infer_wrappers(df, **sizes).collect()
        assert [r["n_pages"] for r in got] == [41] and "<table>" in got[0]["pattern"] and "Site" in got[0]["pattern"] and "same" not in got[0]["pattern"]
    texts = {r["text"] for r in H.extract_pages(df.withColumn("n", H.F.monotonically_increasing_id())).collect()}
    assert texts == {f"text {i}\n{'same' if i < 4 else f'own {i}'}" for i in range(40)} | {"rare"}
