"""Main text of web pages by union-free wrappers of their hosts.

All different pages of a host are read as nested token streams and aligned one
after another, chunk by chunk; the wrappers of the chunks are then aligned in
rounds. Where streams differ, the mismatch is resolved as an
optional group (tags that only some pages have), a repeated group (neighbouring
elements of one signature fold into one) or a text slot (texts that differ).
What remains is a regular expression without unions: the wrapper.

Every page is then read along its host's wrapper. Menus, headers, footers,
sidebars, notices, adverts, forms, comments and markup are left out by the names
of their elements, the main containers are found (all articles of a page that
stand in no other one and in no part that is left out, or all neighbours of one
name), and text that the wrapper shows to be the same on the host's pages is
template and left out too, except in paragraphs and the like of a marked article.
Nothing else is dropped or cut.

Defined results: null html is empty; null urls and urls without host share one
wrapper; a host with one page, or pages that fit no wrapper, are read by the
names alone; a page without text gives an empty string; repeated rows are
repeated; an empty table gives an empty result; columns named like a result are
replaced.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import replace_columns, small_batches
from tidemark.session import stage

CHUNK = 512  # pages of a host that one task aligns
MERGED = 16  # wrappers that one task aligns
SUPPORT = 3  # pages that must agree before a text counts as template; half of the host's pages also must
DEPTH = 64  # levels that are aligned
AHEAD = 50  # parts of a wrapper that are tried for an element
CELLS = 40_000  # of one alignment table; longer lists align in order

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY = {  # an open element that the start of another one ends
    tag: frozenset(ended.split()) for tag, ended in {
        "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
        "tbody": "tr td th thead tbody", "tfoot": "tr td th tbody", "option": "option",
    }.items()
}
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
P = frozenset({"p"})
BOUNDARY = frozenset("table td th ul ol dl body html article section div main aside form blockquote".split())
OUT = frozenset(
    "script style noscript template nav footer aside form button select textarea iframe svg canvas object embed head menu dialog "
    "input map audio video noembed noframes xmp".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsbygoogle banner promo promos promotion sponsor sponsored sponsors "
    "sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar footer cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations trending popular comment comments discussion disqus respond replies reply pagination "
    "pager toolbar search copyright disclaimer hidden".split()
)
HEADER_NAMES = frozenset("header head".split())
NOT_OWN = frozenset("has with no without".split())  # "has-sidebar" names what is elsewhere
MAIN_NAMES = frozenset("article content post entry story main body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_IN_ARTICLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption".split())
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and strings
    holds: bool = False  # an article or main element is below
    length: int = 0  # characters of text that are not left out

    @property
    def signature(self) -> str:
        return ".".join([self.tag, *sorted(self.attributes.get("class", "").split())])

    def names(self) -> list[str]:
        words = f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}"
        return [p.lower() for p in NAME_PART.findall(words)]

    def own_names(self) -> list[str]:
        names = self.names()
        return [n for n, before in zip(names, ["", *names]) if before not in NOT_OWN]


def _tag_end(data: str, at: int, lost: set[str]) -> int:
    """Place of the ``>`` that ends a tag, quoted ones passed over; -1 if there is none."""
    stop = re.compile(r"[>\"']")
    while True:
        m = stop.search(data, at)
        if m is None:
            return -1
        at = m.end()
        if m[0] == ">":
            return m.start()
        if m[0] not in lost and data[m.start() - 1] == "=":
            end = data.find(m[0], at)
            if end < 0:
                lost.add(m[0])
            else:
                at = end + 1


def tokens(data: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): open, close and text tokens, in one pass over the page."""
    at, size, lost = 0, len(data), set()
    while at < size:
        start = data.find("<", at)
        if start < 0:
            yield "text", data[at:], ""
            return
        if start > at:
            yield "text", data[at:start], ""
        if data.startswith("<!--", start):
            end = data.find("-->", start + 4) if "-->" not in lost else -1
            if end < 0:
                lost.add("-->")
            at = end + 3 if end >= 0 else size
            continue
        follows = data[start + 1:start + 3]
        if follows[:1] in ("!", "?"):
            end = data.find(">", start)
            at = end + 1 if end >= 0 else size
            continue
        if not (follows[:1].isascii() and follows[:1].isalpha() or follows[:1] == "/" and follows[1:].isascii() and follows[1:].isalpha()):
            yield "text", "<", ""
            at = start + 1
            continue
        end = _tag_end(data, start + 1, lost)
        if end < 0:
            return
        inside = data[start + 1:end]
        at = end + 1
        closing = inside[0] == "/"
        m = re.match(r"[^\s/>]+", inside[1:] if closing else inside)
        name = m[0].lower()
        if closing:
            yield "close", name, ""
            continue
        yield "open", name, inside[m.end():]
        if name in RAW and not inside.endswith("/"):
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(data, at)
            stop = m.start() if m else size
            if stop > at:
                yield "text", data[at:stop], ""
            at = stop


def parse_page(data: str | None) -> Node:
    """The tree of a page; tags that are left open or cross are mended as browsers do, roughly."""
    root = Node("html")
    stack, opened = [root], Counter()

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    for kind, name, rest in tokens(data or ""):
        if kind == "text":
            stack[-1].children.append(name)
            continue
        if kind == "close":
            for i in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                if stack[i].tag == name:
                    close(i)
                    break
                if stack[i].tag in BOUNDARY and name not in BLOCKS:
                    break
            continue
        if name == "html":
            continue
        closed = CLOSED_BY.get(name, frozenset()) | (P if name in CLOSES_P else frozenset())
        if any(opened[t] > 0 for t in closed):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closed:
                    close(i)
                elif stack[i].tag in BOUNDARY:
                    break
        attributes = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(rest)}
        node = Node(name, attributes)
        stack[-1].children.append(node)
        if name in ("article", "main"):
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        if name not in VOID:
            stack.append(node)
            opened[name] += 1
    return root


# ---- wrappers ----

@dataclass
class Part:
    """A piece of a wrapper: an element with its parts, or a text (signature #)."""

    signature: str
    parts: list[Part] = field(default_factory=list)
    text: str | None = None  # the constant text; None: a slot
    optional: bool = False
    repeated: bool = False
    pages: int = 1

    def pattern(self) -> str:
        inner = "".join(p.pattern() for p in self.parts)
        if self.signature == "#":
            body = re.escape(self.text) if self.text is not None else "(.*)"
        else:
            body = f"<{self.signature}>{inner}</>"
        tail = "*" if self.optional and self.repeated else "+" if self.repeated else "?" if self.optional else ""
        return f"(?:{body}){tail}" if tail else body

    def packed(self) -> list:
        return [self.signature, self.text, self.pages, [p.packed() for p in self.parts]]

    def stored(self) -> list:
        return [self.signature, self.text, self.pages, [p.stored() for p in self.parts], self.optional, self.repeated]

    @staticmethod
    def restored(held: list) -> Part:
        signature, text, pages, parts, optional, repeated = held
        return Part(signature, [Part.restored(p) for p in parts], text, optional, repeated, pages)


def plain(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def _folded(parts: list[Part]) -> list[Part]:
    """Neighbours of one signature become one repeated part."""
    out: list[Part] = []
    for p in parts:
        if out and out[-1].signature == p.signature:
            pages, optional = max(out[-1].pages, p.pages), out[-1].optional and p.optional
            out[-1] = _merged(out[-1], p)
            out[-1].pages, out[-1].optional, out[-1].repeated = pages, optional, True
        else:
            out.append(p)
    return out


def part_of(node: Node, depth: int = 0) -> Part:
    """A page's element as a wrapper that fits it alone."""
    parts = []
    for c in node.children if depth < DEPTH else []:
        if isinstance(c, Node):
            if c.tag not in OUT and c.tag not in VOID:
                parts.append(part_of(c, depth + 1))
        elif plain(c):
            parts.append(Part("#", text=plain(c)))
    return Part(node.signature, _folded(parts))


def _matches(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of signatures; of long lists, the matches met in order."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    if len(a) * len(b) > CELLS:
        out, j = [], 0
        for i, s in enumerate(a):
            if s in b[j:j + AHEAD]:
                j = b.index(s, j)
                out.append((i, j))
                j += 1
        return out
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _merged(a: Part, b: Part) -> Part:
    """The wrapper of what either fits: mismatches become optional parts, repeats or slots."""
    out = Part(a.signature, optional=a.optional or b.optional, repeated=a.repeated or b.repeated, pages=a.pages + b.pages)
    if a.signature == "#":
        out.text = a.text if a.text == b.text else None
        return out
    parts, i, j = [], 0, 0
    for x, y in [*_matches([p.signature for p in a.parts], [p.signature for p in b.parts]), (len(a.parts), len(b.parts))]:
        for p in a.parts[i:x] + b.parts[j:y]:
            p.optional = True
            parts.append(p)
        if x < len(a.parts):
            parts.append(_merged(a.parts[x], b.parts[y]))
        i, j = x + 1, y + 1
    out.parts = _folded(parts)
    return out


def infer_wrapper(pages: list[str | None]) -> Part | None:
    """The wrapper of a host's pages, aligned one after another."""
    wrapper = None
    for page in pages:
        part = part_of(parse_page(page))
        wrapper = part if wrapper is None else _merged(wrapper, part)
    return wrapper


# ---- extraction ----

def _named_out(own: list[str]) -> bool:
    return any(n in OUT_NAMES for n in own)


def _is_out(node: Node, in_main: bool) -> bool:
    """Is an element no part of the article, by its name, role, class and id?"""
    if node.tag in OUT:
        return True
    a = node.attributes
    if a.get("role", "").lower() in OUT_ROLES or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if node.tag in ("html", "body", "article", "main", *HEADINGS):
        return False
    own = node.own_names()
    if _named_out(own):
        return not node.holds
    if not in_main and (node.tag == "header" or any(n in HEADER_NAMES for n in own)):
        return not node.holds
    return False


def _is_header(node: Node) -> bool:
    return node.tag == "header" or node.tag == "div" and any(n in HEADER_NAMES for n in node.names())


def _measure(root: Node) -> None:
    """Set the length of every element, from the innermost ones outwards."""
    nodes = [root]
    for n in nodes:
        nodes += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(nodes):
        n.length = sum(len(c.strip()) if isinstance(c, str) else 0 if _is_out(c, True) else c.length for c in n.children)


def main_containers(root: Node) -> tuple[list[Node], bool]:
    """The elements that hold the article, in page order, and whether the page marks them as such."""
    _measure(root)
    inside, stack = [], [(root, None, False)]  # element, its parent, is it below one that is left out by name
    while stack:
        n, above, aside = stack.pop()
        inside.append((n, above, aside))
        aside = aside or n.tag not in ("html", "body", "article", "main") and _named_out(n.own_names())
        stack += [(c, n, aside) for c in reversed(n.children) if isinstance(c, Node) and not _is_out(c, False)]
    for test in (
        lambda n: n.tag == "article",
        lambda n: n.tag == "main" or n.attributes.get("role") == "main",
        lambda n: "articlebody" in n.attributes.get("itemprop", "").lower(),
    ):
        found = [(n, aside or _named_out(n.own_names())) for n, _, aside in inside if test(n) and n.length]
        found = [n for n, aside in found if not aside] or [n for n, _ in found]
        if found:
            return _outermost(found), True
    named = [(n, above) for n, above, _ in inside if n.tag in ("div", "section", "td") and MAIN_NAMES.intersection(n.names())]
    most = max((n.length for n, _ in named), default=0)
    if most and most >= 0.3 * root.length:
        best, above = [(n, above) for n, above in named if n.length >= 0.6 * most][-1]  # the innermost that still holds most
        return [n for n, parent in named if parent is above and n.signature == best.signature and n.length], False
    return [root], False


def _outermost(found: list[Node]) -> list[Node]:
    """Those of some elements, in page order, that are in none of the others."""
    out, within, chosen = [], set(), {id(n) for n in found}
    for n in found:
        if id(n) in within:
            continue
        out.append(n)
        stack = [n]
        while stack:
            for c in stack.pop().children:
                if isinstance(c, Node):
                    stack.append(c)
                    if id(c) in chosen:
                        within.add(id(c))
    return out


def _template(root: Node, wrapper: list) -> dict[int, set[str]]:
    """Texts of the page that the wrapper has as constants, by the id of their element."""
    found: dict[int, set[str]] = {}
    support = max(SUPPORT, wrapper[2] / 2)
    stack = [(root, wrapper)]
    while stack:
        node, (_, _, _, parts) = stack.pop()
        at = 0
        for c in node.children:
            if isinstance(c, str):
                signature, text = "#", plain(c)
                if not text:
                    continue
            elif c.tag in OUT or c.tag in VOID:
                continue
            else:
                signature, text = c.signature, None
            for i in range(max(at - 1, 0), min(at + AHEAD, len(parts))):  # the last part may repeat
                if parts[i][0] == signature:
                    at = i + 1
                    if text is None:
                        stack.append((c, parts[i]))
                    elif parts[i][1] == text and parts[i][2] >= support:
                        found.setdefault(id(node), set()).add(text)
                    break
    return found


def _blocks(main: Node, marked: bool, template: dict[int, set[str]]) -> list[str]:
    blocks, line = [], []

    def end() -> None:
        text = plain("".join(line))
        line.clear()
        if text:
            blocks.append(text)

    # (what, inside a header, inside a paragraph or the like)
    stack: list[tuple[Node | str | None, bool, bool]] = [(main, False, False)]
    while stack:
        item, header, kept = stack.pop()
        if item is None:
            end()
            continue
        if isinstance(item, str):
            line.append(item)
            continue
        if item.tag == "br":
            line.append(" ")
            continue
        if item is not main and _is_out(item, True):
            line.append("" if item.tag not in BLOCKS else " ")
            continue
        header = header or item is not main and _is_header(item)
        kept = kept or marked and item.tag in KEPT_IN_ARTICLE
        block = item.tag in BLOCKS
        if block:
            end()
            stack.append((None, False, False))
        constant = template.get(id(item), ()) if not kept else ()
        silent = header and item.tag not in HEADINGS  # of an article's header its headings stay
        for c in reversed(item.children):
            if isinstance(c, str):
                if not silent and plain(c) not in constant or not c.strip():
                    stack.append((c, header, kept))
            else:
                stack.append((c, header and item.tag not in HEADINGS, kept))
    end()
    return blocks


def extract_text(page: str | None, wrapper: list | None = None) -> str:
    """The main text: blocks in page order, one a line."""
    root = parse_page(page)
    mains, marked = main_containers(root)
    template = _template(root, wrapper) if wrapper else {}
    blocks = [b for main in mains for b in _blocks(main, marked, template)]
    if template and not blocks:
        blocks = [b for main in mains for b in _blocks(main, marked, {})]  # all of it is on every page read, so it is no template
    return "\n".join(blocks)


def with_host(pages: DataFrame, url_col: str = "url") -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.withColumn("_host", host)


def _aligned(rows: DataFrame, part) -> DataFrame:
    """One row (host, chunk, n_pages, part) per host and chunk of rows (host, chunk, key, what ``part`` reads): the wrapper of them all.

    Rows of a chunk are read in the order of their keys, one at a time; of equal
    keys the first counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, last, n, wrapper = None, None, 0, None

        def row() -> pa.RecordBatch:
            columns = [[chunk[0]], [chunk[1]], [n], [json.dumps(wrapper.stored())]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["host", "chunk", "n_pages", "part"]
            )

        for b in batches:
            for host, at, key, n_pages, text in zip(*[c.to_pylist() for c in b.columns]):
                if (host, at) != chunk:
                    if wrapper is not None:
                        yield row()
                    chunk, last, n, wrapper = (host, at), None, 0, None
                if key == last:
                    continue
                found = part(text)
                last, n, wrapper = key, n + n_pages, found if wrapper is None else _merged(wrapper, found)
        if wrapper is not None:
            yield row()

    dealt = rows.repartition("host", "chunk").sortWithinPartitions("host", "chunk", "key")
    return dealt.mapInArrow(run, "host string, chunk bigint, n_pages bigint, part string")


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows of one key (host, html, key) the first of the task, so that many copies of a page do not meet in one."""
    seen: set[int] = set()
    for b in batches:
        keep = []
        for key in b.column(2).to_pylist():
            keep.append(key not in seen)
            seen.add(key)
        yield b.filter(pa.array(keep, pa.bool_()))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", chunk: int = CHUNK, merged: int = MERGED) -> DataFrame:
    """(host, n_pages, pattern, packed) per host with two different pages or more, inferred from all of them.

    No task reads more than about ``chunk`` different pages of a host, or
    ``merged`` wrappers, whatever share of the pages a host has.
    """
    small_batches(pages.sparkSession)
    hosts = with_host(pages, url_col).select(F.col("_host").alias("host"), F.col(html_col).alias("html")).filter("html is not null")
    rows = hosts.withColumn("key", F.xxhash64("host", "html"))
    chunks = stage(rows.groupBy("host").agg(F.ceil(F.count("*") / chunk).alias("chunks")), "chunks")
    rows = rows.mapInArrow(_first_of_task, rows.schema).join(chunks, "host").select("host", F.expr("pmod(key, chunks)").alias("chunk"), "key", F.lit(1).cast("bigint").alias("n_pages"), "html")
    got = stage(_aligned(rows, lambda html: part_of(parse_page(html))), "wrappers")
    most = chunks.agg(F.max("chunks")).first()[0] or 1
    while most > 1:
        some = got.select("host", F.expr(f"chunk div {merged}").alias("chunk"), F.col("chunk").alias("key"), "n_pages", "part")
        got = stage(_aligned(some, lambda part: Part.restored(json.loads(part))), "wrappers")
        most = -(-most // merged)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Part.restored(json.loads(p)) for p in b.column(2).to_pylist()]
            columns = [pa.array([p.pattern() for p in found], pa.string()), pa.array([json.dumps(p.packed()) for p in found], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["host", "n_pages", "pattern", "packed"])

    got = got.filter("n_pages > 1").select("host", "n_pages", "part")
    return stage(got.mapInArrow(finish, "host string, n_pages bigint, pattern string, packed string"), "wrappers")


def extract_pages(
    pages: DataFrame, carry: list[str] | None = None, url_col: str = "url", html_col: str = "html", chunk: int = CHUNK
) -> DataFrame:
    """The pages' columns ``carry`` (all but the html if None), text and n_chars."""
    wrappers = infer_wrappers(pages, url_col, html_col, chunk).select(F.col("host").alias("_host"), F.col("packed").alias("_packed"))
    carry = carry or [c for c in replace_columns(pages, "text", "n_chars", html_col).columns]
    wide = with_host(pages.select(*dict.fromkeys([*carry, url_col, html_col])), url_col)
    wide = wide.join(wrappers, "_host", "left").select(*carry, F.col(html_col).alias("_html"), "_packed")
    schema = T.StructType([*[pages.schema[c] for c in carry], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, wrapper = None, None
        for b in batches:
            n, texts = b.num_columns, []
            for page, packed in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist()):
                if packed != held:
                    held, wrapper = packed, json.loads(packed) if packed else None
                texts.append(extract_text(page, wrapper))
            found = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:n - 2], *found], names=schema.names)

    return wide.mapInArrow(run, schema)
