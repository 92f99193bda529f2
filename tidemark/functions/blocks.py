"""Column expressions over delimited blocks of text: cut, measure, elide, align.

Sizes and spans count UTF-8 bytes. A block kind names the scanner of its blocks;
blocks of a kind do not nest, the outermost one is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import scan
from tidemark.functions.binding import let


@dataclass(frozen=True)
class BlockKind:
    """``scan`` names the scanner of a kind; ``units`` what counts as a unit; ``pattern`` its blocks as an expression, for tests."""

    scan: str
    units: str
    pattern: str = ""


def _tags(*names: str) -> str:
    return "(?is)" + "|".join(rf"<{n}\b[^>]*>.*?</{n}>" for n in names)


PAGE_BLOCKS = BlockKind("page_blocks", "<[A-Za-z]", _tags("script", "style", "nav", "article", "footer"))
PYTHON_FUNCTIONS = BlockKind("python_blocks", r"\w+|[^\s\w]")
BRACE_FUNCTIONS = BlockKind("brace_blocks", r"\w+|[^\s\w]")

CODE_KINDS = {"py": PYTHON_FUNCTIONS, "js": BRACE_FUNCTIONS, "ts": BRACE_FUNCTIONS, "tsx": BRACE_FUNCTIONS}
PAGE_KINDS = {ext: PAGE_BLOCKS for ext in fixed.SOURCE_EXTENSIONS}


def supported(ext: Column) -> Column:
    return ext.isin(*fixed.SOURCE_EXTENSIONS)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def size(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def by_kind(kinds: dict[str, BlockKind], ext: Column, make) -> Column:
    """``make(kind)`` of the row's extension; null for other extensions."""
    groups: dict[BlockKind, list[str]] = {}
    for e, kind in kinds.items():
        groups.setdefault(kind, []).append(e)
    out = F
    for kind, exts in groups.items():
        out = out.when(ext.isin(*exts), make(kind))
    return out


def count_units(text: Column, kind: BlockKind) -> Column:
    return F.regexp_count(text, F.lit(kind.units)).cast("bigint")


PIECE = pa.struct([
    ("gap", pa.string()), ("head", pa.string()), ("body", pa.string()), ("type", pa.string()), ("symbol", pa.string()),
    ("original_start", pa.int64()), ("original_end", pa.int64()),
])
PIECES = (
    "array<struct<gap: string, head: string, body: string, type: string, symbol: string, original_start: bigint, original_end: bigint>>"
)


def cut_text(text: str, name: str) -> list[dict]:
    """Pieces of a text: what is before a block, its head, its body with type, symbol and byte span; at last the rest."""
    out, at, n_bytes = [], 0, 0
    for start, body, end, kind, symbol in getattr(scan, name)(text):
        gap, head, inner = text[at:start], text[start:body], text[body:end]
        first = n_bytes + len(gap.encode()) + len(head.encode())
        n_bytes = first + len(inner.encode())
        out.append({"gap": gap, "head": head, "body": inner, "type": kind, "symbol": symbol, "original_start": first, "original_end": n_bytes})
        at = end
    out.append({"gap": text[at:]})
    return out


def cut_blocks(text: Column, kind: BlockKind) -> Column:
    """Array of (gap, head, body, type, symbol, span): the text in order, its last block empty.

    Finding where a block ends needs a scan with a memory, which expressions lack
    (as patterns they are quadratic or recurse), so the scanner runs over Arrow
    batches; nothing else of the work on texts leaves the JVM.
    """
    name = kind.scan

    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut_text(t, name) for t in texts.to_pylist()], pa.list_(PIECE))

    return cut(text)


def spans(pieces: Column) -> Column:
    """Array of byte spans of the block bodies, in reading order."""
    return F.transform(
        F.filter(pieces, lambda p: p["body"].isNotNull()),
        lambda p: F.struct(p["symbol"].alias("symbol"), p["type"].alias("type"), p["original_start"].alias("original_start"), p["original_end"].alias("original_end")),
    )


def rebuild(pieces: Column, replacement, kept=lambda text: text) -> Column:
    """The text with each block body replaced by ``replacement(piece)``, and ``kept`` of what is before it."""
    return F.array_join(
        F.transform(
            pieces,
            lambda p: F.when(p["body"].isNotNull(), F.concat(kept(F.concat(p["gap"], p["head"])), replacement(p))).otherwise(kept(p["gap"])),
        ),
        "",
    )


def placeholder(ext: Column) -> Column:
    return F.when(ext == "py", F.lit(fixed.PLACEHOLDER_PY)).otherwise(F.lit(fixed.PLACEHOLDER_OTHER))


def hint(n_lookups: Column, hot: int = fixed.HOT_LOOKUPS) -> Column:
    """Suffix that names the lookup tier of a block; empty when it was never looked up."""
    tier = F.concat(
        F.lit(fixed.HINT_PREFIX), F.when(n_lookups > 1, F.lit("L1")).otherwise(F.lit("L2")), F.lit("]"),
        F.when(n_lookups >= hot, F.lit(fixed.HINT_HOT)).otherwise(F.lit("")),
    )
    return F.when(n_lookups > 0, tier).otherwise(F.lit(""))


def first_lines(body: Column, lines: int = fixed.HOT_LINES) -> Column:
    """What is kept of a hot block: its first lines and a truncation mark."""
    text = F.regexp_replace(body, r"(\r\n|\r|\n)\z", "")
    kept = F.array_join(F.slice(F.split(text, r"\r\n|\r|\n", lines + 1), 1, lines), "\n")
    return F.concat(F.lit(" "), kept, F.lit(fixed.HOT_TRUNCATION))


def oversize_summary(path: Column, units: Column, n_bytes: Column, limit: int) -> Column:
    """Counting stops one past the limit, and so does the figure shown."""
    return F.concat(
        F.lit(fixed.OVERSIZE_TITLE), path, F.lit("\n# Nodes: "), F.least(units, F.lit(limit + 1)).cast("string"),
        F.lit(f" > {limit}\n# Size: "), n_bytes.cast("string"), F.lit(" bytes\n"),
    )


def aligned_size(n_bytes: Column, block: int = fixed.BLOCK_BYTES, slack: int = fixed.SLACK_BYTES) -> Column:
    n = n_bytes.cast("bigint") + F.lit(slack + block - 1)
    return n - n % F.lit(block)


def align(text: Column, block: int = fixed.BLOCK_BYTES, slack: int = fixed.SLACK_BYTES) -> Column:
    """Pad a text to a multiple of ``block`` that leaves at least ``slack``."""
    left, right = fixed.PADDING

    def padded(t: Column, pad: Column) -> Column:
        mark = F.concat(F.lit(left), pad.cast("string"), F.lit(right))
        fits = pad >= F.octet_length(mark)
        return F.when(fits, F.concat(t, mark, F.repeat(F.lit(" "), pad - F.octet_length(mark)))).otherwise(
            F.concat(t, F.repeat(F.lit(" "), pad))
        )

    return let(
        text, lambda t: let((aligned_size(size(t), block, slack) - size(t)).cast("int"), lambda pad: padded(t, pad))
    )
