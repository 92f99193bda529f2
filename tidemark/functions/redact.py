"""Column expressions that replace secrets in text.

Quoted literals are cut out of the text in one left-to-right pass, judged one by
one and put back, so that a closing quote is never taken for an opening one. No
row leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.binding import let

LITERAL = r'"[^"\n]*"'


def _quoted(q: str, lines: bool) -> str:
    """A literal in quotes ``q``, escapes passed over; possessive, so that long ones neither backtrack nor recurse."""
    c = q[0]
    plain = rf"[^{c}\\]" if lines else rf"[^{c}\\\n]"
    odd = rf"\\." if len(q) == 1 else rf"(?:\\.|{c}(?!{c}{c}))"
    return rf"{q}{plain}*+(?:{odd}{plain}*+)*+{q}"


_TRIPLE = [_quoted('"' * 3, True), _quoted("'" * 3, True)]
_PLAIN = [_quoted('"', False), _quoted("'", False)]
_TICK = _quoted("`", True)
_PREFIX = r"""(?:(?<!\w)[bBfFrRuU]{1,2}(?=["']))?+"""
# an optional prefix, then triple quotes before single ones
CODE_LITERAL = rf"(?s){_PREFIX}(?:" + "|".join([*_TRIPLE, *_PLAIN, _TICK]) + ")"
# comments are tokens too, so that a quote in one opens nothing; so are the regular expressions of the brace languages
PY_TOKENS = rf"(?s)#[^\n]*+|{_PREFIX}(?:" + "|".join([*_TRIPLE, *_PLAIN]) + ")"
_REGEX = r"(?<=[=(,:\[!&|?{};\n]|[=(,:\[!&|?{};] |return )/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/"
BRACE_TOKENS = r"(?s)//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/|" + "|".join([_REGEX, *_PLAIN, _TICK])
CODE_TOKENS = {"py": PY_TOKENS, "js": BRACE_TOKENS, "ts": BRACE_TOKENS, "tsx": BRACE_TOKENS}
# a closed pair in a comment or in plain text: the name of a secret, the sign, a quoted value on the same line
CLOSED_PAIR = rf"({fixed.SECRET_KEYWORDS}[\w.-]*[\"'`]?\s*[:=]\s*)(?:\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`)"
# a name, an optional type, the sign
ASSIGNED = fixed.SECRET_KEYWORDS + r"[\w.-]*\s*(?::[^=\n]*)?[:=]\s*\z"
PAIR = r"\A\s*[:=]\s*\z"
BLANKS = " \t\n\x0b\f\r"  # what \s is
MARK = "\x01"
HEADER_START = "-----BEGIN "
SLACK = 1e-9  # far more than rounding adds to a sum of bits
KEY_BLOCK = r"(?s)-----BEGIN [^\n]* PRIVATE KEY-----.*?-----END [^\n]* PRIVATE KEY-----"


def literals(text: Column, pattern: str = LITERAL) -> Column:
    """Array of the quoted literals of a text, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def rewrite_literals(text: Column, judge: Callable[[Column, Column, Column], Column], pattern: str = LITERAL) -> Column:
    """Replace each literal by ``judge(literal, text before it, previous literal)``; null keeps it."""

    def rewritten(t: Column, found: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), found)
        pairs = F.zip_with(found, before, lambda lit, prev: F.struct(lit.alias("lit"), prev.alias("prev")))
        pieces = F.zip_with(
            F.split(t, pattern, -1), pairs,
            lambda gap, p: F.concat(gap, F.coalesce(judge(p["lit"], gap, p["prev"]), p["lit"], F.lit(""))),
        )
        return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(t)

    return let(text, lambda t: let(literals(t, pattern), lambda found: rewritten(t, found)))


def rewrite_code(text: Column, judge: Callable[[Column, Column, Column], Column], pattern: str) -> Column:
    """``rewrite_literals`` for tokens of code, comments among them.

    A comment loses the values of closed pairs and else stays as it is. Comments
    (up to three) between a literal and what it is assigned to are looked through.
    """

    def rewritten(t: Column, parts: Column) -> Column:
        n = F.floor(F.size(parts) / 2).cast("int")

        def token(i: Column) -> Column:
            return F.when(i >= 0, F.get(parts, 2 * i + 1))

        def gap(i: Column) -> Column:
            return F.when(i >= 0, F.get(parts, 2 * i))

        def context(i: Column) -> Column:
            """What is before token i, back over comments to the last literal, and that literal."""

            def back(k: int, text: Column, prev: Column) -> Column:
                here = F.struct(text.alias("gap"), prev.alias("prev"))
                if k > 3:
                    return here
                further = let(F.concat(gap(i - k), text), lambda text: let(token(i - k - 1), lambda prev: back(k + 1, text, prev)))
                return F.when(is_comment(prev), further).otherwise(here)

            return let(token(i - 1), lambda prev: back(1, gap(i), prev))

        def judged(lit: Column, i: Column) -> Column:
            return let(context(i), lambda c: judge(lit, c["gap"], c["prev"]))

        def piece(i: Column) -> Column:
            def new(lit: Column) -> Column:
                # a regular expression is code
                return F.coalesce(F.when(is_comment(lit), redact_pairs(lit)).when(~lit.startswith("/"), judged(lit, i)), lit)

            return F.concat(gap(i), let(token(i), new))

        whole = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), piece), ""), F.element_at(parts, -1))
        return F.when(n > 0, whole).otherwise(t)

    return let(text, lambda t: let(tokenized(t, pattern), lambda parts: rewritten(t, parts)))


def tokenized(text: Column, pattern: str) -> Column:
    """Array of what is before the first token, the token, what is before the next one, and so on to the rest of the text.

    Tokens are marked in one pass and the text is split at the marks, which needs
    no pattern; a text that holds the mark itself is cut by the pattern.
    """
    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    pairs = F.zip_with(F.split(text, pattern, -1), literals(text, pattern), lambda gap, lit: F.array(gap, lit))
    return F.when(text.contains(MARK), F.array_compact(F.flatten(pairs))).otherwise(marked)


def is_comment(token: Column) -> Column:
    return token.startswith("#") | token.startswith("//") | token.startswith("/*")


def has_keyword(text: Column) -> Column:
    """``SECRET_KEYWORDS`` occurs; plain searches come first, as few texts hold any of its words."""

    def found(low: Column) -> Column:
        words = [low.contains(w) for w in ("token", "secret", "password", "credential")]
        return reduce(or_, words, low.contains("api") & low.contains("key")) & text.rlike(fixed.SECRET_KEYWORDS)

    return let(F.lower(text), found)


def has_header(text: Column) -> Column:
    return text.contains(HEADER_START) & text.rlike(fixed.SECRET_HEADER)


def redact_pairs(text: Column) -> Column:
    """Quoted values of secrets' names in text that is no code: comments, notes."""
    pairs = F.regexp_replace(text, CLOSED_PAIR, "$1" + fixed.REDACTED.replace("$", r"\$"))
    return F.when(has_keyword(text), pairs).otherwise(text)


def is_secret(lit: Column) -> Column:
    return has_keyword(lit) | has_header(lit)


def is_assigned(gap: Column, prev: Column) -> Column:
    """The literal is the value of a secret's name, bare or quoted."""
    before = F.rtrim(gap, F.lit(BLANKS))
    named = gap.rlike(ASSIGNED) | (gap.rlike(PAIR) & F.coalesce(has_keyword(prev), F.lit(False)))
    return (before.endswith("=") | before.endswith(":")) & named


def _chars(s: Column) -> Column:
    return F.array_distinct(F.split(s, ""))


def _bits(s: Column, chars: Column, n: Column, limit: float | None = None) -> Column:
    """Sum of the characters' bits; with ``limit`` it may end early: it is above already, or the rest cannot lift it there.

    Counted characters leave the text, so the next ones are looked for in less of it.
    """

    def term(acc: Column, c: Column) -> Column:
        def counted(rest: Column) -> Column:
            p = (F.char_length(acc["rest"]) - F.char_length(rest)) / n
            return F.struct(rest.alias("rest"), let(p, lambda p: acc["bits"] - p * F.log2(p)).alias("bits"), (acc["left"] - 1).alias("left"))

        step = let(F.replace(acc["rest"], c, F.lit("")), counted)
        if limit is None:
            return step
        # the characters left have most bits when they are equally frequent
        most = let(F.char_length(acc["rest"]) / n, lambda p: acc["bits"] + p * F.log2(acc["left"] / p))
        return F.when((acc["bits"] <= limit + SLACK) & (most > limit - SLACK), step).otherwise(acc)

    start = F.struct(s.alias("rest"), F.lit(0.0).alias("bits"), F.size(chars).cast("double").alias("left"))
    return F.aggregate(chars, start, term)["bits"]


def shannon_entropy(s: Column) -> Column:
    """Bits per character; 0 for the empty text."""
    n = F.nullif(F.char_length(s), F.lit(0)).cast("double")
    return F.coalesce(let(s, lambda v: let(n, lambda k: F.when(k > 0, _bits(v, _chars(v), k)))), F.lit(0.0))


def exceeds(s: Column, limit: float) -> Column:
    """The entropy of a text that is not empty is above ``limit``; texts of too few different characters are not counted."""
    n = F.char_length(s).cast("double")
    return let(_chars(s), lambda chars: F.when(
        F.log2(F.size(chars)) > limit - SLACK, let(n, lambda k: _bits(s, chars, k, limit)) > F.lit(limit)
    ).otherwise(F.lit(False)))


def inner(lit: Column) -> Column:
    return F.trim(lit, F.lit("\"' "))


def is_random(lit: Column, min_chars: int = fixed.ENTROPY_MIN_CHARS, limit: float = fixed.ENTROPY_LIMIT) -> Column:
    # the length test first: entropy is the costly part
    return let(
        inner(lit),
        lambda s: F.when(F.char_length(s) > max(min_chars, 0), exceeds(s, limit)).otherwise(F.lit(False)),
    )


def redact_keyword_literals(text: Column, pattern: str = LITERAL) -> Column:
    return rewrite_literals(text, lambda lit, gap, prev: F.when(is_secret(lit), F.lit(fixed.REDACTED)), pattern)


def redact_assigned_secrets(text: Column, pattern: str = LITERAL) -> Column:
    return rewrite_literals(text, lambda lit, gap, prev: F.when(is_assigned(gap, prev), F.lit(fixed.REDACTED)), pattern)


def redact_private_keys(text: Column, whole_block: bool = False) -> Column:
    """Replace key headers, or with ``whole_block`` everything up to the key's end."""
    safe = F.regexp_replace(text, KEY_BLOCK, fixed.REDACTED) if whole_block else text
    return F.when(text.contains(HEADER_START), F.regexp_replace(safe, fixed.SECRET_HEADER, fixed.REDACTED)).otherwise(text)


def redact_high_entropy(
    text: Column, min_chars: int = fixed.ENTROPY_MIN_CHARS, limit: float = fixed.ENTROPY_LIMIT, pattern: str = LITERAL
) -> Column:
    def judge(lit: Column, gap: Column, prev: Column) -> Column:
        fires = is_random(lit, min_chars, limit) & ~is_secret(lit) & ~is_assigned(gap, prev)
        return F.when(fires, F.lit(fixed.REDACTED_ENTROPY))

    return rewrite_literals(text, judge, pattern)


def redact(
    text: Column,
    min_chars: int = fixed.ENTROPY_MIN_CHARS,
    limit: float = fixed.ENTROPY_LIMIT,
    pattern: str = LITERAL,
    whole_block: bool = True,
) -> Column:
    """All rules: keys first, then one pass over the literals."""

    return rewrite_literals(redact_private_keys(text, whole_block), _all_rules(min_chars, limit), pattern)


def _all_rules(min_chars: int, limit: float) -> Callable[[Column, Column, Column], Column]:
    def judge(lit: Column, gap: Column, prev: Column) -> Column:
        return F.when(is_secret(lit) | is_assigned(gap, prev), F.lit(fixed.REDACTED)).when(
            is_random(lit, min_chars, limit), F.lit(fixed.REDACTED_ENTROPY)
        )

    return judge


def redact_code(
    text: Column, ext: Column, tokens: dict[str, str] = CODE_TOKENS, min_chars: int = fixed.ENTROPY_MIN_CHARS,
    limit: float = fixed.ENTROPY_LIMIT, whole_block: bool = True,
) -> Column:
    """All rules by the language of a file; other files are text with double-quoted literals and closed pairs."""
    judge, safe = _all_rules(min_chars, limit), redact_private_keys(text, whole_block)
    groups: dict[str, list[str]] = {}
    for e, pattern in tokens.items():
        groups.setdefault(pattern, []).append(e)
    out = F
    for pattern, exts in groups.items():
        out = out.when(ext.isin(*exts), rewrite_code(safe, judge, pattern))
    return out.otherwise(redact_pairs(rewrite_literals(safe, judge)))
