"""Pieces of SQL that several queries share."""

from tidemark import fixed
from tidemark.functions import blocks as B

KEYWORDS = r"(?i)(api[_-]?key|token|secret|password|credential)"
LITERAL = '"[^"\\n]*"'
PAGE_BLOCKS = B.PAGE_BLOCKS.pattern

FILES = """files as (
  select page_id, 'src/page_' || page_id || '.' || ['py','js','ts','tsx','md'][page_id % 5 + 1] as path,
         ['py','js','ts','tsx','md'][page_id % 5 + 1] as ext, html as text, strlen(html) as n_bytes
  from pages)"""

DOCUMENTS = """docs as (
  select doc_id, source, case when doc_id % 10 = 0 then text || '
-----BEGIN RSA PRIVATE KEY-----
' || md5(text) || '
-----END RSA PRIVATE KEY-----
said "my Password is x" and {"api_key": "k' || doc_id || '"}
' else text end as text
  from documents)"""


def rewritten(table: str, source: str, keys: str, judge: str, text: str = "text") -> str:
    """CTE ``table``: text with each literal replaced by ``judge`` over lits[i], gaps[i], lits[i - 1]."""
    return f"""{table}_cut as (
  select *, string_split_regex({text}, '{LITERAL}') as gaps, regexp_extract_all({text}, '{LITERAL}') as lits from {source}),
{table} as (
  select {keys}, array_to_string(list_transform(range(1, len(gaps) + 1),
    lambda i: gaps[i] || coalesce({judge}, lits[i], '')), '') as text
  from {table}_cut)"""


def literal_rules(limit: float) -> str:
    secret = f"regexp_matches(lits[i], '{KEYWORDS}')"
    assigned = (
        f"(regexp_matches(gaps[i], '{KEYWORDS}[\\w.-]*\\s*(?::[^=\\n]*)?[:=]\\s*\\z') or "
        f"(regexp_matches(gaps[i], '\\A\\s*[:=]\\s*\\z') and i > 1 and regexp_matches(lits[i - 1], '{KEYWORDS}')))"
    )
    inner = "trim(lits[i], '\"'' ')"
    random = f"(length({inner}) > 32 and list_entropy(string_split({inner}, '')) > {limit})"
    return secret, assigned, random


def redact_all(table: str, source: str, keys: str, limit: float = 4.5) -> str:
    secret, assigned, random = literal_rules(limit)
    judge = (
        f"case when lits[i] is null then null when {secret} or {assigned} then '\"[REDACTED]\"' "
        f"when {random} then '\"[REDACTED_HIGH_ENTROPY]\"' end"
    )
    keyless = (
        "regexp_replace(regexp_replace(text, '(?s)-----BEGIN [^\\n]* PRIVATE KEY-----.*?-----END [^\\n]* PRIVATE KEY-----', "
        "'\"[REDACTED]\"', 'g'), '-----BEGIN .* PRIVATE KEY-----', '\"[REDACTED]\"', 'g')"
    )
    return f"{table}_safe as (select {keys}, {keyless} as text from {source}),\n" + rewritten(table, f"{table}_safe", keys, judge)


def padded(text: str) -> str:
    """Text padded to a multiple of 4096 with at least 64 bytes of slack."""
    n = f"strlen({text})"
    pad = f"(({n} + 64 + 4095) // 4096 * 4096 - {n})"
    left, right = (x.replace("\n", "' || chr(10) || '") for x in fixed.PADDING)
    mark = f"'{left}' || {pad} || '{right}'"
    return (
        f"case when {pad} >= strlen({mark}) then {text} || {mark} || repeat(' ', cast({pad} - strlen({mark}) as int)) "
        f"else {text} || repeat(' ', cast({pad} as int)) end"
    )


def next_fit(entries: str, capacity: int = 3776) -> str:
    """Recursive CTE ``packed`` over ``entries`` (shard, ord, path, entry_bytes)."""
    return f"""numbered as (select *, row_number() over (partition by shard order by ord) as rn from {entries}),
packed as (
  select shard, rn, ord, path, entry_bytes, entry_bytes as fill, cast(0 as bigint) as bucket, cast(0 as bigint) as pos
  from numbered where rn = 1
  union all
  select n.shard, n.rn, n.ord, n.path, n.entry_bytes,
         case when p.fill + n.entry_bytes > {capacity} then n.entry_bytes else p.fill + n.entry_bytes end,
         case when p.fill + n.entry_bytes > {capacity} then p.bucket + 1 else p.bucket end,
         case when p.fill + n.entry_bytes > {capacity} then 0 else p.pos + 1 end
  from packed p join numbered n on n.shard = p.shard and n.rn = p.rn + 1)"""


def entry(path: str, ext: str, text: str) -> str:
    nl = "' || chr(10) || '"
    (a, b), (c, d) = [tuple(x.replace("\n", nl) for x in pair) for pair in (fixed.ENTRY_START, fixed.ENTRY_END)]
    return f"'{a}' || {path} || '{b}' || {ext} || chr(10) || {text} || '{c}' || {path} || '{d}'"


def bucket_text(paths: str, body: str) -> str:
    nl = "' || chr(10) || '"
    (a, b), end = [x.replace("\n", nl) for x in fixed.MANIFEST_START], fixed.MANIFEST_END.replace("\n", nl)
    return f"'{a}' || {paths} || '{b}' || {body} || '{end}'"


# Page files as skeletons: redacted, blocks elided, other extensions passed through.
SKELETONS = (
    FILES
    + ",\n"
    + redact_all("safe", "files", "page_id, path, ext, n_bytes")
    + f""",
skel as (
  select page_id, path, ext, n_bytes,
         case when ext = 'md' then text
              else regexp_replace(text, '{PAGE_BLOCKS}', case when ext = 'py' then ' pass' else ' ...' end, 'g') end as skeleton
  from safe)"""
)
