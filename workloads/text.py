"""Queries over document text: secrets, blocks, sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import blocks as B
from tidemark.functions import redact as R
from tidemark.operators import distill as D
from tidemark.operators import lookups as L
from workloads import fixtures as X
from workloads import sqlparts as P

# The values in the tables are hexadecimal, which cannot reach the usual limit of 4.5.
HEX_LIMIT = 3.5
# Pages hold fewer tags than the usual limit of 30,000.
FEW_UNITS = 33


def _digest(spark, sf_dir, make):
    return X.documents(spark, sf_dir).select("doc_id", F.md5(make(F.col("text"))).alias("digest"))


def redact_literals(spark, sf_dir):
    return _digest(spark, sf_dir, R.redact_keyword_literals)


def redact_assigned(spark, sf_dir):
    return _digest(spark, sf_dir, R.redact_assigned_secrets)


def redact_keys(spark, sf_dir):
    d = X.documents(spark, sf_dir)
    return d.select(
        "doc_id",
        F.md5(R.redact_private_keys(F.col("text"))).alias("header_digest"),
        F.md5(R.redact_private_keys(F.col("text"), whole_block=True)).alias("block_digest"),
    )


def token_entropy(spark, sf_dir):
    d = X.documents(spark, sf_dir).select("doc_id", F.posexplode(R.literals(F.col("text"))).alias("pos", "lit"))
    d = d.select("doc_id", "pos", R.inner(F.col("lit")).alias("token"))
    return d.select(
        "doc_id", "pos", F.char_length("token").alias("n_chars"),
        F.round(R.shannon_entropy(F.col("token")), 6).alias("entropy"),
    )


def redact_entropy(spark, sf_dir):
    # the assignments would go first, so their names are blurred
    d = X.documents(spark, sf_dir)
    text = F.replace(F.col("text"), F.lit("token = "), F.lit("value = "))
    return d.select("doc_id", F.md5(R.redact_high_entropy(text, limit=HEX_LIMIT)).alias("digest"))


def redact_all(spark, sf_dir):
    return _digest(spark, sf_dir, lambda t: R.redact(t, limit=HEX_LIMIT))


def block_spans(spark, sf_dir):
    return D.source_map(X.source_files(spark, sf_dir), B.PAGE_KINDS)


def elide_blocks(spark, sf_dir):
    pieces = B.cut_blocks(F.col("text"), B.PAGE_BLOCKS)
    text = B.rebuild(pieces, lambda p: B.placeholder(F.col("ext")))
    return X.source_files(spark, sf_dir).select("path", F.md5(text).alias("digest"), B.size(text).alias("n_bytes"))


def skeleton_files(spark, sf_dir):
    sk = D.skeletons(X.files(spark, sf_dir), B.PAGE_KINDS, literal=R.LITERAL)
    return sk.select("path", "n_bytes", B.size(F.col("skeleton")).alias("skeleton_bytes"), F.md5("skeleton").alias("digest"))


def aligned_sizes(spark, sf_dir):
    n = B.aligned_size(F.col("n_bytes"))
    return X.files(spark, sf_dir).select(
        "path", "n_bytes", n.alias("aligned_bytes"), F.md5(B.align(F.col("text"))).alias("digest")
    )


def oversize_guard(spark, sf_dir):
    df = D.with_units(X.source_files(spark, sf_dir), B.PAGE_KINDS, FEW_UNITS)
    text = B.oversize_summary(F.col("path"), F.col("units"), F.col("n_bytes"), FEW_UNITS)
    return df.select("path", "units", "oversize", F.when(F.col("oversize"), text).alias("summary"))


def contained_files(spark, sf_dir):
    root = F.when(F.col("page_id") % 3 == 0, F.lit("/repo/")).when(F.col("page_id") % 3 == 1, F.lit("/repository/")).otherwise(F.lit("/"))
    files = X.files(spark, sf_dir).withColumn("path", F.concat(root, "path"))
    kept, rejected = D.inside_root(files, "/repo")
    return kept.select("path", F.lit(True).alias("inside")).unionByName(rejected.select("path", F.lit(False).alias("inside")))


TRICKS = ["/repo/./src//", "/repo/src/../", "/repo/../", "/repo/src/../../etc/", "/repo/../repo/", "repo/", "/../repo/a/../"]


def contained_paths(spark, sf_dir):
    """Paths with dots in them, judged by where they lead."""
    files = X.files(spark, sf_dir)
    n = F.regexp_extract("path", r"page_(\d+)", 1).cast("bigint")
    files = files.withColumn("path", F.concat(X.pick(TRICKS, n % len(TRICKS)), "path"))
    kept, rejected = D.inside_root(files, "/repo/")
    return kept.select("path", F.lit(True).alias("inside")).unionByName(rejected.select("path", F.lit(False).alias("inside")))


def small_and_large(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("skeleton"))
    small, large = D.split_small(docs)
    n, size = F.count("*").alias("n"), F.sum(F.octet_length("skeleton")).alias("n_bytes")
    return (
        small.groupBy("source").agg(n, size).withColumn("small", F.lit(True))
        .unionByName(large.groupBy("source").agg(n, size).withColumn("small", F.lit(False)))
    )


def hot_symbols(spark, sf_dir):
    return D.hot_symbols(X.lookups(spark, sf_dir), ("key",))


def lookup_tiers(spark, sf_dir):
    return L.lookup_tiers(X.lookups(spark, sf_dir)).select("key", "event_id", "n_lookups", "tier")


def lookups_placed(spark, sf_dir):
    """Lookups of which some have no time: those with a place in their key's order, and the others."""
    some = X.lookups(spark, sf_dir).withColumn("t_us", F.expr("if(event_id % 97 = 0, null, t_us)"))
    placed = L.lookup_tiers(some).select("key", "event_id", "n_lookups", "tier")
    rest = L.untimed_lookups(some).select("key", "event_id", F.lit(None).cast("bigint").alias("n_lookups"), F.lit(None).cast("string").alias("tier"))
    return placed.unionByName(rest)


def hot_kept_blocks(spark, sf_dir):
    blocks = D.block_texts(X.source_files(spark, sf_dir), B.PAGE_KINDS)
    got = D.block_replacements(blocks, D.lookup_counts(X.block_lookups(spark, sf_dir)))
    return got.select("path", "pos", "symbol", "n_lookups", "hot", F.md5("replacement").alias("digest"))


def hinted_skeletons(spark, sf_dir):
    counts = D.lookup_counts(X.block_lookups(spark, sf_dir))
    sk = D.skeletons(X.source_files(spark, sf_dir), B.PAGE_KINDS, counts=counts, literal=R.LITERAL)
    return sk.select("path", F.md5("skeleton").alias("digest"))


QUERIES = [
    redact_literals, redact_assigned, redact_keys, token_entropy, redact_entropy, redact_all, block_spans, elide_blocks,
    skeleton_files, aligned_sizes, oversize_guard, contained_files, contained_paths, small_and_large, hot_symbols, lookup_tiers, lookups_placed,
    hot_kept_blocks, hinted_skeletons,
]

_SECRET, _ASSIGNED, _RANDOM = P.literal_rules(HEX_LIMIT)
_LOOKUPS = """lk as (
  select user_id || ':' || event_type || ':' || ((epoch_us(ts) - 1704067200000000) // 86400000000 // 7) as key,
         ts, event_id from events)"""
_CUT = f"""cut as (
  select *, string_split_regex(text, '{P.PAGE_BLOCKS}') as gaps, regexp_extract_all(text, '{P.PAGE_BLOCKS}') as blocks
  from files where ext <> 'md'),
blk as (
  select path, ext, n_bytes, u.i - 1 as pos, blocks[u.i] as block,
         lower(regexp_extract(blocks[u.i], '^<([A-Za-z]+)', 1)) as type, u.i as i, gaps, blocks
  from cut, lateral (select unnest(range(1, len(blocks) + 1)) as i) u),
named as (select *, type || '_' || pos as symbol from blk)"""
_COUNTS = """bl as (
  select 'src/page_' || (event_id // 20) || '.' || ['py','js','ts','tsx','md'][(event_id // 20) % 5 + 1] as path,
         ['style','script','nav','article','footer'][user_id % 5 + 1] || '_' || (user_id % 5) as symbol from events),
cnt as (select path, symbol, count(*) as n_lookups from bl group by 1, 2)"""
_HINT = """case when n >= 5 then ' # [SEMANTIC_L1] [HOT_SYMBOL]' when n > 1 then ' # [SEMANTIC_L1]'
                    when n = 1 then ' # [SEMANTIC_L2]' else '' end"""
_PLACE = "case when ext = 'py' then ' pass' else ' ...' end"
_KEPT = """' ' || array_to_string(string_split_regex(regexp_replace({b}, '(\\r\\n|\\r|\\n)\\z', ''), '\\r\\n|\\r|\\n')[1:10], chr(10))
       || chr(10) || '        ... (semantic truncation)'"""

SQL = {
    "redact_literals": f"""with {P.DOCUMENTS},
{P.rewritten("r", "docs", "doc_id", f"case when {_SECRET} then '" + '"[REDACTED]"' + "' end")}
select doc_id, md5(text) as digest from r""",
    "redact_assigned": f"""with {P.DOCUMENTS}
select doc_id, md5(regexp_replace(text,
  '(?i)((?:api[_-]?key|token|secret|password|credential)[\\w.-]*"?\\s*(?::[^=\\n"]*)?[:=]\\s*)"[^"\\n]*"', '\\1"[REDACTED]"', 'g')) as digest
from docs""",
    "redact_keys": f"""with {P.DOCUMENTS}
select doc_id, md5(regexp_replace(text, '-----BEGIN .* PRIVATE KEY-----', '"[REDACTED]"', 'g')) as header_digest,
  md5(regexp_replace(text, '(?s)-----BEGIN [^\\n]* PRIVATE KEY-----.*?-----END [^\\n]* PRIVATE KEY-----', '"[REDACTED]"', 'g')) as block_digest
from docs""",
    "token_entropy": f"""with {P.DOCUMENTS},
l as (select doc_id, regexp_extract_all(text, '{P.LITERAL}') as lits from docs),
t as (select doc_id, u.i - 1 as pos, trim(lits[u.i], '"'' ') as token
      from l, lateral (select unnest(range(1, len(lits) + 1)) as i) u)
select doc_id, cast(pos as int) as pos, cast(length(token) as int) as n_chars,
       round(case when length(token) = 0 then 0 else list_entropy(string_split(token, '')) end, 6) as entropy from t""",
    "redact_entropy": f"""with {P.DOCUMENTS},
v as (select doc_id, replace(text, 'token = ', 'value = ') as text from docs),
{P.rewritten("r", "v", "doc_id", f"case when lits[i] is not null and not {_SECRET} and not coalesce({_ASSIGNED}, false) and {_RANDOM} then '" + '"[REDACTED_HIGH_ENTROPY]"' + "' end")}
select doc_id, md5(text) as digest from r""",
    "redact_all": f"""with {P.DOCUMENTS},
{P.redact_all("r", "docs", "doc_id", HEX_LIMIT)}
select doc_id, md5(text) as digest from r""",
    "block_spans": f"""with {P.FILES}, {_CUT},
s as (select *, cast(list_sum(list_transform(gaps[1:i], lambda g: strlen(g)))
        + coalesce(list_sum(list_transform(blocks[1:i - 1], lambda b: strlen(b))), 0) as bigint) as original_start from named)
select path, cast(pos as int) as pos, symbol, type, original_start, original_start + strlen(block) as original_end,
       n_bytes as file_size from s""",
    "elide_blocks": f"""with {P.FILES},
e as (select path, regexp_replace(text, '{P.PAGE_BLOCKS}', {_PLACE}, 'g') as text from files where ext <> 'md')
select path, md5(text) as digest, strlen(text) as n_bytes from e""",
    "skeleton_files": f"""with {P.SKELETONS}
select path, n_bytes, strlen(skeleton) as skeleton_bytes, md5(skeleton) as digest from skel""",
    "aligned_sizes": f"""with {P.FILES}
select path, n_bytes, (n_bytes + 64 + 4095) // 4096 * 4096 as aligned_bytes, md5({P.padded("text")}) as digest from files""",
    "oversize_guard": f"""with {P.FILES},
u as (select path, n_bytes, len(regexp_extract_all(text, '<[A-Za-z]')) as units from files where ext <> 'md')
select path, units, units > {FEW_UNITS} as oversize, case when units > {FEW_UNITS} then
  '# [GCS CIRCUIT BREAKER] ' || path || chr(10) || '# Nodes: {FEW_UNITS + 1} > {FEW_UNITS}' || chr(10)
  || '# Size: ' || n_bytes || ' bytes' || chr(10) end as summary from u""",
    "contained_files": f"""with {P.FILES},
p as (select case page_id % 3 when 0 then '/repo/' when 1 then '/repository/' else '/' end || path as path from files)
select path, starts_with(path, '/repo/') as inside from p""",
    "small_and_large": """select source, strlen(text) < 1024 as small, count(*) as n, cast(sum(strlen(text)) as bigint) as n_bytes
from documents group by 1, 2""",
    "hot_symbols": f"with {_LOOKUPS} select key, count(*) as n_lookups from lk group by 1 having count(*) >= 5",
    "lookup_tiers": f"""with {_LOOKUPS},
r as (select key, event_id, row_number() over (partition by key order by ts, event_id) as n_lookups from lk)
select key, event_id, n_lookups, case when n_lookups = 1 then 'L2' else 'L1' end as tier from r""",
    "lookups_placed": f"""with {_LOOKUPS},
r as (select key, event_id, row_number() over (partition by key order by ts, event_id) as n_lookups from lk where event_id % 97 <> 0)
select key, event_id, n_lookups, case when n_lookups = 1 then 'L2' else 'L1' end as tier from r
union all select key, event_id, null, null from lk where event_id % 97 = 0""",
    "hot_kept_blocks": f"""with {P.FILES}, {_CUT}, {_COUNTS},
j as (select named.path, ext, pos, named.symbol, block as text, coalesce(n_lookups, 0) as n from named
      left join cnt on cnt.path = named.path and cnt.symbol = named.symbol),
{P.redact_all("safe", "j", "path, ext, pos, symbol, n")}
select path, cast(pos as int) as pos, symbol, n as n_lookups, n >= 5 as hot,
  md5(case when n >= 5 then {_KEPT.format(b="text")} else {_PLACE} || {_HINT} end) as digest from safe""",
    "hinted_skeletons": f"""with {P.FILES}, {_COUNTS},
{P.redact_all("safe", "files", "path, ext")},
cut as (
  select *, string_split_regex(text, '{P.PAGE_BLOCKS}') as gaps, regexp_extract_all(text, '{P.PAGE_BLOCKS}') as blocks
  from safe where ext <> 'md'),
blk as (
  select path, ext, u.i as i, gaps[u.i] as gap, blocks[u.i] as block,
         lower(regexp_extract(blocks[u.i], '^<([A-Za-z]+)', 1)) || '_' || (u.i - 1) as symbol
  from cut, lateral (select unnest(range(1, len(gaps) + 1)) as i) u),
j as (select blk.*, coalesce(n_lookups, 0) as n from blk left join cnt on cnt.path = blk.path and cnt.symbol = blk.symbol),
p as (select path, i, gap || case when block is null then '' when n >= 5 then {_KEPT.format(b="block")} else {_PLACE} || {_HINT} end as piece from j)
select path, md5(string_agg(piece, '' order by i)) as digest from p group by 1""",
}
SQL["contained_paths"] = f"""with {P.FILES}
select [{", ".join(f"'{t}'" for t in TRICKS)}][page_id % {len(TRICKS)} + 1] || path as path,
       page_id % {len(TRICKS)} in (0, 1, 4, 6) as inside from files"""
