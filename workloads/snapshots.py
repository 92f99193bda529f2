"""Queries over packing, snapshots, rehydration and size reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B
from tidemark.functions import redact as R
from tidemark.operators import distill as D
from tidemark.operators import pack as K
from tidemark.operators import rehydrate as H
from tidemark.operators import report as S
from tidemark.plans.distill_run import distill
from tidemark.session import scratch_path
from tidemark.sources import report as W
from tidemark.sources import snapshot as N
from tidemark.sources.files import scan_files as scan
from workloads import fixtures as X
from workloads import sqlparts as P

# Page skeletons are all below the usual limit of 1,024 bytes.
SMALL_BYTES = 240


def _run(spark, sf_dir):
    return distill(X.source_files(spark, sf_dir), B.PAGE_KINDS, literal=R.LITERAL, small_bytes=SMALL_BYTES)


def _snapshot(spark, sf_dir):
    """Written and read back."""
    root = scratch_path(spark, "snapshots")
    N.write_snapshot(_run(spark, sf_dir), root, "run-1", commit_sha="abc", project_root="/repo")
    return N.read_snapshot(spark, root)


def _members(spark, sf_dir):
    """Members of a written snapshot, alone and in buckets."""
    return _snapshot(spark, sf_dir).members


def _source_map(spark, sf_dir):
    """Source map in which every eleventh page has drifted."""
    drift = F.regexp_extract("path", r"_(\d+)\.", 1).cast("bigint") % 11 == 0
    sm = D.source_map(X.source_files(spark, sf_dir), B.PAGE_KINDS)
    return sm.withColumn("file_size", F.col("file_size") + F.when(drift, 1).otherwise(0))


def pack_members(spark, sf_dir):
    entries = X.small_documents(spark, sf_dir).select(
        "shard", "ord", (F.octet_length("text") + 60).cast("bigint").alias("entry_bytes")
    )
    return K.pack_next_fit(entries)


def pack_all_members(spark, sf_dir):
    """One shard for all documents, large ones too."""
    d = X.table(spark, sf_dir, "documents")
    entries = d.select(
        F.lit("").alias("shard"), F.col("doc_id").alias("ord"), F.octet_length("text").cast("bigint").alias("entry_bytes")
    )
    return K.pack_next_fit(entries, chunk_rows=100_000).select("ord", "bucket", "pos")


def bucket_build(spark, sf_dir):
    docs = X.small_documents(spark, sf_dir)
    entries = docs.select("shard", "ord", B.size(K.entry_text(F.col("path"), F.col("text"))).alias("entry_bytes"))
    built = K.build_buckets(K.pack_next_fit(entries), docs)
    return built.select("shard", "bucket", "n_members", "n_bytes", "n_blocks", F.md5("text").alias("digest"))


def snapshot_union(spark, sf_dir):
    return _run(spark, sf_dir).skeletons.select("key", "n_bytes", F.md5("text").alias("digest"))


def snapshot_members(spark, sf_dir):
    return _run(spark, sf_dir).members


def snapshot_roundtrip(spark, sf_dir):
    return _snapshot(spark, sf_dir).skeletons.select("key", "n_bytes", F.md5("text").alias("digest"))


def _listing(spark, sf_dir):
    return X.source_files(spark, sf_dir).filter(F.col("page_id") % 7 != 0).select("path")


def prune_snapshot(spark, sf_dir):
    kept = N.prune_snapshot(_snapshot(spark, sf_dir), _listing(spark, sf_dir), "abc")
    return kept.skeletons.select("key", F.lit("skeleton").alias("kind")).unionByName(
        kept.source_map.select(F.col("path").alias("key"), F.lit("source_map").alias("kind")).distinct()
    )


def prune_other_commit(spark, sf_dir):
    """What the snapshot keeps for its own commit and for another one."""
    snapshot, listing = _snapshot(spark, sf_dir), _listing(spark, sf_dir)
    counts = []
    for sha in ("abc", "def"):
        kept = N.prune_snapshot(snapshot, listing, sha)
        for table, df in (("skeletons", kept.skeletons), ("members", kept.members), ("source_map", kept.source_map)):
            counts.append(df.agg(F.count("*").alias("n_rows")).select(F.lit(sha).alias("commit_sha"), F.lit(table).alias("kind"), "n_rows"))
    return reduce(DataFrame.unionByName, counts)


def restore_gate(spark, sf_dir):
    return N.restore_size(_run(spark, sf_dir).skeletons)


def rehydrate_blocks(spark, sf_dir):
    files, sm = X.source_files(spark, sf_dir), _source_map(spark, sf_dir)
    unknown = files.filter(F.col("page_id") % 13 == 0).select("path", F.lit("nothing").alias("symbol"))
    requests = sm.select("path", "symbol").unionByName(unknown)
    got = H.rehydrate_blocks(requests, sm, files)
    return got.select("path", "symbol", F.md5("block").alias("digest"))


def rehydrate_full(spark, sf_dir):
    named = X.prompts(spark, sf_dir).select(
        "prompt_id", F.explode(H.candidate_files(F.col("text"))).alias("path")
    )
    got = H.rehydrate_full(named, X.files(spark, sf_dir))
    return got.select("prompt_id", "path", F.md5("text").alias("digest"))


def is_skeletonized(spark, sf_dir):
    return H.is_skeletonized(X.files(spark, sf_dir).select("path"), _members(spark, sf_dir))


def edit_prompts(spark, sf_dir):
    return X.prompts(spark, sf_dir).select("prompt_id", H.edit_intent(F.col("text")).alias("edits"))


def candidate_files(spark, sf_dir):
    found = F.posexplode(H.candidate_files(F.col("text"))).alias("pos", "path")
    return X.prompts(spark, sf_dir).select("prompt_id", found)


def match_intents(spark, sf_dir):
    return H.match_intents(X.prompts(spark, sf_dir), _members(spark, sf_dir))


def _sizes(spark, sf_dir):
    sk = D.skeletons(X.source_files(spark, sf_dir), B.PAGE_KINDS, literal=R.LITERAL)
    return sk.select("path", "n_bytes", B.size(F.col("skeleton")).alias("skeleton_bytes"))


def file_sizes(spark, sf_dir):
    return S.file_sizes(_sizes(spark, sf_dir))


def size_totals(spark, sf_dir):
    return S.size_totals(S.file_sizes(_sizes(spark, sf_dir)))


def top_savings(spark, sf_dir):
    return S.top_savings(S.file_sizes(_sizes(spark, sf_dir)))


def compression_ratio(spark, sf_dir):
    return S.compression_ratio(_sizes(spark, sf_dir))


def report_written(spark, sf_dir):
    folder = scratch_path(spark, "report")
    W.write_report(S.file_sizes(_sizes(spark, sf_dir)), folder)
    return spark.read.parquet(f"{folder}/top")


def report_text(spark, sf_dir):
    """The report's lines; at most the top files and ten more."""
    text = W.write_report(S.file_sizes(_sizes(spark, sf_dir)), scratch_path(spark, "report"))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "pos bigint, line string")


def scan_files(spark, sf_dir):
    """Pages as files of their names, a tenth below a skipped folder, and files with bad bytes, read back."""
    folder = scratch_path(spark, "pages")
    pages = X.files(spark, sf_dir)
    below = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("lib/node_modules/"), "path")).otherwise(F.col("path"))
    X.write_tree(pages.select(below.alias("path"), "text"), folder)
    X.write_bad_bytes(spark, folder)
    return scan(spark, folder).select("path", "ext", "n_bytes", F.md5("text").alias("digest"))


def snapshot_rewritten(spark, sf_dir):
    """Members of a snapshot before and after its id is written again, both read after that."""
    root, files = scratch_path(spark, "snapshots"), X.source_files(spark, sf_dir)
    out = []
    for k, name in enumerate(("old", "new")):
        run = distill(files.filter(f"page_id % 3 >= {k}"), B.PAGE_KINDS, literal=R.LITERAL, small_bytes=SMALL_BYTES)
        N.write_snapshot(run, root, "run-1", ts="2024-01-01")
        out.append(N.read_snapshot(spark, root, "run-1").members.select("path", F.lit(name).alias("seen")))
    return out[0].unionByName(out[1])


QUERIES = [
    report_written, report_text, scan_files, snapshot_rewritten, pack_members, pack_all_members, bucket_build, snapshot_union, snapshot_members, snapshot_roundtrip, prune_snapshot,
    prune_other_commit, restore_gate, rehydrate_blocks, rehydrate_full, is_skeletonized, edit_prompts, candidate_files,
    match_intents, file_sizes, size_totals, top_savings, compression_ratio,
]

_SMALL_DOCS = """small as (
  select source as shard, doc_id as ord, 'doc_' || doc_id || '.md' as path, text from documents where strlen(text) < 1024)"""
_SNAPSHOT = f"""{P.SKELETONS},
src as (select * from skel where ext <> 'md'),
small as (select '' as shard, path as ord, path, ext, skeleton, strlen({P.entry("path", "ext", "skeleton")}) as entry_bytes
          from src where strlen(skeleton) < {SMALL_BYTES}),
ent as (select shard, ord, path, entry_bytes from small),
{P.next_fit("ent")},
mem as (
  select p.path, 'COMMON_BUCKET_' || bucket as key, pos, p.entry_bytes, bucket, {P.entry("s.path", "s.ext", "s.skeleton")} as entry
  from packed p join small s on s.path = p.path),
bkt as (select key, string_agg(path, ', ' order by pos) as paths, string_agg(entry, '' order by pos) as body from mem group by 1),
btx as (select key, {P.bucket_text("paths", "body")} as raw from bkt),
snap as (
  select key, {P.padded("raw")} as text from btx
  union all select path, {P.padded("skeleton")} from src where strlen(skeleton) >= {SMALL_BYTES})"""
_PROMPTS = r"""pr as (
  select conv_id || ':' || turn as prompt_id, text || case turn % 4
    when 0 then ' Please edit src/page_' || conv_id || '.' || ['py','js','ts','tsx','md'][conv_id % 5 + 1] || ' now.'
    when 2 then ' Look at src/page_' || conv_id || '.py.' else '' end as text
  from conversations where role = 'user'),
cand as (
  select prompt_id, f[u.i] as path, min(u.i) as first_at
  from (select prompt_id, regexp_extract_all(text, '[A-Za-z0-9_./-]+\.(py|js|ts|tsx|json|md|sh)\b') as f from pr) x,
       lateral (select unnest(range(1, len(f) + 1)) as i) u group by 1, 2)"""
_VERBS = r"regexp_matches(text, '(?i)\b(modify|edit|update|change|rewrite)\b')"
_SIZES = f"""{P.SKELETONS},
siz as (select path, n_bytes, (strlen(skeleton) + 64 + 4095) // 4096 * 4096 as distilled from skel where ext <> 'md')"""

SQL = {
    "pack_members": f"""with recursive {_SMALL_DOCS},
ent as (select shard, ord, path, strlen(text) + 60 as entry_bytes from small),
{P.next_fit("ent")}
select shard, ord, bucket, pos, entry_bytes from packed""",
    "pack_all_members": f"""with recursive
ent as (select '' as shard, doc_id as ord, doc_id as path, strlen(text) as entry_bytes from documents),
{P.next_fit("ent")}
select ord, bucket, pos from packed""",
    "bucket_build": f"""with recursive {_SMALL_DOCS},
ent as (select shard, ord, path, strlen({P.entry("path", "'md'", "text")}) as entry_bytes from small),
{P.next_fit("ent")},
m as (select p.shard, bucket, pos, p.path, {P.entry("p.path", "'md'", "s.text")} as entry
      from packed p join small s on s.shard = p.shard and s.ord = p.ord),
b as (select shard, bucket, count(*) as n_members, string_agg(path, ', ' order by pos) as paths,
             string_agg(entry, '' order by pos) as body from m group by 1, 2),
t as (select shard, bucket, n_members, {P.bucket_text("paths", "body")} as raw from b),
f as (select shard, bucket, n_members, {P.padded("raw")} as text from t)
select shard, bucket, n_members, strlen(text) as n_bytes, strlen(text) // 4096 as n_blocks, md5(text) as digest from f""",
    "snapshot_union": f"with recursive {_SNAPSHOT} select key, strlen(text) as n_bytes, md5(text) as digest from snap",
    "snapshot_members": f"""with recursive {_SNAPSHOT}
select path, key, pos, entry_bytes, units, units > {fixed.UNIT_LIMIT} as oversize
from (select path, key, pos, entry_bytes from mem
      union all select path, path, 0, strlen({P.entry("path", "ext", "skeleton")}) from src where strlen(skeleton) >= {SMALL_BYTES})
join (select path, len(regexp_extract_all(text, '{B.PAGE_BLOCKS.units}')) as units from files) using (path)""",
    "snapshot_roundtrip": f"with recursive {_SNAPSHOT} select key, strlen(text) as n_bytes, md5(text) as digest from snap",
    "prune_snapshot": f"""with recursive {_SNAPSHOT},
listing as (select path from files where ext <> 'md' and page_id % 7 <> 0)
select key, 'skeleton' as kind from snap where key like 'COMMON\\_BUCKET\\_%' escape '\\' or key in (select path from listing)
union all select path, 'source_map' from listing""",
    "prune_other_commit": f"""with recursive {_SNAPSHOT},
listing as (select path, text from files where ext <> 'md' and page_id % 7 <> 0),
kept as (
  select 'skeletons' as kind, count(*) as n from snap
  where key like 'COMMON\\_BUCKET\\_%' escape '\\' or key in (select path from listing)
  union all select 'members', count(*) from listing
  union all select 'source_map', coalesce(sum(len(regexp_extract_all(text, '{P.PAGE_BLOCKS}'))), 0) from listing)
select c.sha as commit_sha, kind, cast(case when c.sha = 'abc' then n else 0 end as bigint) as n_rows
from kept, (select unnest(['abc', 'def']) as sha) c""",
    "restore_gate": f"""with recursive {_SNAPSHOT}
select cast(sum(strlen(text)) as bigint) as total_bytes, sum(strlen(text)) <= 5242880 as allowed from snap""",
    "rehydrate_blocks": f"""with {P.FILES},
f as (select page_id, path, regexp_extract_all(text, '{P.PAGE_BLOCKS}') as blocks from files where ext <> 'md'),
b as (select page_id, path, blocks[u.i] as block, lower(regexp_extract(blocks[u.i], '^<([A-Za-z]+)', 1)) || '_' || (u.i - 1) as symbol
      from f, lateral (select unnest(range(1, len(blocks) + 1)) as i) u)
select path, symbol, case when page_id % 11 <> 0 then md5(block) end as digest from b
union all select path, 'nothing', null from files where ext <> 'md' and page_id % 13 = 0""",
    "rehydrate_full": f"""with {P.FILES}, {_PROMPTS}
select prompt_id, cand.path, md5(files.text) as digest from cand left join files on files.path = cand.path""",
    "is_skeletonized": f"with {P.FILES} select path, ext <> 'md' as skeletonized from files",
    "edit_prompts": f"with {_PROMPTS} select prompt_id, {_VERBS} as edits from pr",
    "candidate_files": f"""with {_PROMPTS}
select prompt_id, path, cast(row_number() over (partition by prompt_id order by first_at) - 1 as int) as pos from cand""",
    "match_intents": f"""with {P.FILES}, {_PROMPTS}
select pr.prompt_id, count(cand.path) as n_candidates,
       coalesce(bool_or(files.path is not null), false) as required
from pr left join cand on cand.prompt_id = pr.prompt_id left join files on files.path = cand.path and ext <> 'md'
where {_VERBS.replace("text,", "pr.text,")} group by 1""",
    "file_sizes": f"""with {_SIZES}
select path, n_bytes as original, distilled, n_bytes - distilled as saving from siz where n_bytes > 0""",
    "size_totals": f"""with {_SIZES}
select count(*) as n_files, cast(sum(n_bytes) as bigint) as original, cast(sum(distilled) as bigint) as distilled,
  cast(sum(n_bytes - distilled) as bigint) as saving,
  sum(n_bytes - distilled)::double / sum(n_bytes)::double * 100 as saving_pct from siz where n_bytes > 0""",
    "top_savings": f"""with {_SIZES}
select path, n_bytes as original, distilled, n_bytes - distilled as saving,
  (n_bytes - distilled)::double / n_bytes::double * 100 as saving_pct
from siz where n_bytes > 0 order by saving desc, path limit 30""",
    "report_written": f"""with {_SIZES}
select path, n_bytes as original, distilled, n_bytes - distilled as saving,
  (n_bytes - distilled)::double / n_bytes::double * 100 as saving_pct
from siz where n_bytes > 0 order by saving desc, path limit 30""",
    "report_text": f"""with {_SIZES},
s as (select path, n_bytes as o, distilled as d, n_bytes - distilled as v, (n_bytes - distilled)::double / n_bytes::double * 100 as p from siz where n_bytes > 0),
t as (select count(*) as n, sum(o)::bigint as o, sum(d)::bigint as d, sum(v)::bigint as v, sum(v)::double / sum(o)::double * 100 as p from s),
b as (select *, row_number() over (order by v desc, path) as r from s),
h as (select unnest(['# Sizes after distillation', '', '| files | bytes before | bytes after | bytes saved | saved |', '|-:|-:|-:|-:|-:|',
        (select format('| {{:,}} | {{:,}} | {{:,}} | {{:,}} | {{:.1f}} % |', n, o, d, v, p) from t), '',
        (select 'The ' || least(n, 30) || ' files that save most:' from t), '', '| path | before | after | saved | saved |', '|-|-:|-:|-:|-:|']) as line,
      unnest(range(10)) as pos)
select pos, line from h
union all select r + 9, format('| {{}} | {{:,}} | {{:,}} | {{:,}} | {{:.1f}} % |', path, o, d, v, p) from b where r <= 30""",
    "scan_files": f"""with {P.FILES}
select path, ext, n_bytes + 1 as n_bytes, md5(text || chr(10)) as digest from files where ext <> 'md' and page_id % 10 <> 0
union all select 'bad/b.' || e, e, {len(X.BAD_BYTES)}, md5('ok ' || chr(65533) || chr(65533) || ' end' || chr(10)) from (select unnest(['py', 'js', 'ts', 'tsx']) as e)""",
    "snapshot_rewritten": f"""with {P.FILES}
select path, 'old' as seen from files where ext <> 'md'
union all select path, 'new' from files where ext <> 'md' and page_id % 3 >= 1""",
    "compression_ratio": f"""with {_SIZES}
select path, n_bytes, distilled, case when n_bytes = 0 then 1.0::double else distilled::double / n_bytes::double end as ratio from siz""",
}
