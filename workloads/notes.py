"""Queries over conversations and notes: handoff documents, changed notes, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import blocks as B
from tidemark.functions import redact as R
from tidemark.operators import distill as D
from tidemark.operators import handoff as O
from tidemark.operators import index as I
from tidemark.operators import rehydrate as H
from tidemark.session import scratch_path, stage
from workloads import fixtures as X
from workloads import sqlparts as P
from workloads.snapshots import _PROMPTS

ACTIVE_BYTES = 16384
MANIFEST_BYTES = 40
QUESTION = "The license of token and license, die Lizenz"


def _touched(spark, sf_dir):
    found = F.explode(H.candidate_files(F.col("text"))).alias("path")
    return X.prompts(spark, sf_dir).select(F.col("conv_id").alias("session_id"), "turn", found)


def last_turns(spark, sf_dir):
    turns = X.table(spark, sf_dir, "conversations")
    return O.last_turns(turns).select("conv_id", "turn", "role", "rank", F.md5("text").alias("digest"))


def manifest_layer(spark, sf_dir):
    got = O.manifest_layer(_touched(spark, sf_dir), MANIFEST_BYTES)
    return got.select("session_id", F.col("ord").alias("pos"), F.col("text").alias("path"))


def active_source(spark, sf_dir):
    got = O.active_source_layer(_touched(spark, sf_dir), X.files(spark, sf_dir), 4096)
    return got.select("session_id", "ord", F.md5("text").alias("digest"))


def handoff_layers(spark, sf_dir):
    touched, files = _touched(spark, sf_dir), X.files(spark, sf_dir)
    sk = D.skeletons(X.source_files(spark, sf_dir), B.PAGE_KINDS, literal=R.LITERAL)
    layers = [
        O.manifest_layer(touched), O.checkpoint_layer(touched, sk), O.active_source_layer(touched, files, ACTIVE_BYTES),
        O.recent_layer(X.table(spark, sf_dir, "conversations")),
    ]
    docs = O.handoff(layers, {1: "rules", 2: "skills"})
    return docs.select("session_id", F.octet_length("document").cast("bigint").alias("n_bytes"), F.md5("document").alias("digest"))


def changed_docs(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    # the table of the last scan: every fifth note was missing, every third had another text
    then = docs.filter(F.col("doc_id") % 5 != 0).withColumn(
        "text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    )
    return I.changed_docs(docs, I.content_hashes(then)).select("doc_id", "hash")


def bm25_index(spark, sf_dir):
    return I.postings(X.table(spark, sf_dir, "documents"))


def bm25_terms(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    got = I.term_weights(stage(I.postings(docs), "postings"), I.corpus_stats(docs))
    return got.withColumn("idf", F.round("idf", 6))


def bm25_topk(spark, sf_dir):
    return I.search_docs(X.table(spark, sf_dir, "documents"), QUESTION)


def bm25_search_index(spark, sf_dir):
    """The same search over an index that is written first."""
    docs, folder = X.table(spark, sf_dir, "documents"), scratch_path(spark, "index")
    I.write_index(docs, folder)
    return I.search_index(spark, folder, QUESTION)


QUERIES = [last_turns, manifest_layer, active_source, handoff_layers, changed_docs, bm25_index, bm25_terms, bm25_topk, bm25_search_index]

_TOUCHED = f"""{_PROMPTS},
touched as (
  select distinct conv_id as session_id, turn, cand.path
  from cand join conversations c on cand.prompt_id = c.conv_id || ':' || c.turn),
paths as (select distinct session_id, path from touched)"""
_MANIFEST = """man as (
  select session_id, path, row_number() over (partition by session_id order by path) as pos,
         sum(strlen(path) + 1) over (partition by session_id order by path) as total from paths)"""
_ACTIVE = f"""lat as (select session_id, path, max(turn) as turn from touched group by 1, 2),
act as (
  select session_id, path, row_number() over w as ord, text, sum((n_bytes + 64 + 4095) // 4096 * 4096) over w as total
  from lat join files using (path) window w as (partition by session_id order by turn desc, path)),
pad as (select session_id, ord, total, {P.padded("text")} as text from act)"""
_POSTINGS = r"""words as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
tok as (select doc_id, cast(len(w) as bigint) as length, unnest(w) as term from words),
post as (select term, doc_id, length, count(*) as tf from tok group by all),
stats as (select count(*) as n_docs, sum(len(w))::double / count(*) as mean_length from words),
terms as (select term, count(*) as df, ln(1 + (n_docs - count(*) + 0.5::double) / (count(*) + 0.5::double)) as idf
          from post, stats group by term, n_docs)"""

SQL = {
    "last_turns": """with r as (select *, row_number() over (partition by conv_id order by turn desc) as rank from conversations)
select conv_id, turn, role, cast(rank as int) as rank, md5(text) as digest from r where rank <= 3""",
    "manifest_layer": f"""with {_TOUCHED}, {_MANIFEST}
select session_id, cast(pos as int) as pos, path from man where total <= {MANIFEST_BYTES}""",
    "active_source": f"""with {P.FILES}, {_TOUCHED}, {_ACTIVE}
select session_id, cast(ord as int) as ord, md5(text) as digest from pad where total <= 4096""",
    "handoff_layers": f"""with {P.SKELETONS}, {_TOUCHED}, {_MANIFEST}, {_ACTIVE},
l3 as (select session_id, string_agg(path, chr(10) order by pos) as t from man where total <= 2048 group by 1),
l4 as (select session_id, string_agg(skeleton, chr(10) order by path) as t from paths join skel using (path)
       where ext <> 'md' group by 1 having sum(strlen(skeleton)) <= 5242880),
l5 as (select session_id, string_agg(text, chr(10) order by ord) as t from pad where total <= {ACTIVE_BYTES} group by 1),
r as (select *, row_number() over (partition by conv_id order by turn desc) as rank from conversations),
l6 as (select conv_id as session_id, string_agg(role || ': ' || text, chr(10) order by turn) as t from r where rank <= 3 group by 1),
d as (select session_id, '[SYSTEM_MANDATES]' || chr(10) || 'rules' || chr(10) || chr(10)
  || '[SKILLS_KNOWLEDGE]' || chr(10) || 'skills' || chr(10) || chr(10)
  || '[PROJECT_MANIFEST]' || chr(10) || coalesce(l3.t, '') || chr(10) || chr(10)
  || '[CHECKPOINT_SUMMARY]' || chr(10) || coalesce(l4.t, '') || chr(10) || chr(10)
  || '[ACTIVE_SOURCE]' || chr(10) || coalesce(l5.t, '') || chr(10) || chr(10)
  || '[EPHEMERAL_CONTEXT]' || chr(10) || l6.t as document
  from l6 left join l3 using (session_id) left join l4 using (session_id) left join l5 using (session_id))
select session_id, strlen(document) as n_bytes, md5(document) as digest from d""",
    "changed_docs": "select doc_id, sha256(text) as hash from documents where doc_id % 5 = 0 or doc_id % 3 = 0",
    "bm25_index": f"with {_POSTINGS} select term, doc_id, length, tf from post",
    "bm25_terms": f"with {_POSTINGS} select term, df, round(idf, 6) as idf from terms",
    "bm25_topk": f"""with {_POSTINGS}
select doc_id, round(sum(idf * tf * (1.2::double + 1) / (tf + 1.2::double * (1 - 0.75::double + 0.75::double * length / mean_length))), 6) as score
from post join terms using (term), stats
where term in ('the', 'license', 'of', 'token', 'and', 'die', 'lizenz')
group by doc_id order by score desc, doc_id limit 10""",
}
SQL["bm25_search_index"] = SQL["bm25_topk"]
