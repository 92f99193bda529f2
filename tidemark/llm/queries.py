"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import (
    chat, decontamination, exact_dedup, html_text, merkle, mixing, near_dedup, pivot_search, quality, sharding, target_resampling, toxicity, warc,
)
from tidemark.llm.common import table

SQL: dict[str, str] = {}


def op1_toxicity(spark, sf_dir):
    found = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence",
    )


def op2_mix_sources(spark, sf_dir):
    units = mixing.mix(table(spark, sf_dir, "documents"))
    rows = units.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * mixing.times_of(F.col("nth"))).alias("taken")
    )


def op3_quality(spark, sf_dir):
    found = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "log_weight", F.col("p_good").alias("score"), "noisy", "kept")


def op4_warc(spark, sf_dir):
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark, sf_dir):
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), near_dedup.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_shards(spark, sf_dir):
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_html(spark, sf_dir):
    return html_text.extract_pages(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def op8_exact_dedup(spark, sf_dir):
    found = exact_dedup.find_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op9_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    tricky = turns.limit(0).union(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema))
    return chat.read_back(chat.format_turns(turns.union(tricky))).withColumnRenamed("id", "conv_id")


def op10_decontaminate(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontamination.find_matches(docs, items, carry=["doc_id"])
    n_hit = decontamination.hit_words()
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op11_merkle(spark, sf_dir):
    text = lambda c: F.lower(F.hex(c)).alias(c)
    found = merkle.verified_manifest(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", text("leaf"), text("subroot"), text("root"), F.lower(F.hex("proof")).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"), "verified",
    )


def op12_topk(spark, sf_dir):
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op13_resample(spark, sf_dir):
    found = target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


SQL["op8_exact_dedup"] = """
with t as (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents
)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       row_number() over (partition by body order by doc_id desc) = 1 as kept, sha256(body) as text_sha256
from t window g as (partition by body)
"""

SQL["op4_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
     g as (select *, sha1(body) as d, max(page_id) over (partition by body) as keep, octet_length(body) as n,
                  row_number() over (partition by body order by page_id desc) as nth from p)
select page_id, n as payload_bytes, d as payload_digest, case when n < 1000 or nth = 1 then 'response' else 'revisit' end as record_type,
       case when n < 1000 or nth = 1 then null else keep end as refers_to
from g
"""

_ROLE = {role: len(a + b) for role, (a, b) in chat.ROLES.items()}
SQL["op9_chat"] = f"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s as (
    select *, length(text) + len(regexp_extract_all(text, '</?s>|\\[/?(?:SYS|INST|ROLE)\\]|\\[(?:OUT|NAME)\\]|\\\\'))
              + case role when 'system' then {_ROLE['system']} when 'user' then {_ROLE['user']} else {_ROLE['assistant']} end as chars from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from s group by conv_id
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
SQL["op10_decontaminate"] = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
     i as (select cast(item_id as varchar) as name, {_WORDS} as w from benchmark),
     iw as (select distinct name, least(len(w), {decontamination.WINDOW}) as k, array_to_string(w[p:p + least(len(w), {decontamination.WINDOW}) - 1], ' ') as x
            from (select *, unnest(range(1, len(w) - least(len(w), {decontamination.WINDOW}) + 2)) as p from i where len(w) > 0)),
     ks as (select distinct k from iw),
     dw as (select r, p, k, array_to_string(w[p:p + k - 1], ' ') as x
            from (select r, w, k, unnest(range(1, len(w) - k + 2)) as p from d, ks where len(w) >= k)),
     m as (select r, p, dw.k, name from dw join iw on dw.x = iw.x and dw.k = iw.k),
     h as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + k)) as q from m) group by r),
     n as (select r, count(distinct name) as n_items, string_agg(distinct name, ',' order by name) as names from m group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and {decontamination.SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (r) left join n using (r)
"""

def _crc32(blob: str) -> str:
    """CRC-32 of a blob, byte by byte and bit by bit."""
    byte = f"cast('0x' || substr(hex({blob}), cast(2 * i + 1 as bigint), 2) as bigint)"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, x: xor(y >> 1, (y & 1) * 3988292384))"
    return f"xor(list_reduce([4294967295] || list_transform(range(octet_length({blob})), lambda i: {byte}), lambda c, b: {bits}), 4294967295)"


def _part(col: str) -> str:
    return f"coalesce(octet_length(encode(cast({col} as varchar))) || ':' || cast({col} as varchar), '-')"


SQL["op11_merkle"] = f"""
with recursive l as (select row_number() over () as r, doc_id, lang, {_crc32("encode(cast(doc_id as varchar))")} % {merkle.TAMPERED} = 0 as hit,
              {_part('doc_id')} || {_part('source')} || {_part('lang')} as head, n_chars, {_part('text')} as body from documents),
 h as (select r, doc_id, lang, sha256(head || {_part('n_chars')} || body) as leaf,
              sha256(head || case when hit then {_part('n_chars + 1')} else {_part('n_chars')} end || body) as tried from l),
 p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from h),
 up as (select lang, 0 as lv, n, list(leaf order by pos) as nodes from p group by lang, n
        union all
        select lang, lv + 1, (n + 1) // 2, list_transform(range((n + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
        from up where n > 1),
 tops as (select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from up where n = 1),
 high as (select 0 as lv, any_value(n) as n, list(subroot order by pos) as nodes from tops having count(*) > 0
          union all
          select lv + 1, (n + 1) // 2, list_transform(range((n + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')))
          from high where n > 1),
 f as (select p.r, p.lang, 0 as lv, p.pos, p.n, p.tried as node, '' as proof from p
       union all
       select f.r, f.lang, f.lv + 1, f.pos // 2, (f.n + 1) // 2,
              sha256(case when f.pos % 2 = 1 then up.nodes[f.pos] || f.node else f.node || coalesce(up.nodes[f.pos + 2], '') end),
              f.proof || coalesce(case when f.pos % 2 = 1 then up.nodes[f.pos] else up.nodes[f.pos + 2] end, '')
       from f join up on f.lang is not distinct from up.lang and f.lv = up.lv where f.n > 1),
 g as (select f.r, 0 as lv, t.pos, t.n, f.node, f.proof from f join tops t on f.lang is not distinct from t.lang where f.n = 1
       union all
       select g.r, g.lv + 1, g.pos // 2, (g.n + 1) // 2,
              sha256(case when g.pos % 2 = 1 then high.nodes[g.pos] || g.node else g.node || coalesce(high.nodes[g.pos + 2], '') end),
              g.proof || coalesce(case when g.pos % 2 = 1 then high.nodes[g.pos] else high.nodes[g.pos + 2] end, '')
       from g join high on g.lv = high.lv where g.n > 1)
select p.doc_id, p.leaf, t.subroot, (select nodes[1] from high where n = 1) as root, sha256(g.proof) as proof_sha256, g.node as folded_root,
       g.node = (select nodes[1] from high where n = 1) as verified
from p join g on p.r = g.r and g.n = 1 join tops t on p.lang is not distinct from t.lang
"""

SQL["op12_topk"] = f"""
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({pivot_search.SCALE} * cast(x as double))) as e
           from embeddings where embedding is not null and list_count(embedding) = len(embedding)
             and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
 s as (select q.r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
       from v q join v c on q.r <> c.r and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
 k as (select query_id, vec_id, score, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from k where rank <= 5
"""

_TR = target_resampling
SQL["op13_resample"] = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
 f as (select r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as x from d),
 t as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as x from (select {_WORDS} as w from benchmark)),
 n as (select r, x, count(*) as n from f group by r, x),
 b as (select x, cast({_crc32('encode(x)')} % {_TR.BUCKETS} as int) as bucket from (select distinct x from f union select distinct x from t)),
 s as (select bucket, sum(n) as s from n join b using (x) group by bucket),
 u as (select bucket, count(*) as t from t join b using (x) group by bucket),
 z as (select coalesce((select sum(s) from s), 0)::double as s, coalesce((select sum(t) from u), 0)::double as t),
 g as (select s.bucket, floor(1000 * ln((coalesce(u.t, 0) + 1) * (z.s + {_TR.BUCKETS}) / ((s.s + 1) * (z.t + {_TR.BUCKETS}))))::bigint as gain
       from s left join u using (bucket), z),
 w as (select r, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight from n join b using (x) join g using (bucket) group by r),
 h as (select r, doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
              cast('0x' || substr(sha256('{_TR.SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint)::double as h from d left join w using (r)),
 c as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from h),
 e as (select r, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from c where n_features >= {2 * _TR.LEAST_WORDS - 1})
select doc_id, n_features, weight, score, case when rank <= n * {_TR.PERCENT} // 100 then rank end as rank from c left join e using (r)
"""

QUERIES = [
    op1_toxicity, op2_mix_sources, op3_quality, op4_warc, op5_simhash, op6_shards, op7_html, op8_exact_dedup, op9_chat, op10_decontaminate,
    op11_merkle, op12_topk, op13_resample,
]
