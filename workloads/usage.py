"""Queries over usage payloads and session state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import usage as U
from tidemark.operators import monitor as M
from tidemark.operators import usage as S
from tidemark.session import scratch_path
from tidemark.sources import status as T
from tidemark.sources.usage import read_usage
from workloads import fixtures as X


def _samples(spark, sf_dir):
    return S.with_limit(S.skip_zero(S.normalize_usage(X.usage_payloads(spark, sf_dir))))


def _tracked(spark, sf_dir):
    return M.track_sessions(_samples(spark, sf_dir))


def usage_normalized(spark, sf_dir):
    return S.normalize_usage(X.usage_payloads(spark, sf_dir)).select(
        "session_id", "event_id", "model", "prompt_tokens", "output_tokens", "cached_tokens", "context_size"
    )


def model_context(spark, sf_dir):
    name = X.pick(X.NAMES, F.col("event_id") % len(X.NAMES))
    counted = X.table(spark, sf_dir, "events").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return counted.select(
        "name", "n", U.normalize_model(F.col("name")).alias("model"), U.max_context(F.col("name")).alias("max_context")
    )


def usage_saturation(spark, sf_dir):
    return S.with_saturation(_samples(spark, sf_dir)).select(
        "session_id", "event_id", "t_us", "max_context", "ratio", "step", "tier", "critical",
        U.one_decimal(F.col("ratio") * 100).alias("percent"),
    )


def zero_skip(spark, sf_dir):
    df = S.normalize_usage(X.usage_payloads(spark, sf_dir))
    return S.skip_zero(df).groupBy("session_id").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("tokens"))


def distill_due(spark, sf_dir):
    return S.should_distill(_samples(spark, sf_dir)).select("session_id", "event_id", "prompt_tokens")


def session_resets(spark, sf_dir):
    return _tracked(spark, sf_dir).select(
        "session_id", "event_id", "prev_tokens", "prev_t_us", "reset_reason", "epoch"
    )


def step_notices(spark, sf_dir):
    return M.step_notices(_tracked(spark, sf_dir)).select("session_id", "event_id", "step", "last_step")


def tier_triggers(spark, sf_dir):
    return M.tier_triggers(_tracked(spark, sf_dir)).select(
        "session_id", "event_id", "t_us", "ratio", "epoch", "last_bucket", "fired_bucket"
    )


def pending_tiers(spark, sf_dir):
    return M.pending_tiers(_tracked(spark, sf_dir))


def monotone_notices(spark, sf_dir):
    return M.monotone_notices(_samples(spark, sf_dir), ("session_id",)).select(
        "session_id", "event_id", "bucket", "last_bucket"
    )


def latest_status(spark, sf_dir):
    return M.latest_status(_tracked(spark, sf_dir))


def latest_status_overall(spark, sf_dir):
    return M.latest_status(_tracked(spark, sf_dir), ())


def trigger_summary(spark, sf_dir):
    return M.trigger_summary(_tracked(spark, sf_dir))


def reset_summary(spark, sf_dir):
    return M.reset_summary(_tracked(spark, sf_dir))


def session_status(spark, sf_dir):
    """Status of sessions that begin, go on or are unknown: one per conversation."""
    first = X.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    started = T.start_sessions(first.select((F.col("session_id") * 2).alias("session_id"), F.lit(-1).cast("bigint").alias("t_us")))
    root = scratch_path(spark, "status")
    T.write_status(started, root, 1)
    T.write_status(M.latest_status(_tracked(spark, sf_dir)), root, 2)
    return T.status_of(first, T.read_status(spark, root))


def usage_lines(spark, sf_dir):
    """Payloads written as lines of text with their keys, and read back."""
    folder = scratch_path(spark, "lines")
    line = F.expr("""concat('{"session_id":"', session_id, '","event_id":', event_id, ',"t_us":', t_us, ',', substring(payload, 2))""")
    X.usage_payloads(spark, sf_dir).select(line.alias("value")).write.text(folder)
    return read_usage(spark, folder).select("session_id", "event_id", "t_us", "model", "prompt_tokens", "context_size")


def size_override(spark, sf_dir):
    """A size stated in the payload counts, but for zero."""
    stated = F.when(F.col("event_id") % 3 == 0, "12345").otherwise("0")
    other = F.regexp_replace(F.col("payload"), F.lit('"context_window_size":[0-9]+'), F.concat(F.lit('"context_window_size":'), stated))
    return S.with_limit(S.normalize_usage(X.usage_payloads(spark, sf_dir).withColumn("payload", other))).select("event_id", "model", "max_context")


def _unnamed(spark, sf_dir):
    """Samples of which a tenth of the sessions has no name and some have no time."""
    return _samples(spark, sf_dir).withColumns({
        "session_id": F.expr("if(session_id % 10 = 0, null, session_id)"), "t_us": F.expr("if(event_id % 97 = 0, null, t_us)"),
    })


def unnamed_resets(spark, sf_dir):
    """Samples without a session are one session; none with a time is lost."""
    return M.track_sessions(_unnamed(spark, sf_dir)).select("session_id", "event_id", "prev_tokens", "reset_reason", "epoch", "fired_bucket")


def untimed_samples(spark, sf_dir):
    return M.untimed(_unnamed(spark, sf_dir)).select("session_id", "event_id", "prompt_tokens")


QUERIES = [
    unnamed_resets, untimed_samples, usage_lines, size_override,
    session_status, usage_normalized, model_context, usage_saturation, zero_skip, distill_due, session_resets, step_notices,
    tier_triggers, pending_tiers, monotone_notices, latest_status, latest_status_overall, trigger_summary,
    reset_summary,
]

_SOURCE = """
src as (
  select user_id as session_id, event_id, event_type,
         (epoch_us(ts) - 1704067200000000) // 288 as t_us,
         ['Claude Sonnet (preview)','GPT-OSS-120B','gemini_flash','Gemini Pro'][user_id % 4 + 1] as model_name,
         cast([200000,131072,1048576,2097152][user_id % 4 + 1] as bigint) as size,
         cast(round(value * 100) as bigint) * 4 as inc
  from events),
smp as (
  select *, case when event_type = 'error' then 0 else cast(
      sum(inc) over (partition by session_id order by t_us, event_id rows unbounded preceding) as bigint) % size end as tokens
  from src)
"""
_SAMPLES = _SOURCE + """,
sat as (
  select session_id, event_id, t_us, tokens as prompt_tokens, size as max_context,
         tokens::double / size::double as ratio
  from smp where tokens <> 0),
smpl as (
  select *, cast(floor(ratio / cast('0.05' as double)) as bigint) as step,
         coalesce(list_max(list_filter([20,30,40,50,60,70], lambda b: b <= ratio * 100)), 0) as tier
  from sat)
"""
_STATE = _SAMPLES + """,
prv as (
  select *, lag(prompt_tokens) over w as prev_tokens, lag(t_us) over w as prev_t_us, lag(step) over w as prev_step
  from smpl window w as (partition by session_id order by t_us, event_id)),
rst as (
  select *, case when t_us - prev_t_us > 300000000 then 'idle'
       when prev_tokens::double / max_context >= cast('0.10' as double)
            and prompt_tokens::double / max_context < cast('0.10' as double) then 'below_floor'
       when prompt_tokens < prev_tokens * cast('0.5' as double) then 'drop' end as reset_reason
  from prv),
epo as (
  select *, case when prev_tokens is null or reset_reason is not null then 0 else prev_step end as last_step,
       cast(sum(case when reset_reason is null then 0 else 1 end)
         over (partition by session_id order by t_us, event_id rows unbounded preceding) as bigint) as epoch
  from rst),
trk as (
  select *, coalesce(max(tier) over (partition by session_id, epoch order by t_us, event_id
       rows between unbounded preceding and 1 preceding), 0) as last_bucket
  from epo),
trg as (select *, case when tier > last_bucket then tier end as fired_bucket from trk)
"""
_PERCENT = """case when {x} * 4 = floor({x} * 4) then printf('%.1f', floor({x} * 10 + 0.5::double) / 10)
       else printf('%.1f', {x}) end""".format(x="(ratio * 100)")
_STATUS = f"case when fired_bucket is not null then '[GCS: ' || {_PERCENT} || '% ⚡ YOLO]' else 'GCS: ' || {_PERCENT} || '%' end"
_NAMES = ", ".join("'" + n + "'" for n in X.NAMES)

SQL = {
    "usage_normalized": f"""with {_SOURCE}
select session_id, event_id, lower(model_name) as model, tokens as prompt_tokens, inc % 1000 as output_tokens,
       inc % 77 as cached_tokens, case when event_type = 'view' then size end as context_size from smp""",
    "model_context": f"""with n as (
  select [{_NAMES}][event_id % {len(X.NAMES)} + 1] as name, count(*) as n from events group by 1),
m as (select name, n, trim(regexp_replace(regexp_replace(lower(name), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]+', '-', 'g'), '-') as model from n),
w as (select *, string_split(model, '-') as words from m)
select name, n, model, cast(case when model like 'gpt-oss-120b%' then 131072
  when list_has_any(words, ['claude','sonnet','opus']) then 200000
  when list_contains(words, 'gemini') then case when list_contains(words, 'pro') then 2097152 else 1048576 end
  when list_contains(words, 'flash') then 1048576
  when list_contains(words, 'pro') then 2097152 else 1048576 end as bigint) as max_context from w""",
    "usage_saturation": f"""with {_SAMPLES}
select session_id, event_id, t_us, max_context, ratio, step, tier, ratio >= cast('0.80' as double) as critical,
       {_PERCENT} as percent from smpl""",
    "zero_skip": f"""with {_SOURCE}
select session_id, count(*) as n, cast(sum(tokens) as bigint) as tokens from smp where tokens <> 0 group by 1""",
    "distill_due": f"""with {_SOURCE}
select session_id, event_id, tokens as prompt_tokens from smp where tokens >= 400000""",
    "session_resets": f"""with {_STATE}
select session_id, event_id, prev_tokens, prev_t_us, reset_reason, epoch from trg""",
    "step_notices": f"with {_STATE} select session_id, event_id, step, last_step from trg where step > last_step",
    "tier_triggers": f"""with {_STATE}
select session_id, event_id, t_us, ratio, epoch, last_bucket, fired_bucket from trg where fired_bucket is not null""",
    "pending_tiers": f"""with {_STATE},
p as (select *, list_filter([20,30,40,50,60,70], lambda b: b > last_bucket and b <= ratio * 100) as pend from trg)
select session_id, event_id, t_us, u.i - 1 as pos, pend[u.i] as bucket
from p, (select unnest(range(1, 7)) as i) u where u.i <= len(pend)""",
    "monotone_notices": f"""with {_SAMPLES},
b as (select *, cast(floor(prompt_tokens::double / 2000000::double * 100 / 5) * 5 as bigint) as bucket from smpl),
m as (select *, coalesce(max(bucket) over (partition by session_id order by t_us, event_id
      rows between unbounded preceding and 1 preceding), 0) as last_bucket from b)
select session_id, event_id, bucket, last_bucket from m where bucket > 0 and bucket > last_bucket""",
    "latest_status": f"""with {_STATE},
r as (select *, row_number() over (partition by session_id order by t_us desc, event_id desc) as rn from trg)
select session_id, t_us, event_id, {_STATUS} as status from r where rn = 1""",
    "latest_status_overall": f"""with {_STATE}
select t_us, event_id, {_STATUS} as status from trg order by t_us desc, event_id desc limit 1""",
    "session_status": f"""with {_STATE},
r as (select *, row_number() over (partition by session_id order by t_us desc, event_id desc) as rn from trg),
s as (select distinct conv_id as session_id from conversations),
l as (select session_id, {_STATUS} as status from r where rn = 1)
select s.session_id, coalesce(l.status, case when b.session_id is not null then '[GCS: 0%]' end, '[GCS: --]') as status
from s left join l on l.session_id = s.session_id left join s b on b.session_id * 2 = s.session_id""",
    "trigger_summary": f"""with {_STATE}
select session_id, fired_bucket, count(*) as n_fired from trg where fired_bucket is not null group by all""",
    "reset_summary": f"""with {_STATE}
select session_id, reset_reason, count(*) as n_resets from trg where reset_reason is not null group by all""",
}

_NAMED = _STATE.replace("  from smpl window", "  from smp2 window").replace("prv as (", """smp2 as (
  select * replace (case when session_id % 10 = 0 then -1 else session_id end as session_id) from smpl where event_id % 97 <> 0),
prv as (""")
SQL["unnamed_resets"] = f"with {_NAMED} select session_id, event_id, prev_tokens, reset_reason, epoch, fired_bucket from trg"
SQL["untimed_samples"] = f"""with {_SAMPLES}
select case when session_id % 10 <> 0 then session_id end as session_id, event_id, prompt_tokens from smpl where event_id % 97 = 0"""
SQL["usage_lines"] = f"""with {_SOURCE}
select cast(session_id as varchar) as session_id, event_id, t_us, lower(model_name) as model, tokens as prompt_tokens,
       case when event_type = 'view' then size end as context_size from smp"""
SQL["size_override"] = f"""with {_SOURCE}
select event_id, lower(model_name) as model, cast(case when event_type = 'view' and event_id % 3 = 0 then 12345 else size end as bigint) as max_context from smp"""
