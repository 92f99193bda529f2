"""Queries that run a stream over the usage samples, slice by slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import blocks as B
from tidemark.functions import redact as R
from tidemark.operators import rehydrate as H
from tidemark.operators import usage as S
from tidemark.session import scratch_path
from tidemark.sources import snapshot as N
from tidemark.sources import status as T
from tidemark.sources.files import scan_files
from tidemark.streaming import distill as D
from tidemark.streaming import monitor as M
from tidemark.streaming import sessions as W
from workloads import fixtures as X
from workloads import sqlparts as P
from workloads import usage as U

SLICE_US = 2_500_000_000  # what arrives between two triggers
ONE_BATCH = 2**31 - 1  # files of a trigger: a delivery is one increment, however large
DELAYED = 7  # every so many samples come one slice late
SAMPLE = "session_id BIGINT, event_id BIGINT, t_us BIGINT, prompt_tokens BIGINT, max_context BIGINT"


def _arrivals(spark, sf_dir, delayed):
    """One folder per slice of time, in order; the tasks write what they hold of each."""
    samples = S.with_limit(S.normalize_usage(X.usage_payloads(spark, sf_dir)))
    late = F.when(F.col("event_id") % DELAYED == 0, 1).otherwise(0) if delayed else F.lit(0)
    rows = samples.select(*[c.split()[0] for c in SAMPLE.split(", ")], (F.expr(f"t_us div {SLICE_US}") + late).alias("slice"))
    made = scratch_path(spark, "slices")
    rows.write.partitionBy("slice").parquet(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f.getPath() for f in fs.globStatus(path(f"{made}/slice=*"))]  # one per slice
    return sorted((f.toString() for f in folders), key=lambda f: int(f.rpartition("=")[2]))


def _run(spark, sf_dir, *sinks, delayed=False):
    """One stream over the slices, a micro-batch each: a slice arrives, however many files it has, and the stream goes on."""
    tables = W.SessionTables(spark, scratch_path(spark, "sessions"))
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    slices, landing, progress = _arrivals(spark, sf_dir, delayed), scratch_path(spark, "landing"), scratch_path(spark, "progress")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(landing).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(landing))
    stream = own.readStream.schema(SAMPLE).option("recursiveFileLookup", True).parquet(landing)
    for folder in slices:
        fs.rename(path(folder), path(landing))
        q = (
            stream.writeStream.foreachBatch(W.session_sink(tables, *sinks))
            .option("checkpointLocation", progress).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return tables


def stream_monitor(spark, sf_dir):
    """Samples of which some come late, merged: the result of the batch form."""
    tables = _run(spark, sf_dir, delayed=True)
    tables.merge_late()
    return tables.result().select("session_id", "event_id", "ratio", "step", "last_step", "last_bucket", "fired_bucket", "notice")


def late_samples(spark, sf_dir):
    """Samples that could not be appended, with the batch they came in."""
    late = _run(spark, sf_dir, delayed=True).arrived("late")
    return late.select("session_id", "event_id", "t_us", "prompt_tokens", "batch_id")


def expired_sessions(spark, sf_dir):
    """The end of each quiet spell, with the last state before it."""
    tables = _run(spark, sf_dir, delayed=True)
    tables.merge_late()
    return tables.result("expired").select("session_id", "t_us", "prompt_tokens", "expired_us")


def stream_status(spark, sf_dir):
    root = scratch_path(spark, "status")
    _run(spark, sf_dir, M.status_sink(root))
    return T.read_status(spark, root)


def _version(batch: str) -> str:
    """Which form a page has when a batch fires: some change every time, some every second or third."""
    return f"({batch} + page_id) div (1 + page_id % 3)"


def _listing(spark, sf_dir):
    """Files as they are at a batch: their page and its version; a few are gone from batch 2 on."""

    def files(batch_id):
        text = F.concat("text", F.lit("<!-- v"), F.expr(_version(str(batch_id))).cast("string"), F.lit(" -->"))
        rows = X.source_files(spark, sf_dir).filter(F.lit(batch_id < 2) | (F.col("page_id") % 11 != 10))
        return rows.withColumn("text", text).withColumn("n_bytes", B.size(F.col("text")))

    return files


def _triggered(spark, sf_dir):
    runs = D.DeltaRuns(spark, scratch_path(spark, "snapshots"), _listing(spark, sf_dir), B.PAGE_KINDS, R.LITERAL)
    _run(spark, sf_dir, runs.sink)
    return runs


def stream_distill(spark, sf_dir):
    """The batches that fired a threshold and the files each of them distilled or found gone."""
    return _triggered(spark, sf_dir).distilled().select("batch_id", "path", "gone")


def compacted_increments(spark, sf_dir):
    """The increments of these runs folded into one snapshot: its blocks, cut from the files as they are at last."""
    runs = _triggered(spark, sf_dir)
    name = D.compact(spark, runs.root)
    last = runs.runs().filter("n_fired > 0").agg(F.max("batch_id")).first()[0]
    whole = N.read_snapshot(spark, runs.root, name)
    cut = H.rehydrate_blocks(whole.source_map.select("path", "symbol"), whole.source_map, runs.listing(last))
    held = whole.skeletons.join(whole.members, "key").groupBy("path").agg(F.count("*").alias("n_texts"))
    return cut.join(held, "path").select("path", "symbol", F.md5("block").alias("digest"), "n_texts")


def stream_increments(spark, sf_dir):
    """Files that are delivered in two steps, some again, distilled as they come; blocks of either part are found and cut from the files."""
    root, folder, ck, files = *(scratch_path(spark, x) for x in ("increments", "tree", "progress")), X.source_files(spark, sf_dir)
    deliveries = ["page_id % 2 = 0", "page_id % 2 = 1 or page_id % 10 = 0"]
    for part, delivered in enumerate(deliveries):
        X.write_tree(files.filter(delivered).select("path", "text"), f"{folder}/{part}")
        D.distill_new_files(spark, folder, root, ck, per_trigger=ONE_BATCH, kinds=B.PAGE_KINDS, literal=R.LITERAL, deliveries=True).awaitTermination()
    old, new = (scan_files(spark, f"{folder}/{part}") for part in range(len(deliveries)))
    last = new.unionByName(old.join(new.select("path"), "path", "left_anti"))  # of a file delivered again the last one counts
    spans = D.latest_source_map(spark, root)
    cut = H.rehydrate_blocks(spans.select("path", "symbol", "snapshot_id"), spans, last)
    held = D.latest_skeletons(spark, root).join(D.latest_members(spark, root), ["key", "snapshot_id"]).groupBy("path").agg(F.count("*").alias("n_texts"))
    return cut.join(held, "path").select("path", "symbol", "snapshot_id", F.md5("block").alias("digest"), "n_texts")


QUERIES = [compacted_increments, late_samples, expired_sessions, stream_monitor, stream_status, stream_distill, stream_increments]

SQL = {
    "stream_monitor": f"""with {U._STATE}
select session_id, event_id, ratio, step, last_step, last_bucket, fired_bucket, step > last_step as notice from trg""",
    "stream_status": U.SQL["latest_status"],
}
_ARRIVED = f"""{U._STATE},
arr as (select *, t_us // {SLICE_US} + case when event_id % {DELAYED} = 0 then 1 else 0 end as slice from smpl),
pos as (select *, cast(t_us as hugeint) * 1000000000000 + event_id as place from arr),
num as (select slice, dense_rank() over (order by slice) - 1 as batch_id from (
          select distinct (epoch_us(ts) - 1704067200000000) // 288 // {SLICE_US} + case when event_id % {DELAYED} = 0 then 1 else 0 end as slice from events)),
had as (select pos.*, max(place) over (partition by session_id order by slice range between unbounded preceding and 1 preceding) as last_place,
               max(t_us) over (partition by session_id order by slice range between unbounded preceding and 1 preceding) as last_t,
               max(t_us) over (order by slice range between unbounded preceding and 1 preceding) as newest from pos)"""
_QUIET = (fixed.IDLE_SECONDS + W.LATE_SECONDS) * 1_000_000
SQL["late_samples"] = f"""with {_ARRIVED}
select session_id, event_id, t_us, prompt_tokens, batch_id from had join num using (slice)
where case when last_t + {_QUIET} >= newest then place <= last_place else t_us < newest - {W.LATE_SECONDS * 1_000_000} end"""
SQL["expired_sessions"] = f"""with {U._STATE},
nxt as (select *, lead(t_us) over (partition by session_id order by t_us, event_id) as next_t, max(t_us) over () as newest from smpl)
select session_id, t_us, prompt_tokens, t_us + {_QUIET} as expired_us from nxt where coalesce(next_t, newest) - t_us > {_QUIET}"""
_VERSION = _version("{b}").replace("div", "//")
_RUNS = f"""{U._STATE}, {P.FILES},
num as (select slice, dense_rank() over (order by slice) - 1 as b from (
          select distinct (epoch_us(ts) - 1704067200000000) // 288 // {SLICE_US} as slice from events)),
run as (select b, lag(b) over (order by b) as p, max(b) over () as z from num where slice in (select t_us // {SLICE_US} from trg where fired_bucket is not null)),
has as (select b, p, z, page_id, path, text, b < 2 or page_id % 11 <> 10 as here, p is not null and (p < 2 or page_id % 11 <> 10) as was,
               {_VERSION.replace("{b}", "b")} as v, {_VERSION.replace("{b}", "p")} as w from run, files where ext <> 'md')"""
SQL["stream_distill"] = f"""with {_RUNS}
select b as batch_id, path, not here as gone from has where here and not (was and v = w) or was and not here"""
SQL["compacted_increments"] = f"""with {_RUNS},
f as (select path, regexp_extract_all(text, '{P.PAGE_BLOCKS}') as blocks from has where b = z and here)
select path, lower(regexp_extract(blocks[u.i], '^<([A-Za-z]+)', 1)) || '_' || (u.i - 1) as symbol, md5(blocks[u.i]) as digest, cast(1 as bigint) as n_texts
from f, lateral (select unnest(range(1, len(blocks) + 1)) as i) u"""
SQL["stream_increments"] = f"""with {P.FILES},
f as (select page_id, path, regexp_extract_all(text, '{P.PAGE_BLOCKS}') as blocks from files where ext <> 'md')
select path, lower(regexp_extract(blocks[u.i], '^<([A-Za-z]+)', 1)) || '_' || (u.i - 1) as symbol,
       case when page_id % 2 = 1 or page_id % 10 = 0 then 'part-000000000001' else 'part-000000000000' end as snapshot_id,
       md5(blocks[u.i]) as digest, cast(1 as bigint) as n_texts
from f, lateral (select unnest(range(1, len(blocks) + 1)) as i) u"""
