"""J1-J4 on the events table, read as a stream of Parquet files."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelmeter.plans import fixtures as fx
from voxelmeter.plans.fixtures import r
from voxelmeter.plans.registry import query
from voxelmeter.session import scratch_path
from voxelmeter.streaming import streams as sm


def _source(spark, sf, rows=None, files_per_batch=6):
    """The events as six files in shuffled time order, then as a stream."""
    path = scratch_path(spark, "events")
    ev = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")) if rows is None else rows
    ev.repartition(6, F.xxhash64(*ev.columns)).write.parquet(path)
    return spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _drain(spark, stream, mode="append"):
    return sm.run_available(stream, scratch_path(spark, "out"), scratch_path(spark, "offsets"), mode)


@query("j1_progress_windows", """select date_trunc('hour', ts)::timestamp as window_start, count(*) filter (event_type in ('view','purchase')) as done,
 count(*) filter (event_type='error') as failed from events group by 1""")
def j1(spark, sf):
    kind = F.col("event_type")
    s = sm.progress_stream(_source(spark, sf), "ts", kind.isin("view", "purchase"), kind == "error")
    out = _drain(spark, s, "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "done", "failed")


@query("j1_progress_report", f"""with w as (select date_trunc('hour', ts) as ws, count(*) filter (event_type in ('view','purchase')) as d, count(*) filter (event_type='error') as f, min(ts) t0, max(ts) t1 from events group by 1),
 a as (select sum(d)::bigint done, sum(f)::bigint failed, epoch(min(t0)) t0, epoch(max(t1)) t1, arg_max(d, ws) recent, epoch(max(ws)) ws from w),
 b as (select *, case when t1>t0 and done>0 then done/(t1-t0) else 0 end av, case when t1>ws and recent>0 then recent/(t1-ws) else 0 end rc, greatest((select count(*) from events)-done,0) as lft from a)
 select done, failed, lft as remaining, {r('av', 9)} as average_rate, {r('rc', 9)} as recent_rate, {r('lft/case when rc>0 then rc else av end', 4)} as eta_seconds from b""", digits=9)
def j1b(spark, sf):
    kind = F.col("event_type")
    s = sm.progress_stream(_source(spark, sf), "ts", kind.isin("view", "purchase"), kind == "error")
    total = fx.table(spark, sf, "events").count()
    return sm.progress_report(_drain(spark, s, "complete"), total).withColumn("eta_seconds", F.round("eta_seconds", 4))


@query("j2_journal_stream", f"""select event_type as arm, row_number() over (partition by event_type order by ts, event_id) as global_update, {r('value')} as loss from events""")
def j2(spark, sf):
    j = fx.journal(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    doubled = j.union(j.where("loss > 50"))
    out = sm.merge_by_key(_source(spark, sf, doubled, 2), ["arm", "global_update"], "ts", scratch_path(spark, "out"), scratch_path(spark, "offsets"))
    return out.select("arm", "global_update", "loss")


@query("j3_barrier_stream", """with t as (select event_type as arm, user_id, (event_id//50)::bigint as milestone from events), e as (select distinct milestone, user_id from t),
 c as (select milestone, arm, count(*) n, count(distinct user_id) d from (select milestone, arm, user_id from t where arm in ('click','view') union all
 select e.milestone, x.arm, e.user_id from e, (select unnest(['click','view']) arm) x where e.milestone % 2 = 0 and not exists (select 1 from t where t.milestone=e.milestone and t.arm=x.arm and t.user_id=e.user_id)) group by all)
 select c.milestone, count(*) as arms_reported, count(*) filter (n=en and d=en) as arms_exact, count(*) filter (n=en and d=en)=2 as released from c join (select milestone, count(*) en from e group by 1) w using (milestone) group by 1""")
def j3(spark, sf):
    t = fx.table(spark, sf, "events").select(F.col("event_type").alias("arm"), "user_id", F.expr("event_id div 50").alias("milestone"))
    expected = t.select("milestone", "user_id").distinct()
    own = t.where("arm in ('click', 'view')")
    # In even milestones every arm also reports the keys it lacks; repeats may remain.
    both = expected.where("milestone % 2 = 0").withColumn("arm", F.explode(F.array(F.lit("click"), F.lit("view"))))
    rest = both.join(own, ["milestone", "arm", "user_id"], "left_anti").select("arm", "user_id", "milestone")
    reported = sm.barrier_stream(_source(spark, sf, own.union(rest), 2), "milestone", "arm", ["user_id"], scratch_path(spark, "out"), scratch_path(spark, "offsets"))
    return sm.released(reported, expected, "milestone", "arm", 2, ["user_id"])


_J4 = """with s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as sid from (select user_id, event_id, ts,
 case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 12 hour then 1 else 0 end as fresh from events)),
 g as (select user_id, sid, min(ts) as started, max(ts) as last_beat, max(ts) + interval 12 hour as expired, count(*) as beats from s group by 1,2)
 select user_id, started, last_beat, expired, beats from g where expired <= (select date_trunc('millisecond', max(ts)) - interval 10 minute from events)"""


@query("j4_heartbeat_stream", _J4)
def j4(spark, sf):
    out = _drain(spark, sm.heartbeat_stream(_source(spark, sf), "ts", ["user_id"], "12 hours"))
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "last_beat", "expired")], "beats")
