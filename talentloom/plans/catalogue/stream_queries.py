"""Batch forms of the streaming operators: the same functions over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.operators import progress
from talentloom.plans import batch
from talentloom.plans.catalogue.analytics_queries import PROGRESS_SQL
from talentloom.plans.catalogue.registry import query, uuid_sql
from talentloom.streaming import intake, status

AS_OF = "2024-02-01"


@query("r1_intake_plan", f"""
    select {uuid_sql("'/up/' || doc_id || suffix || '|' || n_chars")} as id, case when suffix = '.png' then 'processing' else 'ai_processing' end as status,
           case when suffix = '.png' then null else md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) end as digest
    from (select *, case lang when 'en' then '.txt' when 'de' then '.html' when 'es' then '.png' else '' end as suffix from documents)""")
def _(t):
    lang = F.col("lang")
    suffix = F.when(lang == "en", ".txt").when(lang == "de", ".html").when(lang == "es", ".png").otherwise("")
    name = F.concat(F.col("doc_id").cast("string"), suffix)
    files = t.documents.select(
        F.concat(F.lit("/up/"), name).alias("path"), name.alias("file_name"), F.col("n_chars").alias("file_size"),
        F.lit(None).cast("timestamp").alias("modified_at"), F.col("text").cast("binary").alias("content"),
    )
    out = batch.intake_plan(files, AS_OF)
    return out.select("id", F.col("processing_status").alias("status"), F.md5("raw_text").alias("digest"))


@query("r2_dedup_rows", "select event_id, user_id from events")
def _(t):
    """Rows delivered twice count once."""
    rows = t.events.select("event_id", "user_id")
    return intake.dedup_rows(rows.unionByName(rows), ["event_id"])


@query("r3_stream_status", "select resume_id, status from latest_v")
def _(t):
    return status.stream_status(t.status_events_v()).select("resume_id", "status")


@query("r4_quota_audit", """
    select user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, count(*) as n from events group by 1, 2 having count(*) > 1""")
def _(t):
    stamped = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return progress.quota_audit(stamped, "user_id", 1).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("r5_stuck_records", """
    select resume_id, status, cast(floor((epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(started)) / 1000000.0) as bigint) as waiting_seconds from (
    select l.resume_id, l.status, coalesce(max(e.ts) filter (where e.status = 'processing'), min(e.ts)) as started
    from latest_v l join status_events_v e on e.resume_id = l.resume_id group by 1, 2)
    where status not in ('completed', 'ai_failed') and epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(started) >= 121000000""")
def _(t):
    return progress.stuck_records(t.status_events_v(), "2024-01-31 00:00:00")


@query("r6_stream_bulk_progress", PROGRESS_SQL)
def _(t):
    return progress.bulk_progress(t.batch_events_v())
