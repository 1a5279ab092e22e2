"""Lookups, gates, joins and versions of stored records."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom import rules, schemas
from talentloom.operators import records
from talentloom.sources import store
from talentloom.plans.catalogue.registry import query, uuid_sql

NOW = "2024-03-01 12:00:00"


def _text(name):
    return F.col(name).cast("string").alias(name)


@query("p01_lookup_status", """
    select w.id, r.processing_status as status, case when r.id is null then 'not_found' else 'ok' end as outcome
    from wanted_ids_v w left join stored_resumes_v r on r.id = w.id""")
def _(t):
    return records.lookup_status(t.stored_resumes_v(), t.wanted_ids_v())


_GATE = "case when r.id is null then 'not_found' when processing_status is distinct from 'completed' then 'not_ready' else 'ok' end"


@query("p02_retrieve", f"""
    select id, outcome, status, case when outcome = 'ok' then file_name end as file_name,
           case when outcome = 'ok' then full_name end as full_name,
           case when outcome = 'ok' then cast(file_size as varchar) end as file_size
    from (select w.id, {_GATE} as outcome, processing_status as status, file_name, file_size, full_name
          from wanted_ids_v w left join stored_resumes_v r on r.id = w.id)""")
def _(t):
    return records.retrieve(t.stored_resumes_v(), t.wanted_ids_v()).select(
        "id", "outcome", "status", "file_name", F.col("structured_data.personalInfo.name.full").alias("full_name"),
        _text("file_size"),
    )


@query("p03_assemble_record", """
    select id, file_name, file_size, case when processing_status = 'completed' then full_name end as full_name,
           case when processing_status = 'completed' then industry end as industry, 0 as n_experience,
           0 as n_certifications, true as no_skills, completeness
    from stored_resumes_v""")
def _(t):
    return records.assemble_record(t.stored_resumes_v()).select(
        "id", "metadata.file_name", "metadata.file_size", F.col("personalInfo.name.full").alias("full_name"),
        F.col("summary.industryFocus").alias("industry"), F.size("experience").alias("n_experience"),
        F.size("certifications").alias("n_certifications"), F.col("skills").isNull().alias("no_skills"),
        F.col("aiEnhancements.completenessScore").cast("string").alias("completeness"),
    )


@query("p04_resume_analytics", f"""
    select id, outcome, status, case when outcome = 'ok' then completeness end as completeness
    from (select w.id, {_GATE} as outcome, processing_status as status, completeness
          from wanted_ids_v w left join stored_resumes_v r on r.id = w.id)""")
def _(t):
    return records.resume_analytics(t.stored_resumes_v(), t.wanted_ids_v()).select(
        "id", "outcome", "status", F.col("ai_enhancements.completenessScore").cast("string").alias("completeness")
    )


@query("p05_select_sections", """
    select id, case when processing_status = 'completed' then full_name end as full_name, 0 as n_education
    from stored_resumes_v""")
def _(t):
    chosen = records.select_sections(records.assemble_record(t.stored_resumes_v()), ["personalInfo", "education"])
    return chosen.select("id", F.col("personalInfo.name.full").alias("full_name"), F.size("education").alias("n_education"))


@query("p06_ready_for_match", "select id, full_name from stored_resumes_v where processing_status = 'completed'")
def _(t):
    return records.ready_for_match(t.stored_resumes_v()).select(
        "id", F.col("structured_data.personalInfo.name.full").alias("full_name")
    )


_MATCH_IDS = "select o_custkey || '-' || (o_orderkey % 100) as id from orders"


def _match_ids(t):
    return t.orders.select(F.concat_ws("-", "o_custkey", F.col("o_orderkey") % 100).alias("id"))


@query("p07_lookup_match_status", f"""
    select w.id as match_id, m.status, case when m.id is null then 'not_found' else 'ok' end as outcome
    from ({_MATCH_IDS}) w left join stored_matches_v m on m.id = w.id""")
def _(t):
    return records.lookup_match_status(t.stored_matches_v(), _match_ids(t))


@query("p08_retrieve_match", f"""
    select match_id, status, outcome, case when outcome = 'ok' then match_result end as match_result from (
    select w.id as match_id, m.status, m.match_result, case when m.id is null then 'not_found'
           when status <> 'completed' then 'not_ready' when match_result is null then 'no_result' else 'ok' end as outcome
    from ({_MATCH_IDS}) w left join stored_matches_v m on m.id = w.id)""")
def _(t):
    return records.retrieve_match(t.stored_matches_v(), _match_ids(t)).select("match_id", "status", "outcome", "match_result")


@query("p10_match_payload", """
    select id, id as payload_id, case when processing_status = 'completed' then full_name end as full_name,
           false as has_metadata from stored_resumes_v""")
def _(t):
    payload = records.match_payload(records.assemble_record(t.stored_resumes_v()))
    names = payload.schema["payload"].dataType.names
    return payload.select(
        "id", F.col("payload.id").alias("payload_id"), F.col("payload.personalInfo.name.full").alias("full_name"),
        F.lit("metadata" in names).alias("has_metadata"),
    )


@query("p11_split_enhancements", """
    select id, completeness, case when processing_status = 'completed' then full_name end as full_name from stored_resumes_v""")
def _(t):
    doc = F.when(F.col("structured_data").isNotNull(), F.col("structured_data").withField("aiEnhancements", F.col("ai_enhancements")))
    split = records.split_enhancements(t.stored_resumes_v().select("id", doc.alias("doc")))
    return split.select(
        "id", F.col("ai_enhancements.completenessScore").cast("string").alias("completeness"),
        F.col("structured_data.personalInfo.name.full").alias("full_name"),
    )


@query("p12_merge_block", """
    select r.id, r.completeness, case when i.resume_id is not null then 'USD' end as currency,
           cast(i.low as varchar) as low
    from stored_resumes_v r left join (select resume_id, cast(floor(min(salary)) as int) as low from experience_v group by 1) i
    on i.resume_id = r.id""")
def _(t):
    low = t.experience_v().groupBy(F.col("resume_id").alias("id")).agg(F.floor(F.min("salary")).cast("int").alias("low"))
    block = F.struct(
        F.col("low").alias("min"), F.lit(None).cast("int").alias("max"), F.lit("USD").alias("currency"),
        F.lit("from own roles").alias("comments"),
    ).cast(schemas.SALARY_ESTIMATE)
    merged = records.merge_block(t.stored_resumes_v(), "salaryEstimate", low.select("id", block.alias("block")))
    e = F.col("ai_enhancements")
    return merged.select(
        "id", e["completenessScore"].cast("string").alias("completeness"), e["salaryEstimate"]["currency"].alias("currency"),
        e["salaryEstimate"]["min"].cast("string").alias("low"),
    )


@query("p14_complete_matches", """
    select m.id, case when m.job_id % 3 <> 0 then m.status when r.industry is null then m.status
                 when r.industry in ('BUILDING', 'MACHINERY') then 'failed' else 'completed' end as status,
           case when m.job_id % 3 <> 0 or r.industry is null then m.match_result
                when r.industry in ('BUILDING', 'MACHINERY') then '{"error":"no answer for ' || r.industry || '"}'
                else '{"industry":"' || r.industry || '"}' end as match_result,
           m.job_id % 3 = 0 and r.industry is not null as changed
    from stored_matches_v m left join resumes_v r on r.resume_id = m.resume_id""")
def _(t):
    matches = t.stored_matches_v()
    people = t.resumes_v().select("resume_id", "industry")
    bad = F.col("industry").isin("BUILDING", "MACHINERY")
    results = matches.filter(F.col("status") == rules.PENDING).join(people, "resume_id").select(
        F.col("id").alias("match_id"), F.when(~bad, F.to_json(F.struct("industry"))).alias("result"),
        F.when(bad, F.concat(F.lit("no answer for "), "industry")).alias("error"),
    )
    return records.complete_matches(matches, results, NOW).select(
        "id", "status", "match_result", F.col("completed_at").isNotNull().alias("changed")
    )


_CHANGES = """select s_suppkey as id, case when s_acctbal > 5000 then 'completed' else 'ai_failed' end as status,
    s_name as raw_text from supplier"""


def _changes(t):
    return t.supplier.select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, rules.COMPLETED).otherwise(rules.AI_FAILED).alias("status"),
        F.col("s_name").alias("raw_text"),
    )


@query("p15_advance_status", f"""
    select r.id, coalesce(c.status, r.processing_status) as status, c.raw_text, c.id is not null as touched
    from stored_resumes_v r left join ({_CHANGES}) c on c.id = r.id""")
def _(t):
    out = records.advance_status(t.stored_resumes_v(), _changes(t), NOW).resumes
    touched = F.coalesce(F.col("processed_at") == F.lit(NOW).cast("timestamp"), F.lit(False))
    return out.select("id", F.col("processing_status").alias("status"), "raw_text", touched.alias("touched"))


@query("p15_status_events", f"select c.id, c.status from ({_CHANGES}) c join stored_resumes_v r on r.id = c.id")
def _(t):
    return records.advance_status(t.stored_resumes_v(), _changes(t), NOW).status_events.select("id", "status")


@query("j01_matches_with_resume", """
    select m.id, m.resume_id, m.status, r.processing_status as resume_status, r.file_name as resume_file_name
    from stored_matches_v m join stored_resumes_v r on r.id = m.resume_id""")
def _(t):
    return records.matches_with_resume(t.stored_matches_v(), t.stored_resumes_v()).select(
        "id", "resume_id", "status", F.col("resume_processing_status").alias("resume_status"), "resume_file_name"
    )


def _closing(t):
    return t.supplier.select(F.col("s_suppkey").alias("id"))


@query("j02_delete_records", """
    select r.id, s_suppkey is not null as deleted, case when s_suppkey is not null then r.id || '.pdf' end as stored_name
    from stored_resumes_v r left join supplier on s_suppkey = r.id""")
def _(t):
    out = records.delete_records(t.stored_resumes_v(), _closing(t))
    gone = out.files.select("id", F.lit(True).alias("deleted"), "stored_name")
    return gone.unionByName(out.remaining.select("id", F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("stored_name")))


@query("j02_delete_outcome", """
    select w.id, case when r.id is null then 'Resume not found' else 'Resume deleted successfully' end as message
    from wanted_ids_v w left join stored_resumes_v r on r.id = w.id""")
def _(t):
    return records.delete_outcome(t.stored_resumes_v(), t.wanted_ids_v())


def _as_keys(t):
    matches = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("resume_id"))
    kept = t.events.select(F.col("user_id").alias("id")).distinct()
    return matches, kept, t.customer.select(F.col("c_custkey").alias("id"))


@query("j03_fk_blocked", "select c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def _(t):
    matches, kept, deletes = _as_keys(t)
    return records.fk_violations(matches, kept, deletes).blocked


@query("j03_fk_orphans", "select o_orderkey as id, o_custkey as resume_id from orders where o_custkey not in (select user_id from events)")
def _(t):
    matches, kept, deletes = _as_keys(t)
    return records.fk_violations(matches, kept, deletes).orphans.select("id", "resume_id")


@query("j03_fk_cascade", "select o_orderkey as id, o_custkey as resume_id from orders where o_custkey not in (select s_suppkey from supplier)")
def _(t):
    matches, kept, _all = _as_keys(t)
    deletes = t.supplier.select(F.col("s_suppkey").alias("id"))
    return records.fk_violations(matches, kept, deletes, cascade=True).matches_left.select("id", "resume_id")


def _updates(t):
    """Every supplier sends a new record under its key; keys beyond the customers are unknown."""
    info = F.struct(F.struct(F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last"),
                             F.col("s_name").alias("full")).alias("name"), F.lit(None).cast(schemas.CONTACT).alias("contact"))
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in schemas.DOC.fields}
    nothing["personalInfo"] = info
    nothing["experience"] = F.array(F.struct(*[
        (F.col("s_name") if f.name in ("title", "company") else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schemas.ROLE.fields
    ]))
    doc = F.struct(*[v.alias(k) for k, v in nothing.items()]).cast(schemas.DOC)
    return t.supplier.select(F.col("s_suppkey").alias("id"), doc.alias("structured_data"))


@query("j04_overwrite_records", """
    select r.id, case when s_suppkey is not null then 'completed' else processing_status end as status,
           case when s_suppkey is not null then s_name when processing_status = 'completed' then full_name end as full_name,
           case when s_suppkey is null then completeness end as completeness
    from stored_resumes_v r left join supplier on s_suppkey = r.id""")
def _(t):
    return records.overwrite_records(t.stored_resumes_v(), _updates(t), NOW).select(
        "id", F.col("processing_status").alias("status"), F.col("structured_data.personalInfo.name.full").alias("full_name"),
        F.col("ai_enhancements.completenessScore").cast("string").alias("completeness"),
    )


@query("j04_store_overwrite", """
    select r.id, case when s_suppkey is not null then 'completed' else processing_status end as status,
           case when s_suppkey is not null then s_name when processing_status = 'completed' then full_name end as full_name, r.id % 7 = 0 as second
    from stored_resumes_v r left join supplier on s_suppkey = r.id where r.id % 7 <> 0 or r.id not between 7 and 70
    union all select r.id, processing_status, case when processing_status = 'completed' then full_name end, true from stored_resumes_v r where r.id % 7 = 0 and r.id between 7 and 70""")
def _(t):
    """A stored table after two changes, an overwrite and a delete, each by the buckets of its ids; deleted rows are read from the version before both."""
    root = store.scratch_folder(t.spark, "store")
    store.create_store(t.stored_resumes_v(), root, buckets=64)
    store.change_store(t.spark, root, _updates(t), lambda rows: records.overwrite_records(rows, _updates(t), NOW))
    gone = t.spark.range(7, 71, 7).toDF("id")
    store.change_store(t.spark, root, gone, lambda rows: records.delete_records(rows, gone).remaining)
    old = store.read_store(t.spark, root, 0).join(gone, "id", "left_semi")
    return store.read_store(t.spark, root).unionByName(old).select(
        "id", F.col("processing_status").alias("status"), F.col("structured_data.personalInfo.name.full").alias("full_name"), (F.col("id") % 7 == 0).alias("second"))


@query("j04_overwrite_outcome", """
    select w.id, case when r.id is null then 'not_found' else 'ok' end as outcome
    from wanted_ids_v w left join stored_resumes_v r on r.id = w.id""")
def _(t):
    return records.overwrite_outcome(t.stored_resumes_v(), t.wanted_ids_v())


@query("j05_patch_records", """
    select r.id, case when s_suppkey is not null then s_name when processing_status = 'completed' then full_name end as full_name,
           case when processing_status = 'completed' then industry end as industry, processing_status as status,
           case when s_suppkey is not null then 1 else 0 end as n_roles
    from stored_resumes_v r left join supplier on s_suppkey = r.id""")
def _(t):
    return records.patch_records(t.stored_resumes_v(), _updates(t), NOW).select(
        "id", F.col("structured_data.personalInfo.name.full").alias("full_name"),
        F.col("structured_data.summary.industryFocus").alias("industry"), F.col("processing_status").alias("status"),
        F.greatest(F.coalesce(F.size("structured_data.experience"), F.lit(0)), F.lit(0)).alias("n_roles"),
    )


@query("s30_check_uuid", f"""
    select doc_id, case when doc_id % 2 = 0 then 'ok' else 'invalid_id' end as id_outcome
    from documents where length({uuid_sql("text")}) = 36""")
def _(t):
    from talentloom.operators.intake import record_id

    whole = record_id(F.col("text"))
    shown = F.when(F.col("doc_id") % 2 == 0, whole).otherwise(F.regexp_replace(whole, "-", ""))
    return records.check_uuid(t.documents.select("doc_id", shown.alias("id"))).select("doc_id", "id_outcome")


@query("w1_latest_status", """
    select l.resume_id, l.status, strftime(l.ts, '%Y-%m-%d %H:%M:%S.%f') as ts, n_events
    from latest_v l join (select resume_id, count(*) as n_events from status_events_v group by 1) c on c.resume_id = l.resume_id""")
def _(t):
    return records.latest_status(t.status_events_v()).select(
        "resume_id", "status", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "n_events"
    )


@query("u3_merge_versions", """
    select id, status, cast(version as varchar) as version, origin, editor from (
    select *, row_number() over (partition by id order by version desc, origin desc) as rn from (
    select o_custkey as id, o_orderstatus as status, o_orderkey as version, 'ai' as origin, null as editor from orders
    union all select s_suppkey, 'edited', cast(floor(s_acctbal) as bigint), 'manual', s_name from supplier)) where rn = 1""")
def _(t):
    ai = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("version"))
    manual = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.lit("edited").alias("status"),
        F.floor("s_acctbal").cast("bigint").alias("version"), F.col("s_name").alias("editor"),
    )
    return records.merge_versions(ai, manual).select("id", "status", _text("version"), "origin", "editor")
