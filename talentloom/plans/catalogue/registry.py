"""Registry of checked queries: a Spark plan over the given tables, and its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from talentloom.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LINES = ("lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey")
_SKILL = "lower(p_type || ' ' || p_name)"
_JOB = "l_suppkey * 1000 + (year(cast(l_shipdate as date)) - 1990) * 12 + month(cast(l_shipdate as date))"

VIEWS = {
    "resumes_v": """select c_custkey as resume_id, c_name as full_name, c_mktsegment as industry, n_name as country,
        r_name as region, c_acctbal as expectation from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "experience_v": """select o_custkey as resume_id, o_orderkey as exp_id, o_orderpriority as title,
        cast(o_orderdate as date) as start_date, o_orderstatus = 'O' as is_current, o_totalprice as salary from orders""",
    "employment_v": """select o_custkey as resume_id, o_orderkey as exp_id, cast(o_orderdate as date) as start_date,
        cast(o_orderdate as date) + cast(o_orderkey % 400 as int) as end_date from orders""",
    "resume_skills_v": f"select distinct o_custkey as resume_id, p_type as category, {_SKILL} as skill from {_LINES}",
    "skill_dates_v": f"select distinct o_custkey as resume_id, cast(o_orderdate as date) as seen_on, {_SKILL} as skill from {_LINES}",
    "jobs_v": f"""select job_id, s_name as title, n_name as country, r_name as region, s_acctbal as salary_min,
        s_acctbal + 5000 as salary_max from (select distinct l_suppkey, {_JOB} as job_id from lineitem) join supplier on l_suppkey = s_suppkey
        join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "job_skills_v": f"""select {_JOB} as job_id, {_SKILL} as skill, case when max(l_quantity) > 25 then 'required' else 'preferred' end as need
        from lineitem join part on p_partkey = l_partkey group by 1, 2""",
    "applications_v": f"select distinct o_custkey as resume_id, {_JOB} as job_id from lineitem join orders on l_orderkey = o_orderkey",
    "status_events_v": """select event_id, user_id as resume_id, ts, case event_type when 'signup' then 'processing'
        when 'view' then 'ai_processing' when 'click' then 'ai_processing' when 'purchase' then 'completed'
        else 'ai_failed' end as status from events""",
    "batch_events_v": "select *, event_id // 50 as batch from status_events_v",
    "batch_latest_v": """select batch, resume_id, status, ts from (select *, row_number() over (
        partition by batch, resume_id order by ts desc, event_id desc) as rn from batch_events_v) where rn = 1""",
    "latest_v": """select resume_id, status, ts from (select *, row_number() over (
        partition by resume_id order by ts desc, event_id desc) as rn from status_events_v) where rn = 1""",
    "doc_pages_v": "select conv_id as doc_id, turn as page_no, text as page_text from conversations",
    "stored_resumes_v": """select r.resume_id as id, full_name, full_name || '.pdf' as file_name, industry, country, region,
        cast(round(abs(expectation) * 100) as bigint) as file_size, l.status as processing_status, l.ts as processed_at,
        cast(case when l.status = 'completed' then cast(floor(abs(expectation) / 100) as int) end as varchar) as completeness
        from resumes_v r left join latest_v l on l.resume_id = r.resume_id""",
    "wanted_ids_v": "select o_orderkey as id from orders",
    "stored_matches_v": """select resume_id || '-' || job_id as id, resume_id, job_id,
        case job_id % 3 when 0 then 'pending' when 1 then 'completed' else 'failed' end as status,
        case when job_id % 2 = 1 and job_id % 3 <> 0 then '{"overallScore": ' || resume_id || '}' end as match_result
        from applications_v""",
    "texts_v": """select o_orderkey as id, full_name, o_orderpriority as title, year(o_orderdate) as yr, o_orderstatus as mark,
        cast(floor(o_totalprice) as bigint) as amount, industry, region, country
        from orders join resumes_v on resume_id = o_custkey""",
    "layouts_v": """select id, id % 4 as form, full_name, yr, amount, industry, region, country, region || ', ' || country as place,
        list_extract(['Senior Accountant', 'Data Engineer', 'Ward Nurse', 'Project Manager'], cast((id // 4) % 4 + 1 as int)) as title1,
        list_extract(['Bookkeeper', 'Software Developer', 'Shift Supervisor', 'Research Assistant'], cast((id // 4) % 4 + 1 as int)) as title2,
        substr(industry, 1, 1) || lower(substr(industry, 2)) || ' Group' as firm1,
        'Quay ' || substr(industry, 1, 1) || lower(substr(industry, 2)) || ' Ltd' as firm2,
        case mark when 'O' then 'Present' else cast(yr + 2 as varchar) end as until from texts_v""",
    "islands_v": """select resume_id, min(start_date) as start_date, max(end_date) as end_date, count(*) as n_roles,
        max(until) filter (where fresh = 1) as until from (
        select *, sum(fresh) over (partition by resume_id order by start_date, exp_id) as island from (
        select *, case when until is null or start_date > until then 1 else 0 end as fresh from (
        select *, max(end_date) over (partition by resume_id order by start_date, exp_id
        rows between unbounded preceding and 1 preceding) as until from employment_v))) group by resume_id, island""",
    "years_v": """select resume_id, cast(sum((year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date)) as bigint) as months
        from islands_v group by resume_id""",
    "current_role_v": """select resume_id, title from (select *, row_number() over (partition by resume_id
        order by start_date desc, exp_id desc) as rn from experience_v) where rn = 1""",
    "next_role_v": "select *, lead(title) over (partition by resume_id order by start_date, exp_id) as next_title from experience_v",
    "steps_v": """select *, lead(ts) over w as next_ts, lead(status) over w as next_status from status_events_v
        window w as (partition by resume_id order by ts, event_id)""",
}


def with_views(body: str) -> str:
    """Prepend the definitions of all views a query mentions, in order of need."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    defs = ", ".join(f"{n} as ({VIEWS[n]})" for n in needed)
    body = body.strip()
    if not defs:
        return body
    if body.lower().startswith("with "):
        return f"with {defs}, {body[5:]}"
    return f"with {defs} {body}"


def query(name: str, sql: str | None = None):
    """Register a plan ``fn(tables)`` under a name, with its SQL twin when there is one."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def uuid_sql(text: str) -> str:
    """SQL of ``record_id`` over a text expression."""
    h = f"sha256({text})"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
