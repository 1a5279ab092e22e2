"""Matching of candidates and jobs over the applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom import rules
from talentloom.operators import enrich, match
from talentloom.plans import matching
from talentloom.plans.catalogue.registry import VIEWS, query, uuid_sql

AS_OF = "2001-08-01"

VIEWS["own_skills_v"] = "select distinct resume_id, skill from resume_skills_v"
VIEWS["asked_v"] = """select a.resume_id, a.job_id, j.skill, j.need, s.skill is not null as held
    from applications_v a join job_skills_v j on j.job_id = a.job_id
    left join own_skills_v s on s.resume_id = a.resume_id and s.skill = j.skill"""
VIEWS["hits_v"] = """select resume_id, job_id, count(*) filter (where need = 'required') as required_n, count(*) filter (where need = 'required' and held) as required_hit,
    count(*) filter (where need = 'preferred') as preferred_n, count(*) filter (where need = 'preferred' and held) as preferred_hit from asked_v group by 1, 2"""
VIEWS["scored_v"] = """select *, cast(round((skills_score * 35 + experience_score * 25 + education_score * 15 + role_score * 15 + location_score * 10) / 100) as int) as overall_score
    from (select h.*, title, expectation, salary_min, salary_max,
      cast(round(80 * (case when required_n = 0 then 1 else required_hit / required_n end) + 20 * (case when preferred_n = 0 then 1 else preferred_hit / preferred_n end)) as int) as skills_score,
      cast(round(case when y >= need + 3 then 100 when y >= need then 80 + 20 * (y - need) / 3 else 80 * y / need end) as int) as experience_score,
      cast(case when h.job_id % 5 <= h.resume_id % 5 then 100 else greatest(0, 100 - 30 * (h.job_id % 5 - h.resume_id % 5)) end as int) as education_score,
      case when same and title like '% % %' then 67 when same then 50 else 0 end as role_score, case when same and home then 75 else 0 end as location_score
      from (select h.*, j.region || ' manager' as title, r.expectation, j.salary_min, j.salary_max, r.region = j.region as same, r.country = j.country as home,
              h.job_id % 6 as need, coalesce(round(y.months / 12, 2), 0) as y
            from hits_v h join jobs_v j on j.job_id = h.job_id join resumes_v r on r.resume_id = h.resume_id
            left join years_v y on y.resume_id = h.resume_id) h)"""
LABEL_SQL = """case when overall_score < 40 then 'Poor Match' when overall_score < 55 then 'Weak Match' when overall_score < 70 then 'Moderate Match'
    when overall_score < 80 then 'Good Match' when overall_score < 90 then 'Strong Match' else 'Excellent Match' end"""


def candidates(t):
    """Candidate rows for scoring, one per résumé."""
    skills = t.resume_skills_v().groupBy("resume_id").agg(F.count_distinct("skill").cast("int").alias("held"))
    years = enrich.years_of_experience(t.employment_v(), AS_OF).select("resume_id", "years")
    person = t.resumes_v().join(skills, "resume_id", "left").join(years, "resume_id", "left")
    held = F.coalesce("held", F.lit(0))
    return person.select(
        "resume_id", "years", (F.col("resume_id") % 5).cast("int").alias("education_rank"),
        F.split(F.lower(F.concat_ws(" ", "industry", "region")), " ").alias("title_tokens"), F.lit(None).cast("string").alias("city"),
        F.col("region").alias("state"), "country", "expectation", (F.col("resume_id") % 101).alias("completeness"),
        held.alias("skills_known"), (held + F.col("resume_id") % 3).alias("skills_total"),
        (F.col("resume_id") % 4).alias("dated_roles"), (F.col("resume_id") % 4 + F.col("resume_id") % 2).alias("roles"),
    )


def jobs(t):
    """Job rows for scoring, one per supplier and month."""
    title = F.concat("region", F.lit(" manager"))
    need = (F.col("job_id") % 6).cast("int")
    # the employer comes to the job's key alone, not the lists to the employer
    return t.jobs_v().join(match.job_lists(t.job_skills_v()), "job_id").select(
        "job_id", title.alias("title"), F.concat(F.lit("Supplier "), F.col("job_id").cast("string")).alias("company"),
        "required", "preferred", need.alias("min_years"), (need + 3).alias("pref_years"),
        (F.col("job_id") % 5).cast("int").alias("job_education_rank"), F.split(F.lower(title), " ").alias("job_title_tokens"),
        F.lit(None).cast("string").alias("job_city"), F.col("region").alias("job_state"), F.col("country").alias("job_country"),
        "salary_min", "salary_max",
    )


def asked(t):
    """Asked pairs with the candidate's skills."""
    return match.attach_skills(t.applications_v(), t.resume_skills_v(), t.job_skills_v())


def scored(t):
    return matching.score_plan(asked(t), candidates(t), jobs(t))


def _lists(t):
    """Asked pairs with the skill lists only."""
    return match.attach_skills(t.applications_v().join(match.job_lists(t.job_skills_v()), "job_id"), t.resume_skills_v(), t.job_skills_v())


@query("j06_match_skills", """
    select resume_id, job_id, cast(required_n as int) as required_n, cast(required_hit as int) as required_hit,
           cast(preferred_n as int) as preferred_n, cast(preferred_hit as int) as preferred_hit from hits_v""")
def _(t):
    return match.match_skills(t.resume_skills_v(), t.job_skills_v(), t.applications_v())


@query("s24_category_scores", """
    select resume_id, job_id, skills_score, experience_score, education_score, role_score, location_score from scored_v""")
def _(t):
    return scored(t).select("resume_id", "job_id", *[f"{c}_score" for c in match.CATEGORIES])


@query("a12_overall_score", f"select resume_id, job_id, overall_score, {LABEL_SQL} as recommendation from scored_v")
def _(t):
    return scored(t).select("resume_id", "job_id", "overall_score", "recommendation")


@query("a12_job_summary", """
    select job_id, count(*) as candidates, max(overall_score) as best, avg(overall_score) as mean, count(*) filter (where overall_score >= 70) as good
    from scored_v group by job_id""")
def _(t):
    return match.job_summary(scored(t))


TOP_JOBS_SQL = """select resume_id, job_id, overall_score, cast(rank as int) as rank from (select *, row_number() over (
    partition by resume_id order by overall_score desc, job_id) as rank from scored_v) where rank <= 5"""


def top_jobs(t):
    return match.top_matches(scored(t), "resume_id", 5).select("resume_id", "job_id", "overall_score", "rank")


@query("w4_top_jobs_per_resume", TOP_JOBS_SQL)
def _(t):
    return top_jobs(t)


@query("w4_top_resumes_per_job", """
    select job_id, resume_id, overall_score, cast(rank as int) as rank from (select *, row_number() over (
    partition by job_id order by overall_score desc, resume_id) as rank from scored_v) where rank <= 10""")
def _(t):
    return match.top_matches(scored(t), "job_id", 10).select("job_id", "resume_id", "overall_score", "rank")


@query("u1_gap_analysis", """
    select resume_id, job_id, coalesce(string_agg(skill, ', ' order by skill) filter (where need = 'required' and not held), '') as critical,
           case when count(*) filter (where need = 'required' and not held) = 0 then 'none'
                when count(*) filter (where need = 'required' and not held) * 2 > count(*) filter (where need = 'required') then 'critical' else 'high' end as impact,
           coalesce(string_agg(skill, ', ' order by skill) filter (where need = 'preferred' and not held), '') as improvement
    from asked_v group by 1, 2""")
def _(t):
    out = match.gap_analysis(_lists(t))

    def names(column):
        return F.array_join(F.array_sort(F.transform(column, lambda g: g["missing"])), ", ")

    impact = F.coalesce(F.get("critical_gaps", F.lit(0))["impact"], F.lit("none"))
    return out.select(
        "resume_id", "job_id", names("critical_gaps").alias("critical"), impact.alias("impact"), names("improvement_areas").alias("improvement")
    )


@query("u2_strength_areas", """
    select resume_id, job_id, coalesce(string_agg(skill, ', ' order by skill) filter (where need = 'required' and held), '') as strengths,
           coalesce(string_agg(skill, ', ' order by skill) filter (where need = 'preferred' and held), '') as advantages
    from asked_v group by 1, 2""")
def _(t):
    out = match.strength_areas(_lists(t))
    return out.select(
        "resume_id", "job_id", F.array_join(F.array_sort("strengths"), ", ").alias("strengths"),
        F.array_join(F.array_sort("advantages"), ", ").alias("advantages"),
    )


@query("s23_salary_alignment", """
    select resume_id, job_id, case when expectation < salary_min then 'below_range' when expectation > salary_max then 'above_range' else 'within_range' end as alignment
    from scored_v""")
def _(t):
    pairs = t.applications_v().join(t.resumes_v().select("resume_id", "expectation"), "resume_id").join(
        t.jobs_v().select("job_id", "salary_min", "salary_max"), "job_id"
    )
    return match.salary_alignment(pairs).select("resume_id", "job_id", "alignment")


VIEWS["held_v"] = """select r.resume_id, coalesce(n, 0) as n from resumes_v r left join (select resume_id, count(*) as n
    from own_skills_v where skill in (select skill from job_skills_v) group by 1) h on h.resume_id = r.resume_id"""


@query("s25_confidence", """
    select resume_id, completeness, extraction, accuracy, round((completeness + extraction + accuracy) / 3, 2) as confidence from (
    select resume_id, round((resume_id % 101) / 100, 2) as completeness,
           round(case when n + resume_id % 3 = 0 then 1 else n / (n + resume_id % 3) end, 2) as extraction,
           round(case when resume_id % 4 + resume_id % 2 = 0 then 1 else (resume_id % 4) / (resume_id % 4 + resume_id % 2) end, 2) as accuracy
    from held_v)""")
def _(t):
    f = F.col("confidence_factors")
    return match.confidence(candidates(t)).select(
        "resume_id", f["dataCompleteness"].alias("completeness"), f["skillExtraction"].alias("extraction"),
        f["experienceAccuracy"].alias("accuracy"), "confidence",
    )


@query("s26_explain", f"""
    select resume_id, job_id, {LABEL_SQL} || ': overall score ' || overall_score || ' for ' || title as summary,
           'skills ' || skills_score || ' (weight 35)' as first_factor, required_n - required_hit as n_advice from scored_v""")
def _(t):
    out = match.explain(match.gap_analysis(scored(t)))
    return out.select(
        "resume_id", "job_id", "summary", F.get("key_factors", F.lit(0)).alias("first_factor"), F.size("advice").cast("bigint").alias("n_advice")
    )


@query("match_records", f"""
    select {uuid_sql("resume_id || '|' || job_id")} as id, resume_id, job_id, cast(resume_id as varchar) as echoed, overall_score,
           {LABEL_SQL} as recommendation, required_n - required_hit as n_gaps, required_hit as n_strengths from scored_v""")
def _(t):
    out = matching.match_plan(asked(t), candidates(t), jobs(t), AS_OF)
    m = F.col("result.matchingResults")
    return out.select(
        "id", "resume_id", "job_id", F.col("result.resumeId").alias("echoed"), m["overallScore"].alias("overall_score"),
        m["recommendation"].alias("recommendation"), F.size(m["gapAnalysis"]["criticalGaps"]).cast("bigint").alias("n_gaps"),
        F.size(m["strengthAreas"]).cast("bigint").alias("n_strengths"),
    )


@query("s27_check_job", """
    select s_suppkey as job_id, case s_suppkey % 4 when 0 then '' when 1 then 'title' when 2 then 'requirements.required'
           else 'requirements.required,skills.required' end as missing from supplier""")
def _(t):
    k = F.col("s_suppkey") % 4
    given = F.array(F.col("s_name"))
    rows = t.supplier.select(
        F.col("s_suppkey").alias("job_id"), F.when(k != 1, F.col("s_name")).otherwise(F.lit(" ")).alias("title"),
        F.struct(F.when(k <= 1, given).alias("required"), given.alias("preferred")).alias("requirements"),
        F.struct(F.when(k <= 2, given).otherwise(F.array().cast("array<string>")).alias("required"), given.alias("preferred")).alias("skills"),
    )
    return match.check_job(rows).select("job_id", F.array_join("missing_fields", ",").alias("missing"))


_MARKET = "select title as level, industry, country, salary from experience_v e join resumes_v r on r.resume_id = e.resume_id"


@query("j07_estimate_salary", f"""
    with market as ({_MARKET}),
    person as (select r.resume_id, c.title as level, industry, country from resumes_v r join current_role_v c on c.resume_id = r.resume_id),
    s0 as (select level, industry, country, count(*) as n, quantile_cont(salary, 0.25) as a, quantile_cont(salary, 0.75) as b from market group by 1, 2, 3 having count(*) >= 25),
    s1 as (select level, industry, count(*) as n, quantile_cont(salary, 0.25) as a, quantile_cont(salary, 0.75) as b from market group by 1, 2 having count(*) >= 25),
    s2 as (select level, count(*) as n, quantile_cont(salary, 0.25) as a, quantile_cont(salary, 0.75) as b from market group by 1 having count(*) >= 25)
    select p.resume_id, cast(round(coalesce(s0.a, s1.a, s2.a)) as int) as "min", cast(round(coalesce(s0.b, s1.b, s2.b)) as int) as "max", 'USD' as currency,
           case when s0.n is not null then 0 when s1.n is not null then 1 else 2 end as fallback_level, coalesce(s0.n, s1.n, s2.n) as comparables
    from person p left join s0 on s0.level = p.level and s0.industry = p.industry and s0.country = p.country
    left join s1 on s1.level = p.level and s1.industry = p.industry left join s2 on s2.level = p.level""")
def _(t):
    people = t.resumes_v().join(enrich.current_role(t.experience_v()), "resume_id").withColumnRenamed("title", "level")
    market = t.experience_v().join(t.resumes_v(), "resume_id").withColumnRenamed("title", "level")
    out = enrich.estimate_salary(people, market, min_rows=25)
    return out.select("resume_id", "min", "max", "currency", "fallback_level", "comparables")


VIEWS["held_roles_v"] = "select distinct resume_id, title from experience_v"
VIEWS["common_v"] = """select title, skill, n, row_number() over (partition by title order by n desc, skill) as rk from (
    select h.title, s.skill, count(*) as n from held_roles_v h join own_skills_v s on s.resume_id = h.resume_id group by 1, 2)"""


@query("j09_missing_skills", f"""
    select resume_id, title, string_agg(skill, ', ' order by rk) as areas from (
    select w.resume_id, w.title, c.skill, c.rk, row_number() over (partition by w.resume_id order by c.rk) as pos
    from current_role_v w join common_v c on c.title = w.title
    where not exists (select 1 from own_skills_v s where s.resume_id = w.resume_id and s.skill = c.skill)) where pos <= {rules.IMPROVEMENT_AREAS}
    group by 1, 2""")
def _(t):
    roles = t.experience_v().select("resume_id", "title").distinct()
    out = enrich.missing_skills(t.resume_skills_v(), roles, enrich.current_role(t.experience_v()))
    return out.filter(F.size("areas") > 0).withColumn("areas", F.array_join("areas", ", "))


@query("t5_suggest_career", f"""
    with usual as (select *, row_number() over (partition by title order by n desc, next_title) as rank from (
        select title, next_title, count(*) as n from next_role_v where next_title <> title group by 1, 2)),
    current_roles as (select * from current_role_v),
    counts as (select c.title, s.skill, count(*) as n from current_roles c join own_skills_v s on s.resume_id = c.resume_id group by 1, 2),
    common as (select title, skill, n, row_number() over (partition by title order by n desc, skill) as rk from counts),
    lacking as (select resume_id, string_agg(skill, ', ' order by rk) as areas from (
        select w.resume_id, c.skill, c.rk, row_number() over (partition by w.resume_id order by c.rk) as pos
        from current_roles w join usual u on u.title = w.title and u.rank = 1 join common c on c.title = u.next_title
        where not exists (select 1 from own_skills_v s where s.resume_id = w.resume_id and s.skill = c.skill)) where pos <= 3 group by 1)
    select c.resume_id, c.title, r.next_roles, coalesce(l.areas, '') as improvement_areas from current_roles c
    join (select title, string_agg(next_title, ', ' order by rank) as next_roles from usual where rank <= 5 group by 1) r on r.title = c.title
    left join lacking l on l.resume_id = c.resume_id""")
def _(t):
    out = enrich.suggest_career(t.experience_v(), t.resume_skills_v())
    return out.select(
        "resume_id", "title", F.array_join("next_roles", ", ").alias("next_roles"), F.array_join("improvement_areas", ", ").alias("improvement_areas")
    )
