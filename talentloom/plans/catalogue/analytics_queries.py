"""Market analytics, aggregates, windows, search and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions.dates import timeframe_bounds
from talentloom.functions.values import career_level
from talentloom.operators import enrich, market, progress, records, search
from talentloom.plans.catalogue.registry import query
from talentloom.sources import store

AS_OF = "2001-08-01"
BEFORE, AFTER, _ = timeframe_bounds("1y", AS_OF)
_NOW = f"seen_on > date '{AFTER}' and seen_on <= date '{AS_OF}'"
_PAST = f"seen_on > date '{BEFORE}' and seen_on <= date '{AFTER}'"
_HOLDERS = f"""select skill, count(distinct resume_id) filter (where {_NOW}) as current,
    count(distinct resume_id) filter (where {_PAST}) as previous from skill_dates_v
    where seen_on > date '{BEFORE}' and seen_on <= date '{AS_OF}' group by skill"""
_TREND = f"""select *, case when previous > 0 then round((current - previous) / previous, 4) end as growth_rate,
    case when previous = 0 and current > 0 then 'growing' when round((current - previous) / previous, 4) >= 0.1 then 'growing'
         when round((current - previous) / previous, 4) <= -0.1 then 'declining' else 'stable' end as trend from ({_HOLDERS})"""


def _text(name):
    return F.col(name).cast("string").alias(name)


def _day(name):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


@query("a01_market_total", f"""
    select count(distinct s.resume_id) as total_resumes from skill_dates_v s join resumes_v r on r.resume_id = s.resume_id
    where {_NOW} and industry = 'BUILDING' and country = 'NATION_3'""")
def _(t):
    dated = t.skill_dates_v().join(t.resumes_v(), "resume_id")
    return market.market_total(dated, "1y", AS_OF, industry="building", location="nation_3")


@query("a02_top_skills", f"""
    select skill, count(distinct resume_id) as n from skill_dates_v where {_NOW} group by 1 order by n desc, skill limit 20""")
def _(t):
    return market.top_skills(t.skill_dates_v(), "1y", AS_OF, 20)


@query("a02_top_skills_sketch", f"select skill, true as near from skill_dates_v where {_NOW} group by 1")
def _(t):
    """Sketched counts of all skills lie within a fifth of the exact ones, or one off."""
    exact = market.skill_counts(t.skill_dates_v(), "1y", AS_OF).withColumnRenamed("n", "_exact")
    sketch = market.skill_counts(t.skill_dates_v(), "1y", AS_OF, exact=False)
    return sketch.join(exact, "skill").select("skill", (F.abs(F.col("n") - F.col("_exact")) <= F.greatest(F.col("_exact") / 5, F.lit(1))).alias("near"))


def _stored_sketches(t):
    """The sketches of all days, written once and read again."""
    path = store.scratch_folder(t.spark, "sketches")
    market.skill_sketches(t.skill_dates_v()).write.parquet(path)
    return t.spark.read.parquet(path)


@query("a02_top_skills_stored_sketches", f"""
    select skill, count(distinct resume_id) as n from skill_dates_v where {_NOW} group by 1 order by n desc, skill limit 20""")
def _(t):
    """Counts of some tens of résumés are exact in a sketch; larger ones are held against exact counts in tests."""
    return market.sketched_top_skills(_stored_sketches(t), "1y", AS_OF, 20)


@query("a02_skill_report", f"""
    select cast(row_number() over (order by current desc, skill) as int) as rank, skill, current as count, trend, coalesce(growth_rate, -99) as growth_rate
    from ({_TREND}) where current > 0 order by current desc, skill limit 25""")
def _(t):
    return market.skill_report(market.skill_trend(t.skill_dates_v(), "1y", AS_OF), 25).withColumn("growth_rate", F.coalesce("growth_rate", F.lit(-99.0)))


def _salary_label(rate):
    return f"case when {rate} >= 5 then 'increasing' when {rate} <= -5 then 'decreasing' else 'stable' end"


_EXP_WINDOWS = f"""select title, salary, start_date > date '{AFTER}' as recent from experience_v
    where start_date > date '{BEFORE}' and start_date <= date '{AS_OF}'"""


@query("a03_salary_trends", f"""
    select title, round(current, 4) as current, round(previous, 4) as previous, round(rate, 2) as change_percent,
           {_salary_label('round(rate, 2)')} as trend
    from (select *, (current - previous) * 100 / previous as rate from (
          select title, median(salary) filter (where recent) as current, median(salary) filter (where not recent) as previous
          from ({_EXP_WINDOWS}) group by title))""")
def _(t):
    return market.salary_trends(t.experience_v(), "1y", AS_OF).select(
        "title", F.round("current", 4).alias("current"), F.round("previous", 4).alias("previous"), "change_percent", "trend"
    )


@query("j10_salary_change", f"""
    select title, round(current, 4) as current, round(previous, 4) as previous, round((current - previous) * 100 / previous, 2) as change_percent,
           {_salary_label('round((current - previous) * 100 / previous, 2)')} as trend
    from (select title, round(sum(cast(round(salary * 100) as bigint)) filter (where recent) / count(*) filter (where recent) / 100, 4) as current,
                 round(sum(cast(round(salary * 100) as bigint)) filter (where not recent) / count(*) filter (where not recent) / 100, 4) as previous
          from ({_EXP_WINDOWS}) group by title)""")
def _(t):
    return market.salary_change(t.experience_v(), "1y", AS_OF)


@query("a04_industry_distribution", """
    select industry, n, round(n * 100 / sum(n) over (), 1) as percent from (select industry, count(*) as n from resumes_v group by 1)""")
def _(t):
    return market.industry_distribution(t.resumes_v())


@query("a05_facets", """
    select 'industry' as field, industry as value, count(*) as n from resumes_v group by industry
    union all select 'country', country, count(*) from resumes_v group by country
    union all select 'region', region, count(*) from resumes_v group by region""")
def _(t):
    return search.facets(t.resumes_v(), ["industry", "country", "region"])


_FAILED = "status in ('parse_failed', 'ai_failed', 'save_failed', 'queue_failed', 'failed')"
PROGRESS_SQL = f"""
    select batch, total, completed, failed, total - completed - failed as processing,
           cast(floor((completed + failed) * 100 / total) as int) as progress,
           case when total > completed + failed then 'processing' when completed = 0 then 'failed' else 'completed' end as status
    from (select batch, count(*) as total, count(*) filter (where status = 'completed') as completed, count(*) filter (where {_FAILED}) as failed
          from batch_latest_v group by batch)"""


@query("a06_bulk_progress", PROGRESS_SQL)
def _(t):
    return progress.bulk_progress(t.batch_events_v())


@query("a06_bulk_files", """
    select batch, resume_id, status, case status when 'processing' then 10 when 'ai_processing' then 50 else 100 end as progress,
           case when status = 'ai_failed' then status end as error from batch_latest_v""")
def _(t):
    return progress.file_status(t.batch_events_v()).drop("since")


_SEEN_UNTIL = "2024-02-01 00:00:00"
_KEPT = "('completed', 'parse_failed', 'ai_failed', 'save_failed', 'queue_failed', 'failed')"
_WAITING = f"""select event_id, resume_id, status, cast(floor(case when next_ts is not null then round((epoch_us(next_ts) - epoch_us(ts)) / 1000000.0, 3)
    else (epoch_us(timestamp '{_SEEN_UNTIL}') - epoch_us(ts)) / 1000000.0 end) as bigint) as seconds, next_ts is not null as finished
    from steps_v where next_ts is not null or status not in {_KEPT}"""
_SURVIVAL = f"""select status, seconds, ended, at_risk, round(exp(sum(case when ended < at_risk then ln(1 - ended / at_risk) else -50 end) over (partition by status order by seconds)), 6) as survival
    from (select status, seconds, ended, sum(n) over (partition by status order by seconds rows between current row and unbounded following) as at_risk
    from (select status, seconds, count(*) filter (where finished) as ended, count(*) as n from waiting group by 1, 2))"""


@query("a06_step_survival", f"with waiting as ({_WAITING}) select status, seconds, ended, cast(at_risk as bigint) as at_risk, survival from ({_SURVIVAL})")
def _(t):
    return progress.step_survival(progress.waiting_steps(t.status_events_v(), _SEEN_UNTIL))


@query("a06_time_remaining", f"""
    with waiting as ({_WAITING}), curve as ({_SURVIVAL})
    select w.resume_id, w.status, w.seconds as spent, min(l.seconds) - w.seconds as remaining
    from waiting w join curve c on c.status = w.status and c.seconds = w.seconds
    left join curve l on l.status = w.status and ceil(l.survival * 1000) <= floor(c.survival * 500)
    where not finished group by w.event_id, w.resume_id, w.status, w.seconds""")
def _(t):
    steps = progress.waiting_steps(t.status_events_v(), _SEEN_UNTIL)
    return progress.time_remaining(steps, progress.step_survival(steps))


@query("a07_status_counts", "select status, count(*) as n from latest_v group by status")
def _(t):
    return progress.status_counts(records.latest_status(t.status_events_v()))


@query("a07_status_rollup", """
    select coalesce(strftime(day, '%Y-%m-%d'), 'all') as day, coalesce(status, 'all') as status, n from (
    select cast(ts as date) as day, status, count(*) as n from latest_v group by rollup (1, 2))""")
def _(t):
    rolled = progress.status_counts(records.latest_status(t.status_events_v()), by_day=True)
    return rolled.select(
        F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("all")).alias("day"),
        F.coalesce("status", F.lit("all")).alias("status"), "n",
    )


@query("a08_skill_groups", """
    select resume_id, category, string_agg(skill, ', ' order by skill) as items from resume_skills_v group by 1, 2""")
def _(t):
    return enrich.skill_groups(t.resume_skills_v()).withColumn("items", F.array_join("items", ", "))


@query("a08_skill_groups_nested", """
    select resume_id, string_agg(category || ': ' || items, '; ' order by category) as technical from (
    select resume_id, category, string_agg(skill, ', ' order by skill) as items from resume_skills_v group by 1, 2) group by 1""")
def _(t):
    nested = enrich.skill_groups(t.resume_skills_v(), nested=True)
    line = F.transform("technical", lambda g: F.concat(g["category"], F.lit(": "), F.array_join(g["items"], ", ")))
    return nested.select("resume_id", F.array_join(line, "; ").alias("technical"))


@query("a09_years_of_experience", "select resume_id, months, round(months / 12, 2) as years from years_v")
def _(t):
    return enrich.years_of_experience(t.employment_v(), AS_OF)


@query("a10_salary_comparables", """
    select title, industry, count(*) as n_rows, round(quantile_cont(salary, 0.25), 4) as p25, round(quantile_cont(salary, 0.75), 4) as p75
    from experience_v e join resumes_v r on r.resume_id = e.resume_id group by 1, 2""")
def _(t):
    rows = t.experience_v().join(t.resumes_v(), "resume_id")
    out = enrich.salary_comparables(rows, ["title", "industry"])
    return out.select("title", "industry", "n_rows", F.round("p25", 4).alias("p25"), F.round("p75", 4).alias("p75"))


@query("a11_role_transitions", "select title, next_title, count(*) as n from next_role_v where next_title is not null group by 1, 2")
def _(t):
    return enrich.role_transitions(t.experience_v())


_DURATIONS = """select event_id, resume_id, status, next_status,
    round((epoch_us(next_ts) - epoch_us(ts)) / 1000000.0, 3) as seconds from steps_v"""


@query("a14_step_times", f"""
    select status, count(*) as n, round(sum(cast(round(seconds * 1000) as bigint)) / count(*) / 1000, 3) as mean,
           round(quantile_cont(cast(round(seconds * 1000) as bigint), 0.5) / 1000, 3) as median,
           round(quantile_cont(cast(round(seconds * 1000) as bigint), 0.95) / 1000, 3) as p95
    from ({_DURATIONS}) where seconds is not null group by status""")
def _(t):
    return progress.step_times(progress.step_durations(t.status_events_v()))


@query("w2_skill_trend", f"select skill, current, previous, cast(coalesce(growth_rate, -99) as double) as growth_rate, trend from ({_TREND})")
def _(t):
    return market.skill_trend(t.skill_dates_v(), "1y", AS_OF).withColumn("growth_rate", F.coalesce("growth_rate", F.lit(-99.0)))


@query("w2_skill_trend_sketches", f"select skill, current, previous, cast(coalesce(growth_rate, -99) as double) as growth_rate, trend from ({_TREND})")
def _(t):
    return market.sketched_skill_trend(_stored_sketches(t), "1y", AS_OF).withColumn("growth_rate", F.coalesce("growth_rate", F.lit(-99.0)))


_SERIES = "select skill, date_trunc('month', seen_on) as period, count(distinct resume_id) as n from skill_dates_v group by 1, 2"


@query("w2_series_growth", f"""
    select skill, strftime(period, '%Y-%m-%d') as period, n, cast(previous as varchar) as previous,
           coalesce(round((n - previous) / previous, 4), -99) as growth_rate
    from (select *, lag(n) over (partition by skill order by period) as previous from ({_SERIES}))""")
def _(t):
    grown = market.series_growth(market.skill_series(t.skill_dates_v()))
    return grown.select("skill", _day("period"), "n", _text("previous"), F.coalesce("growth_rate", F.lit(-99.0)).alias("growth_rate"))


@query("w3_next_role", "select resume_id, exp_id, title, next_title from next_role_v")
def _(t):
    return enrich.next_role(t.experience_v()).select("resume_id", "exp_id", "title", "next_title")


@query("w5_step_durations", f"select event_id, resume_id, status, next_status, coalesce(seconds, -1) as seconds from ({_DURATIONS})")
def _(t):
    return progress.step_durations(t.status_events_v()).select(
        "event_id", "resume_id", "status", "next_status", F.coalesce("seconds", F.lit(-1.0)).alias("seconds")
    )


@query("w5_total_times", """
    select resume_id, count(*) as n_events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0, 3) as seconds
    from status_events_v group by 1""")
def _(t):
    return progress.total_times(t.status_events_v())


@query("w6_merge_employment", """
    select resume_id, strftime(start_date, '%Y-%m-%d') as start_date, strftime(end_date, '%Y-%m-%d') as end_date, n_roles,
           cast(date_diff('day', until, start_date) as varchar) as gap_days from islands_v""")
def _(t):
    merged = enrich.merge_employment(t.employment_v(), AS_OF)
    return merged.select("resume_id", _day("start_date"), _day("end_date"), "n_roles", _text("gap_days"))


@query("w6_employment_gaps", """
    select resume_id, strftime(until, '%Y-%m-%d') as gap_start, strftime(start_date, '%Y-%m-%d') as gap_end,
           cast(date_diff('day', until, start_date) as int) as gap_days
    from islands_v where date_diff('day', until, start_date) >= 30""")
def _(t):
    gaps = enrich.employment_gaps(t.employment_v(), AS_OF, 30)
    return gaps.select("resume_id", _day("gap_start"), _day("gap_end"), "gap_days")


@query("w7_score_rank", """
    select resume_id, industry, round(percent_rank() over (partition by industry order by expectation), 4) as pct_rank from resumes_v""")
def _(t):
    return market.score_rank(t.resumes_v(), "industry", "expectation").select("resume_id", "industry", "pct_rank")


@query("w8_smooth_counts", f"""
    select skill, strftime(period, '%Y-%m-%d') as period, n,
           round(avg(n) over (partition by skill order by period rows between 2 preceding and current row), 4) as smoothed
    from ({_SERIES})""")
def _(t):
    return market.smooth_counts(market.skill_series(t.skill_dates_v())).select("skill", _day("period"), "n", "smoothed")


@query("t4_top_n", "select skill, count(*) as n from resume_skills_v group by 1 order by n desc, skill limit 25")
def _(t):
    return market.top_n(t.resume_skills_v().groupBy("skill").agg(F.count("*").alias("n")), "skill", 25)


@query("u4_emerging_skills", f"""
    with trend as ({_TREND}), known as (select skill from trend where previous > 0 order by previous desc, skill limit 10)
    select skill, current, previous from trend where current > 0 and trend = 'growing' and skill not in (select skill from known)""")
def _(t):
    return market.emerging_skills(t.skill_dates_v(), "1y", AS_OF)


@query("s28_timeframe_bounds", f"""
    select '30d' as timeframe, count(*) as n from experience_v where start_date > date '{AS_OF}' - 30 and start_date <= date '{AS_OF}'
    union all select '90d', count(*) from experience_v where start_date > date '{AS_OF}' - 90 and start_date <= date '{AS_OF}'
    union all select '1y', count(*) from experience_v where start_date > date '{AS_OF}' - 365 and start_date <= date '{AS_OF}'
    union all select 'all', count(*) from experience_v where start_date <= date '{AS_OF}'""")
def _(t):
    from talentloom.functions.dates import in_window

    flags = []
    for name in ("30d", "90d", "1y", "all"):
        _, after, until = timeframe_bounds(name, AS_OF)
        flags.append(F.struct(F.lit(name).alias("timeframe"), in_window(F.col("start_date"), after, until).alias("hit")))
    rows = t.experience_v().select(F.explode(F.array(*flags)).alias("f"))
    return rows.groupBy(F.col("f.timeframe").alias("timeframe")).agg(F.count_if("f.hit").alias("n"))


# ---- search ------------------------------------------------------------------
_LEVEL_NAMES = ("none", "associate", "bachelor", "master", "doctor")
_PROFILES = """select r.resume_id, full_name, industry as education_field, region as state, country, expectation as salary,
    c.title as job_title, coalesce(round(y.months / 12, 2), 0) as years,
    case r.resume_id % 5 when 0 then 'none' when 1 then 'associate' when 2 then 'bachelor' when 3 then 'master' else 'doctor' end as education_level,
    case when coalesce(round(y.months / 12, 2), 0) >= 8 then 'senior' when coalesce(round(y.months / 12, 2), 0) < 1 then 'entry'
         when coalesce(round(y.months / 12, 2), 0) < 3 then 'junior' else 'mid-level' end as career_level,
    coalesce(has, false) as has_skill
    from resumes_v r left join current_role_v c on c.resume_id = r.resume_id left join years_v y on y.resume_id = r.resume_id
    left join (select resume_id, bool_or(skill = 'economy small ring') as has from resume_skills_v group by 1) k on k.resume_id = r.resume_id"""


def profiles(t):
    """Search profiles: one row per résumé."""
    years = enrich.years_of_experience(t.employment_v(), AS_OF).select("resume_id", "years")
    skills = t.resume_skills_v().groupBy("resume_id").agg(F.collect_set("skill").alias("skills"))
    title = enrich.current_role(t.experience_v()).withColumnRenamed("title", "job_title")
    level = F.element_at(F.array(*[F.lit(n) for n in _LEVEL_NAMES]), (F.col("resume_id") % 5 + 1).cast("int"))
    joined = t.resumes_v().join(title, "resume_id", "left").join(years, "resume_id", "left").join(skills, "resume_id", "left")
    years_col = F.coalesce("years", F.lit(0.0))
    return joined.select(
        "resume_id", "full_name", F.col("industry").alias("education_field"), F.col("region").alias("state"), "country",
        F.col("expectation").alias("salary"), "job_title", years_col.alias("years"), level.alias("education_level"),
        career_level(F.col("job_title"), years_col).alias("career_level"), "skills",
    )


_CRITERIA = dict(years_min=2, education_level=["Master", "Doctor"], state="europe", salary_min=0)
_CRITERIA_SQL = ("years >= 2", "education_level in ('master', 'doctor')", "lower(state) = 'europe'", "salary >= 0")


@query("p13_search", f"""
    select resume_id, full_name, years, career_level from ({_PROFILES})
    where has_skill and years >= 1 and years <= 30 and education_level in ('bachelor', 'master', 'doctor')
      and lower(education_field) like '%build%' and career_level in ('senior', 'mid-level', 'junior') and salary <= 9000""")
def _(t):
    found = search.search(
        profiles(t), skills=["Economy small ring"], years_min=1, years_max=30, education_level=["bachelor", "master", "doctor"],
        education_field="build", salary_max=9000,
    )
    return found.filter(F.col("career_level") != "entry").select("resume_id", "full_name", "years", "career_level")


_RELEVANCE = " + ".join(f"cast(coalesce({c}, false) as int)" for c in _CRITERIA_SQL)
_MATCHED = " || ".join(f"case when coalesce({c}, false) then '{n} ' else '' end" for n, c in zip(_CRITERIA, _CRITERIA_SQL))


@query("t3_relevance", f"select resume_id, round(({_RELEVANCE}) / 4, 4) as relevance, trim({_MATCHED}) as matched from ({_PROFILES})")
def _(t):
    out = search.relevance(profiles(t), **_CRITERIA)
    return out.select("resume_id", "relevance", F.array_join(F.map_keys("matched_criteria"), " ").alias("matched"))


@query("t1_sort_results", f"select resume_id, round(({_RELEVANCE}) / 4, 4) as relevance from ({_PROFILES})")
def _(t):
    return search.sort_results(search.relevance(profiles(t), **_CRITERIA)).select("resume_id", "relevance")


@query("t2_page", "select resume_id, full_name, expectation from resumes_v order by expectation desc, resume_id limit 20 offset 40")
def _(t):
    keys = [F.col("expectation").desc_nulls_last(), F.asc("resume_id")]
    return search.page(t.resumes_v(), keys, 3, 20).select("resume_id", "full_name", "expectation")


@query("t2_page_after", """
    select resume_id, full_name, expectation from resumes_v where expectation < 5000 or (expectation = 5000 and resume_id > 10)
    order by expectation desc, resume_id limit 20""")
def _(t):
    return search.page_after(t.resumes_v(), "expectation", "resume_id", (5000.0, 10), 20).select("resume_id", "full_name", "expectation")


@query("t2_page_info", "select 3 as page, 20 as \"limit\", count(*) as total, cast(ceil(count(*) / 20) as bigint) as total_pages from resumes_v")
def _(t):
    return search.page_info(t.resumes_v(), 3, 20)
