"""Text operators on whole documents and on résumé texts made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom import rules
from talentloom.functions.dates import duration_text, parse_loose_date, parse_ts
from talentloom.functions.values import career_level, recommendation
from talentloom.operators import enrich, extraction, text_analysis
from talentloom.plans import batch
from talentloom.plans.catalogue.registry import query, quoted

AS_OF = "2024-02-01"
_SPLIT = r"[^\p{L}\p{N}]+"
_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_WORDS = f"list_filter(list_distinct(string_split_regex(lower(text), '{_SPLIT}')), lambda w: w <> '')"


def _lexicon(t):
    """All words of the benchmark items, each in the category of its item."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), rules.TOKEN_SPLIT)))
    return t.benchmark.select(F.concat(F.lit("topic"), (F.col("item_id") % 10).cast("string")).alias("category"), words.alias("term")).filter(
        F.col("term") != ""
    )


_TAGGED = f"""select doc_id, category, count(*) as n_terms from (
        select doc_id, unnest({_WORDS}) as term from documents) d
    join (select distinct category, term from (select 'topic' || (item_id % 10) as category, unnest({_WORDS}) as term from benchmark)) l on l.term = d.term group by 1, 2"""


@query("j08_tag_terms", _TAGGED)
def _(t):
    return text_analysis.tag_terms(t.texts(), _lexicon(t))


@query("s20_industry_fit", f"""
    with tagged as ({_TAGGED}), top as (select doc_id, max(n_terms) as best from tagged group by 1)
    select g.doc_id, string_agg(category || '=' || printf('%.2f', round(n_terms / best, 2)), ' ' order by category) as fit
    from tagged g join top on top.doc_id = g.doc_id group by 1""")
def _(t):
    fit = text_analysis.industry_fit(text_analysis.tag_terms(t.texts(), _lexicon(t)))
    shown = F.transform(F.map_entries("industry_fit"), lambda e: F.format_string("%s=%.2f", e["key"], e["value"]))
    return fit.select("doc_id", F.array_join(F.array_sort(shown), " ").alias("fit"))


def _stop_sql(lang):
    listed = ", ".join(quoted(w) for w in rules.STOP_WORDS[lang])
    return f"len(list_filter(words, lambda w: list_contains([{listed}], w)))"


@query("s31_detect_language", f"""
    select doc_id, case greatest(de, en, es, fr) when 0 then null when de then 'de' when en then 'en' when es then 'es' else 'fr' end as language,
           cast(greatest(de, en, es, fr) as int) as stop_words
    from (select doc_id, {', '.join(f'{_stop_sql(x)} as {x}' for x in ('de', 'en', 'es', 'fr'))}
          from (select doc_id, {_WORDS} as words from documents))""")
def _(t):
    return text_analysis.detect_language(t.texts()).select("doc_id", "language", "stop_words")


def _bias_sql(category):
    single = ", ".join(quoted(w) for w in rules.BIAS_WORDS[category] if " " not in w)
    parts = [f"select doc_id, '{category}' as category, w as finding from words where w in ({single})"]
    for phrase in rules.BIAS_WORDS[category]:
        if " " in phrase:
            parts.append(f"select doc_id, '{category}', {quoted(phrase)} from english where regexp_matches(lower(text), '{rules.whole_words(phrase)}')")
    return " union all ".join(parts)


_ENGLISH = f"""(select doc_id, text from (select doc_id, text, {', '.join(f'{_stop_sql(x)} as {x}' for x in ('de', 'en', 'es', 'fr'))}
    from (select doc_id, text, {_WORDS} as words from documents)) where en > 0 and en = greatest(de, en, es, fr) and de < en)"""
_BIAS = (f"with english as {_ENGLISH}, words as (select doc_id, unnest(list_distinct(string_split_regex(lower(text), '{rules.WORD_SPLIT}'))) as w from english) "
         + " union all ".join(_bias_sql(c) for c in rules.BIAS_WORDS))


def _bias(t):
    """Reports of the documents, word lists for the English ones."""
    return text_analysis.bias_report(text_analysis.detect_language(t.texts()), AS_OF, text="text", language=F.col("language"))


@query("s18_bias_report", f"""
    select d.doc_id, f.n is not null as bias_detected, cast(coalesce(f.n, 0) as int) as n_findings, coalesce(shown, '') as findings
    from documents d left join (select doc_id, count(*) as n, string_agg(category || ':' || finding, ' ' order by category || ':' || finding) as shown
    from ({_BIAS}) group by 1) f on f.doc_id = d.doc_id""")
def _(t):
    out = _bias(t)
    shown = F.transform("biasReport.findings", lambda f: F.concat(f["category"], F.lit(":"), f["finding"]))
    return out.select(
        "doc_id", F.col("biasReport.biasDetected").alias("bias_detected"), F.size("biasReport.findings").alias("n_findings"),
        F.array_join(F.array_sort(shown), " ").alias("findings"),
    )


@query("a13_bias_summary", f"""
    select category, count(distinct doc_id) as records, count(*) as findings, count(distinct finding) as wordings from ({_BIAS}) group by 1""")
def _(t):
    return text_analysis.bias_summary(_bias(t), "doc_id")


@query("s09_redact_text", f"""
    select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{rules.EMAIL_PATTERN}', '[REDACTED]', 'g'),
        '{rules.PROFILE_PATTERN}', '[REDACTED]', 'g'), '{rules.PHONE_PATTERN}', '[REDACTED]', 'g')) as digest from documents""")
def _(t):
    return text_analysis.redact(t.texts(), "text").select("doc_id", F.md5("redacted").alias("digest"))


@query("s13_contact_fields", f"""
    select doc_id, nullif(regexp_extract(text, '{rules.EMAIL_PATTERN}'), '') as email,
           nullif(trim(regexp_extract(text, '{rules.PHONE_PATTERN}')), '') as phone,
           md5(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x, {_WS}) <> '')[1], {_WS})) as first_line
    from documents""")
def _(t):
    out = text_analysis.contact_fields(t.texts(), "text")
    return out.select("doc_id", "email", "phone", F.md5("full_name").alias("first_line"))


@query("s12_split_sections", """
    select id, 6 as n_sections, 'Worked in ' || industry || ' for many years.' as summary,
           industry || ' Certificate' || chr(10) || 'Institute of ' || region || chr(10) || '(Issued: ' || yr || ')' as certifications
    from texts_v""")
def _(t):
    out = extraction.split_sections(t.resume_texts_v())
    s = F.col("sections")
    return out.select("id", F.size(s).alias("n_sections"), s["profile"].alias("summary"), s["certifications"].alias("certifications"))


@query("s13_extract_contact", """
    select id, full_name, split_part(full_name, ' ', 1) as first, 'user' || id || '@mail.example.com' as email,
           '(312) 470-' || lpad(cast(id % 10000 as varchar), 4, '0') as phone, id || ' Canal Row' as street, region as city, country,
           'linkedin.com/in/user' || id as linkedin from texts_v""")
def _(t):
    out = extraction.extract_contact(extraction.with_lines(t.resume_texts_v())).select("id", "personalInfo.*")
    return out.select(
        "id", F.col("name.full").alias("full_name"), "name.first", "contact.email", "contact.phone", "contact.address.street",
        "contact.address.city", "contact.address.country", "contact.linkedin",
    )


@query("s14_extract_experience", """
    select id, title, industry || ' Inc.' as company, region || ', ' || country as location, cast(yr as varchar) as start_date,
           case mark when 'O' then 'Present' else cast(yr + 2 as varchar) end as end_date, mark = 'O' as is_current,
           case when mark = 'O' and yr = 2023 then '1 year 1 month' when mark = 'O' then (2024 - yr) || ' years 1 month' else '2 years' end as duration,
           'Shipped ' || amount || ' crates of ' || industry as achievement
    from texts_v""")
def _(t):
    out = extraction.extract_experience(extraction.with_lines(t.resume_texts_v()), AS_OF)
    role = out.select("id", F.explode_outer("experience").alias("e")).select("id", "e.*")
    return role.select(
        "id", "title", "company", "location", "start_date", "end_date", F.col("current").alias("is_current"), "duration",
        F.array_join("achievements", "|").alias("achievement"),
    )


@query("s15_extract_education", """
    select id, 'Bachelor of Science' as degree, region as field, 'University of ' || country as institution, region as location,
           cast(yr - 5 as varchar) as graduation_date, 'Class of ' || (yr - 5) as honors from texts_v""")
def _(t):
    out = extraction.extract_education(extraction.with_lines(t.resume_texts_v()))
    row = out.select("id", F.explode_outer("education").alias("e")).select("id", "e.*")
    return row.select("id", "degree", "field", "institution", "location", "graduation_date", F.array_join("honors", "|").alias("honors"))


@query("s16_extract_skills", """
    select id, 'Sectors' as category, industry || '|' || region || '|' || country || '|trade' as items, title as soft from texts_v""")
def _(t):
    out = extraction.extract_skills(extraction.with_lines(t.resume_texts_v()))
    group = F.explode_outer("skills.technical").alias("g")
    return out.select("id", F.col("skills.soft").alias("soft"), group).select(
        "id", "g.category", F.array_join("g.items", "|").alias("items"), F.array_join("soft", "|").alias("soft")
    )


@query("s17_extract_certs", """
    select id, industry || ' Certificate' as name, 'Institute of ' || region as issuer, cast(yr as varchar) as issue_date from texts_v""")
def _(t):
    out = extraction.extract_certs(extraction.with_lines(t.resume_texts_v()))
    return out.select("id", F.explode_outer("certifications").alias("c")).select("id", "c.name", "c.issuer", F.col("c.issueDate").alias("issue_date"))


def _layouts(t):
    return extraction.with_lines(t.resume_layouts_v())


@query("s13_layout_contact", """
    select id, full_name, 'user' || id || '@mail.example.com' as email, '(312) 470-' || lpad(cast(id % 10000 as varchar), 4, '0') as phone, id || ' Canal Row' as street,
           region as city, country, 'Worked in ' || industry || ' for many years.' as summary from layouts_v""")
def _(t):
    doc = F.col("structured_data")
    info = doc["personalInfo"]
    return extraction.structure_resumes(t.resume_layouts_v(), AS_OF).select(
        "id", info["name"]["full"].alias("full_name"), info["contact"]["email"].alias("email"), info["contact"]["phone"].alias("phone"),
        info["contact"]["address"]["street"].alias("street"), info["contact"]["address"]["city"].alias("city"), info["contact"]["address"]["country"].alias("country"),
        doc["summary"]["text"].alias("summary"),
    )


@query("s14_layout_roles", """
    select id, 0 as pos, title1 as title, firm1 as company, place as location, cast(yr as varchar) as start_date, until as end_date, until = 'Present' as is_current,
           case form when 1 then 'Moved goods for the whole branch.' when 3 then 'Moved ' || amount || ' crates of goods.' end as description,
           case when form < 3 then 'Moved ' || amount || ' crates' else '' end as achievements from layouts_v
    union all
    select id, 1, title2, firm2, case when form < 3 then place end, case form when 1 then 'Mar ' else '' end || (yr - 4), case form when 1 then 'Jul ' else '' end || (yr - 1), false,
           case form when 3 then 'Planned the work of nine people.' end,
           case form when 0 then 'Planned the work of nine people, with reports to the board' when 3 then '' else 'Planned the work of nine people' end from layouts_v""")
def _(t):
    # the outer form spares Spark's extra filter, which would read every entry a second time
    out = extraction.extract_experience(_layouts(t), AS_OF).select("id", F.posexplode_outer("experience").alias("pos", "e")).filter(F.col("pos").isNotNull())
    return out.select("id", "pos", "e.title", "e.company", "e.location", "e.start_date", "e.end_date", F.col("e.current").alias("is_current"), "e.description",
                      F.array_join("e.achievements", "|").alias("achievements"))


@query("s15_layout_degrees", """
    select id, 0 as pos, list_extract(['BSc', 'Master of Science', 'Diploma', 'Licence'], cast(form + 1 as int)) as degree,
           case form when 0 then 'Accounting' else 'Trade' end as field, 'University of ' || country as institution,
           case form when 0 then null when 3 then country else place end as location, cast(yr - 5 as varchar) as graduation_date, cast(null as double) as gpa from layouts_v
    union all
    select id, 1, case form when 0 then 'Diploma' else 'Bachelor of Arts' end, case form when 0 then 'Trade' else 'History' end, 'College of ' || region,
           case form when 1 then place end, cast(yr - 8 as varchar), case form when 1 then 3.5 end from layouts_v where form < 2""")
def _(t):
    out = extraction.extract_education(_layouts(t)).select("id", F.posexplode_outer("education").alias("pos", "e")).filter(F.col("pos").isNotNull())
    return out.select("id", "pos", "e.degree", "e.field", "e.institution", "e.location", "e.graduation_date", "e.gpa")


@query("s16_layout_skills", """
    select id, case form when 0 then 'SKILLS' when 3 then 'Planning' else 'Skills' end as category,
           case form when 3 then 'rotas|stock' else 'Excel|SQL|' || industry end as items, case form when 2 then 'German|English' else '' end as languages from layouts_v
    union all select id, 'Tools', 'Excel|' || industry, '' from layouts_v where form = 3""")
def _(t):
    out = extraction.extract_skills(_layouts(t))
    tongues = F.array_join(F.transform("skills.languages", lambda x: x["language"]), "|").alias("languages")
    return out.select("id", tongues, F.explode("skills.technical").alias("g")).select("id", "g.category", F.array_join("g.items", "|").alias("items"), "languages")


@query("s17_layout_certs", """
    select id, case form when 0 then 'ACCA' else 'Certified Planner' end as name, case when form <> 1 then 'Institute of ' || region end as issuer,
           cast(yr as varchar) as issue_date, case form when 3 then cast(yr + 3 as varchar) end as expiry_date from layouts_v
    union all select id, 'Certified Planner', null, cast(yr - 1 as varchar), null from layouts_v where form = 0""")
def _(t):
    out = extraction.extract_certs(_layouts(t)).select("id", F.explode("certifications").alias("c"))
    return out.select("id", "c.name", "c.issuer", F.col("c.issueDate").alias("issue_date"), F.col("c.expiryDate").alias("expiry_date"))


def _completed(t):
    texts = t.resume_texts_v().withColumn("processing_status", F.lit(rules.AI_PROCESSING)).withColumn(
        "processed_at", F.lit(None).cast("timestamp")
    )
    return batch.enrich_plan(texts, AS_OF)


@query("s19_quality_scores", """
    select id, 100 as completeness, 60 as quality, 0 as n_suggestions from texts_v""")
def _(t):
    out = enrich.quality_scores(extraction.structure_resumes(t.resume_texts_v(), AS_OF))
    return out.select("id", F.col("completenessScore").alias("completeness"), F.col("qualityScore").alias("quality"),
                      F.size("suggestions").alias("n_suggestions"))


@query("s19_quality_partial", """
    select id, case when processing_status = 'completed' then 25 else 0 end as completeness,
           case when processing_status = 'completed' then 15 else 0 end as quality,
           case when processing_status = 'completed' then 6 else 9 end as n_suggestions from stored_resumes_v""")
def _(t):
    out = enrich.quality_scores(t.stored_resumes_v())
    return out.select("id", F.col("completenessScore").alias("completeness"), F.col("qualityScore").alias("quality"),
                      F.size("suggestions").alias("n_suggestions"))


@query("enriched_records", """
    select id, 'completed' as status, title, 60 as quality, yr - 5 <= 2014 as bias_detected, '[REDACTED]' as hidden_name,
           '[REDACTED]' as hidden_email, round(case mark when 'O' then ((2024 - yr) * 12 + 1) / 12 else 2 end, 2) as years from texts_v""")
def _(t):
    e, doc = F.col("ai_enhancements"), F.col("structured_data")
    return _completed(t).select(
        "id", F.col("processing_status").alias("status"), F.get(doc["experience"], F.lit(0))["title"].alias("title"),
        e["qualityScore"].alias("quality"), e["biasReport"]["biasDetected"].alias("bias_detected"),
        e["anonymizedData"]["personalInfo"]["name"]["full"].alias("hidden_name"),
        e["anonymizedData"]["personalInfo"]["contact"]["email"].alias("hidden_email"),
        doc["summary"]["yearsOfExperience"].alias("years"),
    )


@query("s08_anonymize", """
    select id, case when processing_status = 'completed' then '[REDACTED]' end as full_name, cast(null as varchar) as phone,
           case when processing_status = 'completed' then '[REDACTED]' end as country,
           case when processing_status = 'completed' then industry end as industry from stored_resumes_v""")
def _(t):
    info = F.col("anonymizedData.personalInfo")
    return enrich.anonymize(t.stored_resumes_v()).select(
        "id", info["name"]["full"].alias("full_name"), info["contact"]["phone"].alias("phone"),
        info["contact"]["address"]["country"].alias("country"), F.col("anonymizedData.summary.industryFocus").alias("industry"),
    )


@query("s10_parse_loose_date", """
    select o_orderkey, case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m') || '-01'
        when 2 then strftime(o_orderdate, '%Y') || '-01-01' when 3 then '2024-02-01' when 4 then null
        else strftime(o_orderdate, '%Y-%m') || '-01' end as day from orders""")
def _(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMMM yyyy")).when(k == 2, F.date_format(d, "yyyy"))
        .when(k == 3, "Present").when(k == 4, F.concat(F.lit("about "), F.date_format(d, "yyyy"))).otherwise(F.date_format(d, "MMM yyyy"))
    )
    return t.orders.select("o_orderkey", F.date_format(parse_loose_date(text, AS_OF), "yyyy-MM-dd").alias("day"))


@query("s11_duration_text", """
    with m as (select exp_id, (year(end_date) - year(start_date)) * 12 + month(end_date) - month(start_date) as n from employment_v)
    select exp_id, case when n = 0 then '0 months' else trim(case when n >= 12 then (n // 12) || ' year' || case when n // 12 = 1 then '' else 's' end else '' end
        || ' ' || case when n % 12 > 0 then (n % 12) || ' month' || case when n % 12 = 1 then '' else 's' end else '' end) end as duration
    from m""")
def _(t):
    return t.employment_v().select("exp_id", duration_text(F.col("start_date"), F.col("end_date")).alias("duration"))


@query("s06_parse_ts", """
    select event_id, case when event_type = 'error' then '2024-02-01 00:00:00' when event_type = 'view'
        then strftime(date_trunc('second', ts) - interval 2 hour, '%Y-%m-%d %H:%M:%S')
        else strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') end as ts from events""")
def _(t):
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_type")
    text = F.when(kind == "error", F.concat(F.lit("at "), base)).when(kind == "view", F.concat(base, F.lit("+02:00"))).otherwise(
        F.concat(base, F.lit("Z"))
    )
    return t.events.select("event_id", F.date_format(parse_ts(text, AS_OF), "yyyy-MM-dd HH:mm:ss").alias("ts"))


_TITLES = ("Chief Buyer", "Head of Sales", "Lead Clerk", "Junior Clerk", "Clerk", "Headhunter")


@query("s21_career_level", """
    select resume_id, case resume_id % 6 when 0 then 'c-level' when 1 then 'executive' when 2 then 'senior'
        else case when y >= 8 then 'senior' when resume_id % 6 = 3 then 'junior' when y < 1 then 'entry' when y < 3 then 'junior' else 'mid-level' end end as career_level
    from (select resume_id, round(months / 12, 2) as y from years_v)""")
def _(t):
    years = enrich.years_of_experience(t.employment_v(), AS_OF)
    title = F.element_at(F.array(*[F.lit(x) for x in _TITLES]), (F.col("resume_id") % 6 + 1).cast("int"))
    return years.select("resume_id", career_level(title, F.col("years")).alias("career_level"))


@query("s22_recommendation", """
    select p_partkey, case when s < 40 then 'Poor Match' when s < 55 then 'Weak Match' when s < 70 then 'Moderate Match'
        when s < 80 then 'Good Match' when s < 90 then 'Strong Match' else 'Excellent Match' end as label
    from (select p_partkey, p_size * 2 as s from part)""")
def _(t):
    return t.part.select("p_partkey", recommendation(F.col("p_size") * 2).alias("label"))
