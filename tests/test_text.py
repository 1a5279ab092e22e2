from datetime import date

import pytest
from pyspark.sql import functions as F

from samples import RESUME
from talentloom.functions import dates, text, values
from talentloom.operators import enrich, extraction, text_analysis
from talentloom.plans import batch

AS_OF = "2024-03-01"


@pytest.fixture(scope="module")
def record(spark):
    rows = [("1", RESUME), ("2", "only a line"), ("3", "   "), ("4", "---\nSkills\n---")]
    df = spark.createDataFrame(rows, "id string, raw_text string").withColumn("processing_status", F.lit("ai_processing"))
    df = df.withColumn("processed_at", F.lit(None).cast("timestamp"))
    return {r["id"]: r for r in batch.enrich_plan(df, AS_OF).collect()}


def test_contact(record):
    info = record["1"].structured_data.personalInfo
    assert (info.name.full, info.name.first, info.name.last) == ("Mara Lindqvist", "Mara", "Lindqvist")
    assert info.contact.email == "mara.lindqvist@post.example.org"
    assert info.contact.phone == "(555) 987-6543"
    assert info.contact.linkedin == "linkedin.com/in/maralindqvist"
    assert info.contact.website == "https://mara.example.org/cv"
    a = info.contact.address
    assert (a.street, a.city, a.state, a.zipCode, a.country) == (
        "7 Harbour Lane", "Bristol", "Avon", "BS1 4XE", "United Kingdom")


def test_experience(record):
    first, second = record["1"].structured_data.experience
    assert (first.title, first.company, first.location) == ("Senior Data Engineer", "Northwind Analytics", "Bristol, Avon")
    assert (first.start_date, first.end_date, first.current, first.duration) == ("March 2019", "Present", True, "5 years")
    assert first.description == "Leads the platform team."
    assert first.achievements == ["Cut the nightly load by 35% with Python and Kafka.", "Moved reports to PostgreSQL (on AWS)."]
    assert set(first.technologies) == {"Python", "PostgreSQL", "AWS"}
    assert (second.current, second.duration, second.technologies) == (False, "4 years", ["SQL"])


def test_education_skills_certifications(record):
    doc = record["1"].structured_data
    (edu,) = doc.education
    assert (edu.degree, edu.field, edu.institution, edu.graduation_date, edu.gpa) == (
        "Master of Science", "Statistics", "University of Leeds", "2012", 3.8)
    assert edu.honors == ["GPA: 3.8", "Graduated with distinction"]
    assert [(t.category, t["items"]) for t in doc.skills.technical] == [
        ("Programming Languages", ["Python", "SQL", "Go"]), ("Cloud", ["AWS", "S3", "Lambda", "Kubernetes"]),
        ("Databases", ["PostgreSQL", "Redis"])]
    assert doc.skills.soft == ["Mentoring", "Writing"]
    assert [(x.language, x.proficiency) for x in doc.skills.languages] == [("Swedish", "Native"), ("English", None)]
    (cert,) = doc.certifications
    assert tuple(cert) == ("Certified Data Architect", "Example Institute", "2021", "2024", "CD-77")


def test_summary_counts_overlap_once(record):
    summary = record["1"].structured_data.summary
    assert summary.careerLevel == "senior" and summary.industryFocus == "technology"
    assert summary.yearsOfExperience == pytest.approx(8.17)  # 2016-01 to 2024-03, a year of overlap counted once
    assert "\n" not in summary.text


def test_enhancements(record):
    e = record["1"].ai_enhancements
    assert e.completenessScore == 100 and e.qualityScore == 100 and e.suggestions == []
    assert e.biasReport.biasDetected and [(f.category, f.finding) for f in e.biasReport.findings] == [("Age", "2012")]
    assert e.industryFit == {"technology": 1.0, "finance": 0.5}


def test_nothing_redacted_survives(record, spark):
    doc = record["1"].ai_enhancements.anonymizedData
    shown = str(doc.asDict(recursive=True))
    for secret in ("Mara", "Lindqvist", "555", "post.example.org", "Harbour", "linkedin.com"):
        assert secret not in shown
    assert doc.personalInfo.contact.address.city == "[REDACTED]"
    assert doc.experience[0].company == "Northwind Analytics"
    assert record["2"].ai_enhancements.anonymizedData.personalInfo.contact.email is None


def test_texts_without_sections(record):
    assert record["2"].structured_data.personalInfo.name.full == "only a line"
    assert record["2"].structured_data.experience == []
    assert record["3"].structured_data.personalInfo.name is None
    assert record["4"].structured_data.skills.technical == []
    assert record["3"].ai_enhancements.completenessScore == 0
    assert len(record["3"].ai_enhancements.suggestions) == 9


def test_repeated_headings_join(spark):
    df = spark.createDataFrame([("a\n---\nSkills\n---\n- A: x\n---\nSkills\n---\n- B: y",)], "raw_text string")
    s = extraction.split_sections(df).first().sections
    assert s == {"header": "a", "skills": "- A: x\n\n- B: y"}


def _one(spark, column, **cols):
    schema = ", ".join(f"{k} string" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("given, want", [
    ("2021-03-05", date(2021, 3, 5)), ("2021-03", date(2021, 3, 1)), ("March 2021", date(2021, 3, 1)), ("Mar 2021", date(2021, 3, 1)),
    ("03/2021", date(2021, 3, 1)), ("2020", date(2020, 1, 1)), (" present ", date(2024, 3, 1)), ("nope", None), (None, None),
    ("2021-13-40", None),
])
def test_loose_dates(spark, given, want):
    assert _one(spark, dates.parse_loose_date(F.col("t"), AS_OF), t=given) == want


def test_durations(spark):
    def run(a, b):
        return _one(spark, dates.duration_text(F.col("a").cast("date"), F.col("b").cast("date")), a=a, b=b)

    assert run("2020-01-01", "2024-07-01") == "4 years 6 months"
    assert run("2020-01-01", "2021-02-01") == "1 year 1 month"
    assert run("2020-01-01", "2020-01-20") == "0 months"
    assert run("2021-01-01", "2020-01-01") is None
    assert run(None, "2020-01-01") is None


def test_timestamps(spark):
    out = [_one(spark, F.date_format(dates.parse_ts(F.col("t"), "2000-01-01"), "yyyy-MM-dd HH:mm"), t=t)
           for t in ("2025-09-10T10:45:00Z", "2025-09-10T10:45:00+02:00", "bad", None)]
    assert out == ["2025-09-10 10:45", "2025-09-10 08:45", "2000-01-01 00:00", "2000-01-01 00:00"]


def test_timeframes():
    assert dates.timeframe_bounds("90d", "2024-03-31") == ("2023-10-03", "2024-01-01", "2024-03-31")
    assert dates.timeframe_bounds("all", "2024-03-31") == (None, None, "2024-03-31")
    with pytest.raises(ValueError):
        dates.timeframe_bounds("2d", "2024-03-31")


@pytest.mark.parametrize("name, want", [
    (".profile", ""), ("a.tar.gz", ".gz"), ("a", ""), (".a.b", ".b"), ("x.", ""), ("cv.PDF", ".PDF"),
])
def test_suffix(spark, name, want):
    assert _one(spark, text.file_suffix(F.col("t")), t=name) == want


def test_fence_is_a_character_set(spark):
    assert _one(spark, text.strip_fence(F.col("t")), t='\n```json\n{"a":1}\n```\n') == '\n{"a":1}\n'
    assert _one(spark, text.strip_fence(F.col("t")), t="null") == "ull"


@pytest.mark.parametrize("given, want", [("5", 5), ("3.0", 3), ("3.7", None), ("x", None), ("99999999999", None)])
def test_lenient_int(spark, given, want):
    assert _one(spark, values.lenient_int(F.col("t")), t=given) == want


def test_as_array(spark):
    assert _one(spark, values.as_array(F.col("t")), t='["a","b"]') == ["a", "b"]
    assert _one(spark, values.as_array(F.col("t")), t="a") == ["a"]
    assert _one(spark, values.as_array(F.col("t")), t=None) is None


def test_word_boundaries_next_to_accents(spark):
    rows = [(1, "heé"), (2, "éhe"), (3, "he é"), (4, "She said"), (5, "the"), (6, "HE")]
    df = spark.createDataFrame(rows, "id int, raw_text string")
    out = text_analysis.bias_report(df, AS_OF).select("id", "biasReport.biasDetected").collect()
    assert {r.id for r in out if r.biasDetected} == {3, 4, 6}


def test_every_finding_is_in_the_text(spark):
    df = spark.createDataFrame([(1, "He is married, born in Rome, a young man. She too.")], "id int, raw_text string")
    found = text_analysis.bias_report(df, AS_OF).first().biasReport.findings
    assert {(f.category, f.finding) for f in found} == {
        ("Gender", "he"), ("Gender", "she"), ("Marital", "married"), ("Ethnicity", "born in"), ("Age", "young")}


def test_language_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars >= 200")
    out = text_analysis.detect_language(docs)
    good, n = out.agg(F.count_if(F.col("lang") == F.col("language")), F.count("*")).first()
    assert good / n > 0.95


def test_redaction(spark):
    t = "Mail a.b@c.example.org or (555) 123-4567, see https://www.linkedin.com/in/x-y."
    assert _one(spark, text.redact_text(F.col("t")), t=t) == "Mail [REDACTED] or [REDACTED], see [REDACTED]"


def test_quality_bounds(spark):
    low, high = (enrich.quality_score(F.lit(c), F.lit(f), F.lit(r), F.lit(s)) for c, f, r, s in ((0, False, 0, 0), (100, True, 2, 200)))
    assert tuple(spark.range(1).select(low, high).first()) == (0, 100)


def test_words_cut_once_give_the_same_language_and_findings(spark):
    """Underscores part words for the language, not for the findings; phrases stand side by side and by themselves."""
    texts = [None, "", "___", "The_end of the road, und die Straße", "für_der die_das", "He was born in 1990, 30 years old", "years_old and bornin", "old years; born, in; native\nof",
             "a NATIVE OF Rome, born in1999 she_he", "born  in", "Él y la mujer de los pueblos, years old."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, raw_text string").withColumn("words", text_analysis.distinct_words(F.col("raw_text")))
    plain = text_analysis.detect_language(df, "raw_text").collect()
    assert text_analysis.detect_language(df, "raw_text", words=F.col("words")).collect() == plain
    assert [r["language"] for r in plain[3:6]] == ["de", "de", "en"]
    found = {r["id"]: {(f["category"], f["finding"]) for f in r["biasReport"]["findings"]} for r in text_analysis.bias_report(df, AS_OF, words=F.col("words")).collect()}
    assert found == {0: set(), 1: set(), 2: set(), 3: set(), 4: set(), 5: {("Gender", "he"), ("Age", "years old"), ("Ethnicity", "born in")}, 6: set(), 7: set(),
                     8: {("Ethnicity", "native of")}, 9: set(), 10: {("Age", "years old")}}


def test_texts_that_may_be_empty_are_worked_out_once(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    for made, mark in ((extraction._or_null(F.reverse("t")), "reverse("), (text.email_in(F.col("t")), "regexp_extract(")):
        assert df.select(made.alias("v"))._jdf.queryExecution().optimizedPlan().toString().count(mark) == 1
    df = spark.createDataFrame([(t,) for t in ("write to é.a+b@x-y.org, c@d.eu", "@@a@b", "...@x.io", "", None)], "t string").repartition(1)
    assert [r[0] for r in df.select(text.email_in(F.col("t"))).collect()] == [".a+b@x-y.org", None, "...@x.io", None, None]
