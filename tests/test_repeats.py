"""Repeated ids, repeated names, null places in an order, and other rows that must not multiply or vanish."""

import pytest
from pyspark.sql import functions as F

from talentloom.functions.values import degree_rank
from talentloom.operators import enrich, intake, match, progress, records, responses, text_analysis
from talentloom.plans import matching
from talentloom.plans.views import Tables

SF = "/root/testdata/sf0.001"
AS_OF = "2024-02-01"


@pytest.fixture(scope="module")
def stored(spark):
    return Tables(spark, SF).stored_resumes_v().cache()


def test_two_rows_for_an_id_change_one_record(spark, stored):
    n = stored.count()
    one = stored.filter("structured_data is not null").select("id").first()["id"]
    ids = spark.createDataFrame([(one, 1), (one, 2)], "id bigint, v int")
    block = ids.withColumn("block", F.struct((F.col("v") * 10).alias("min"), F.lit(9).alias("max"), F.lit("USD").alias("currency"), F.lit("c").alias("comments")))
    merged = records.merge_block(stored, "salaryEstimate", block, version="v")
    assert merged.count() == n and merged.filter(F.col("id") == one).first()["ai_enhancements"]["salaryEstimate"]["min"] == 20
    changes = ids.withColumn("status", F.when(F.col("v") == 2, "completed").otherwise("ai_failed"))
    out = records.advance_status(stored, changes, AS_OF, version="v")
    assert out.resumes.count() == n and out.resumes.filter(F.col("id") == one).first()["processing_status"] == "completed"
    assert out.status_events.count() == 1
    docs = ids.join(stored.select("id", "structured_data"), "id")
    assert records.overwrite_records(stored, docs, AS_OF, version="v").count() == n
    assert records.patch_records(stored, docs, AS_OF, version="v").count() == n


def test_two_results_for_a_match_give_one_row(spark):
    matches = Tables(spark, SF).stored_matches_v()
    one = matches.select("id").first()["id"]
    results = spark.createDataFrame([(one, None, "broken"), (one, '{"overallScore": 5}', None)], "match_id string, result string, error string")
    out = records.complete_matches(matches, results, AS_OF)
    assert out.count() == matches.count()
    row = out.filter(F.col("id") == one).first()
    assert row["status"] == "completed" and row["match_result"] == '{"overallScore": 5}'


def test_files_of_one_name_and_files_without_a_batch(spark):
    rows = [("b", "x.pdf", 1), ("b", "x.pdf", 2), ("b", "y.pdf", 3), (None, "z.pdf", 4), (None, "z.pdf", 4)]
    out = intake.bulk_accept(spark.createDataFrame(rows, "batch string, file string, n int"), "batch", "file", 2).collect()
    assert len(out) == 5
    assert sorted((r.batch or "", r.file, r.accepted) for r in out) == [
        ("", "z.pdf", True), ("", "z.pdf", True), ("b", "x.pdf", True), ("b", "x.pdf", True), ("b", "y.pdf", False)]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_rows_without_a_date_stay(spark, kind):
    rows = [(1, 1, "a", None), (1, 2, "b", "2020-01-01"), (1, 3, "c", "2021-01-01"), (None, 4, "d", "2021-01-01")]
    df = spark.createDataFrame(rows, "resume_id int, exp_id bigint, title string, d string").select(
        "resume_id", F.col("exp_id").cast(kind).alias("exp_id"), "title", F.col("d").cast("date").alias("start_date"))
    got = {int(r.exp_id): r.next_title for r in enrich.next_role(df).collect()}
    assert got == {1: "b", 2: "c", 3: None, 4: None}


def test_steps_without_a_time_stay(spark):
    rows = [(1, 1, None, "processing"), (1, 2, "2024-01-01 00:00:00", "ai_processing"), (1, 3, "2024-01-01 00:01:00", "completed")]
    df = spark.createDataFrame(rows, "resume_id int, event_id int, t string, status string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.event_id: (r.next_status, r.seconds) for r in progress.step_durations(df).collect()}
    assert got == {1: ("ai_processing", None), 2: ("completed", 60.0), 3: (None, None)}


def test_progress_counts_files_not_events(spark):
    rows = [(1, r, e, f"2024-01-01 00:0{e}:00", s) for r, e, s in ((7, 1, "processing"), (7, 2, "completed"), (8, 3, "processing"), (8, 4, "ai_processing"), (8, 5, "completed"))]
    df = spark.createDataFrame(rows, "batch int, resume_id int, event_id int, ts string, status string")
    (row,) = progress.bulk_progress(df).collect()
    assert (row.total, row.completed, row.processing, row.progress, row.status) == (2, 2, 0, 100, "completed")


def test_rare_skills_of_a_role_are_named(spark):
    skills = spark.createDataFrame([(k, f"s{k:02}") for k in range(20)], "resume_id int, skill string")
    roles = spark.createDataFrame([(k, "t") for k in range(20)], "resume_id int, title string")
    got = {r.resume_id: r.areas for r in enrich.missing_skills(skills, roles, roles, k=3).collect()}
    assert len(got) == 20 and got[0] == ["s01", "s02", "s03"] and got[5] == ["s00", "s01", "s02"]


def test_a_candidate_with_thousands_of_skills(spark):
    skills = spark.range(6000).select(F.lit(1).alias("resume_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("skill"))
    needs = spark.createDataFrame([(9, "s5", "required"), (9, "t", "required"), (9, "s5999", "preferred")], "job_id int, skill string, need string")
    pairs = spark.createDataFrame([(1, 9), (2, 9)], "resume_id int, job_id int")
    got = {r.resume_id: r.have for r in match.attach_skills(pairs, skills, needs).collect()}
    assert got == {1: ["s5", "s5999"], 2: []}


def test_answers_with_a_repeated_key_or_a_number_for_text(spark):
    texts = [(1, '{"min": 1, "max": 2, "currency": "USD", "comments": "a", "comments": "b"}'), (2, '{"comments": 5}'), (3, '{"comments": "x"} y'),
             (4, "{'comments': 'x'}"), (5, '{"comments": "it\'s"}'), (6, '{"comments": "x"}] {}'), (7, '{"comments": "x"}, {}')]
    df = spark.createDataFrame(texts, "id int, response string")
    parsed = {r.id: r.parse_ok for r in responses.parse_json(df, "salary").collect()}
    assert parsed == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False}
    assert responses.parse_json(df, "salary").filter("id = 1").first()["raw"]["comments"] == "b"


def test_degrees_are_whole_words(spark):
    names = {"Certified Scrum Master": 0, "Architect Associate": 0, "BSc": 2, "M.S. in Physics": 3, "Ph.D.": 4, "Bachelor of Arts": 2, "Master of Laws": 3,
             "Associate of Science": 1, "MBA": 3, "B.A.": 2, "Doctor of Law": 4, "Basic training": 0}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert {r.t: r.n for r in df.select("t", degree_rank(F.col("t")).alias("n")).collect()} == names


def test_places(spark):
    jobs = spark.createDataFrame([(1, "Berlin, Germany"), (2, "Paris, TX"), (3, "Austin, TX, USA"), (4, "Remote")], "job_id int, location string")
    for c, t in (("title", "string"), ("company", "string")):
        jobs = jobs.withColumn(c, F.lit("x").cast(t))
    lists = F.array(F.lit("sql"))
    jobs = jobs.withColumn("skills", F.struct(lists.alias("required"), lists.alias("preferred"))).withColumn("requirements", F.struct(lists.alias("required")))
    jobs = jobs.withColumn("experience", F.struct(F.lit(1).alias("minimum"), F.lit(2).alias("preferred"))).withColumn("salary", F.struct(F.lit(1).alias("min"), F.lit(2).alias("max")))
    profile = {r.job_id: (r.job_city, r.job_state, r.job_country) for r in matching.job_profiles(jobs).collect()}
    assert profile == {1: ("Berlin", None, "Germany"), 2: ("Paris", "TX", None), 3: ("Austin", "TX", "USA"), 4: ("Remote", None, None)}
    rows = [("Berlin", None, "Germany", "Munich", "Bavaria", "Germany", 50), ("Paris", "TX", None, "Paris", "Ile", "France", 0),
            ("Paris", "TX", None, "Paris", "TX", "USA", 100), ("Remote", None, None, "Oslo", None, "Norway", 100), ("Bonn", None, "Germany", "Bonn", None, "Germany", 100)]
    df = spark.createDataFrame(rows, "jc string, js string, jn string, c string, s string, n string, want int")
    score = match.location_score({"city": F.col("jc"), "state": F.col("js"), "country": F.col("jn")}, {"city": F.col("c"), "state": F.col("s"), "country": F.col("n")})
    assert all(r.got == r.want for r in df.withColumn("got", score).collect())


def test_english_words_in_other_languages_are_no_bias(spark):
    df = spark.createDataFrame([(1, "Er kommt her und die single Wohnung ist nicht mit der Stadt"), (2, "She is single and the work of her is in the house")], "id int, raw_text string")
    found = text_analysis.bias_report(text_analysis.detect_language(df, "raw_text"), AS_OF, language=F.col("language"))
    assert {r.id: r.biasReport["biasDetected"] for r in found.collect()} == {1: False, 2: True}
