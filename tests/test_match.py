import pytest
from pyspark.sql import functions as F

from samples import RESUME
from talentloom import schemas
from talentloom.functions.values import recommendation
from talentloom.operators import match, search
from talentloom.plans import batch, matching

AS_OF = "2024-03-01"


@pytest.fixture(scope="module")
def resumes(spark):
    df = spark.createDataFrame([("r1", RESUME), ("r2", "nothing")], "id string, raw_text string")
    df = df.withColumn("processing_status", F.lit("ai_processing")).withColumn("processed_at", F.lit(None).cast("timestamp"))
    return batch.enrich_plan(df, AS_OF)


@pytest.fixture(scope="module")
def jobs(spark):
    base = dict.fromkeys(schemas.JOB.names)
    simple = base | {"job_id": "j1", "title": "Senior Data Planner",
                     "skills": {"required": ["SQL", "Redis", " go "], "preferred": ["Forklift", "S3"]}}
    full = base | {"job_id": "j2", "title": "Chef", "company": "Inn", "location": "Paris, Ile, France",
                   "experience": {"minimum": 20, "preferred": 25}, "requirements": {"required": ["Doctor of Science"], "preferred": []},
                   "skills": {"required": ["Cooking"], "preferred": []}, "salary": {"min": 140000, "max": 180000}}
    return spark.createDataFrame([simple, full], schemas.JOB)


@pytest.fixture(scope="module")
def scored(spark, resumes, jobs):
    pairs = spark.createDataFrame([("r1", "j1"), ("r1", "j2"), ("r2", "j1")], "resume_id string, job_id string")
    out = matching.match_plan(pairs, matching.candidate_profiles(resumes, AS_OF), matching.job_profiles(jobs), AS_OF)
    return {(r.resume_id, r.job_id): r.result for r in out.collect()}


def test_good_match(scored):
    m = scored["r1", "j1"].matchingResults
    assert m.categoryScores.skillsMatch.score == 90  # all required, one of two preferred
    assert m.categoryScores.roleAlignment.score == 67  # senior, data of three words
    assert m.categoryScores.experienceMatch.score == m.categoryScores.educationMatch.score == m.categoryScores.locationMatch.score == 100
    assert m.overallScore == 92 and m.recommendation == "Excellent Match"
    assert m.strengthAreas == ["sql", "redis", "go"] and m.gapAnalysis.criticalGaps == []
    assert [g.missing for g in m.gapAnalysis.improvementAreas] == ["forklift"]
    assert m.competitiveAdvantages == ["s3"]
    assert scored["r1", "j1"].resumeId == "r1" and scored["r1", "j1"].jobTitle == "Senior Data Planner"


def test_bad_match(scored):
    r = scored["r1", "j2"]
    m = r.matchingResults
    assert m.categoryScores.skillsMatch.score == 20 and m.categoryScores.locationMatch.score == 0
    assert m.categoryScores.experienceMatch.score == 33 and m.categoryScores.educationMatch.score == 70  # master for doctor: one level short
    assert m.categoryScores.locationMatch.details["jobCountry"] == "France"
    assert m.recommendation == "Poor Match" and m.gapAnalysis.criticalGaps[0].impact == "critical"
    assert m.salaryAlignment.jobSalaryRange == "$140,000 - $180,000" and m.salaryAlignment.alignment == "unknown"
    assert r.explanation.recommendations == ["Gain experience with cooking"]


def test_candidate_without_skills_is_kept(scored):
    assert scored["r2", "j1"].matchingResults.categoryScores.skillsMatch.score == 0
    assert all(0 <= r.matchingResults.overallScore <= 100 for r in scored.values())


def test_no_personal_data_in_the_match_plan(resumes, jobs, spark):
    pairs = spark.createDataFrame([("r1", "j1")], "resume_id string, job_id string")
    row = matching.match_plan(pairs, matching.candidate_profiles(resumes, AS_OF), matching.job_profiles(jobs), AS_OF).first()
    assert not any(x in str(row) for x in ("Lindqvist", "post.example", "987-6543", "Harbour"))


def test_options_switch_parts_off(resumes, jobs, spark):
    pairs = spark.createDataFrame([("r1", "j2")], "resume_id string, job_id string")
    row = matching.match_plan(pairs, matching.candidate_profiles(resumes, AS_OF), matching.job_profiles(jobs), AS_OF,
                              include_explanation=False, suggest_improvements=False).first()
    e = row.result.explanation
    assert (e.summary, e.keyFactors, e.recommendations) == (None, [], [])


def test_labels(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 39, 40, 55, 70, 80, 87, 90, 100, None)], "s int").select(recommendation(F.col("s")).alias("l")).collect()
    assert [r.l and r.l.split()[0] for r in rows] == ["Poor", "Poor", "Weak", "Moderate", "Good", "Strong", "Strong", "Excellent", "Excellent", None]


def test_check_job(jobs):
    assert {r.job_id: r.missing_fields for r in match.check_job(jobs).collect()} == {"j1": ["requirements.required"], "j2": []}


def test_location(spark):
    def score(job, person):
        parts = ("city", "state", "country")
        lit = lambda values: {p: F.lit(v).cast("string") for p, v in zip(parts, values)}
        return spark.range(1).select(match.location_score(lit(job), lit(person))).first()[0]

    me = ("Bristol", "Avon", "UK")
    assert score(("bristol", None, None), me) == 100 and score(("Bath", "Avon", "UK"), me) == 75
    assert score(("X", "Y", "uk"), me) == 50 and score(("X", "Y", "Z"), me) == 0
    assert score(("Remote", None, None), me) == 100 and score((None, None, None), me) == 100


def test_tables_from_nested_records(resumes):
    skills = {r.skill for r in batch.skill_rows(resumes).collect()}
    assert {"python", "sql", "go", "aws", "s3", "lambda", "kubernetes", "postgresql", "redis"} == skills
    roles = batch.experience_rows(resumes, AS_OF).orderBy("start_date").collect()
    assert [(r.resume_id, r.title, str(r.start_date)) for r in roles] == [
        ("r1", "Data Engineer", "2016-01-01"), ("r1", "Senior Data Engineer", "2019-03-01")]


def test_pages_follow_each_other(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "resume_id int, salary double")
    keys = search.sort_columns("salary", "desc")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    by_offset = [tuple(r) for n in range(1, 6) for r in search.page(df, keys, n, 10).collect()]
    assert by_offset == want
    seen = [tuple(r) for r in search.page(df, keys, 1, 10).collect()]
    while True:
        more = search.page_after(df, "salary", "resume_id", (seen[-1][1], seen[-1][0]), 10).collect()
        if not more:
            break
        seen += [tuple(r) for r in more]
    assert seen == want
    assert tuple(search.page_info(df, 2, 20).first()) == (2, 20, 50, 3)
    with pytest.raises(ValueError):
        search.page(df, keys, 0, 10)
    with pytest.raises(ValueError):
        search.page(df, keys, 1, 101)


def test_relevance_without_criteria(spark):
    assert search.relevance(spark.range(1)).first().relevance == 1.0


def test_every_search_criterion(spark):
    row = dict(resume_id=1, skills=["python", "sql"], years=5.0, education_level="Master", education_field="Computer Science", city="Oslo",
               state="Viken", country="Norway", job_title="Senior Data Engineer", career_level="senior", salary=100.0)
    df = spark.createDataFrame([row])
    good = dict(skills=["Python", " SQL"], years_min=5, years_max=5, education_level=["master"], education_field="computer", city="oslo",
                state="VIKEN", country="norway", job_title="data eng", career_level="Senior", salary_min=100, salary_max=100)
    bad = dict(skills=["Python", "Go"], years_min=6, years_max=4, education_level=["bachelor"], education_field="law", city="Rome", state="x",
               country="y", job_title="chef", career_level="junior", salary_min=101, salary_max=99)
    assert search.search(df, **good).count() == 1 and search.search(df).count() == 1
    out = search.relevance(df, **good).first()
    assert out.relevance == 1.0 and set(out.matched_criteria) == set(good)
    none = search.relevance(df, **bad).first()
    assert none.relevance == 0.0 and none.matched_criteria == {}
    conditions = [~F.coalesce(c, F.lit(False)) for c in search.criteria_columns(**bad).values()]
    assert len(conditions) == 12 and all(df.select(*conditions).first())
    with pytest.raises(ValueError):
        search.sort_columns("name")


def test_salary_and_career_blocks(spark, resumes):
    market = [("senior", "technology", "United Kingdom", 50000.0 + i) for i in range(5)] + [("junior", "x", "y", 1.0)] * 9
    market = spark.createDataFrame(market, "level string, industry string, country string, salary double")
    out = {r.id: r for r in batch.compare_plan(resumes, market, AS_OF).collect()}
    e = out["r1"].ai_enhancements
    assert tuple(e.salaryEstimate)[:3] == (50001, 50003, "GBP") and e.salaryEstimate.comments == "Based on 5 comparable careers."
    assert e.careerProgression.comments == "From careers which went on from Senior Data Engineer"
    assert e.qualityScore == 100 and e.careerProgression.suggestedNextRoles == []
    other = out["r2"].ai_enhancements  # an entry-level record: only the widest group has enough rows
    assert other.salaryEstimate.comments == "Based on 14 comparable careers." and other.careerProgression is None
    assert out["r1"].processing_status == "completed" and set(out) == {"r1", "r2"}


def test_skills_of_a_pair_meet_as_lists(spark, monkeypatch):
    """Nothing is multiplied by the skills of a job unless a candidate has very many; both ways, null keys and repeated pairs give the same."""
    have = [(1, "a"), (1, "a"), (1, "b"), (1, "d"), (2, "c"), (2, None), (None, "a"), *[(3, s) for s in "abcdef"]]
    needs = [(7, "b", "required"), (7, "a", "preferred"), (7, "x", "required"), (8, "c", "required"), (None, "a", "required")]
    asked = [(1, 7, "p"), (1, 7, "q"), (1, 7, "q"), (2, 7, "p"), (2, 8, "p"), (3, 7, "p"), (3, 8, "p"), (4, 7, "p"), (None, 7, "p"), (1, None, "p"), (1, 9, "p")]
    skills = spark.createDataFrame(have, "resume_id int, skill string").repartition(3)
    jobs = spark.createDataFrame(needs, "job_id int, skill string, need string").repartition(3)
    pairs = spark.createDataFrame(asked, "resume_id int, job_id int, note string").repartition(3)
    held, named = ({k: {s for j, s, *_ in rows if j == k and s is not None} for k in {j for j, *_ in rows if j is not None}} for rows in (have, needs))
    want = sorted(((r, j, n, sorted(held.get(r, set()) & named.get(j, set()))) for r, j, n in asked), key=str)
    for most, explodes in ((1000, False), (2, True), (0, True)):
        monkeypatch.setattr(match, "LISTED", most)
        out = match.attach_skills(pairs, skills, jobs)
        assert sorted(((x.resume_id, x.job_id, x.note, x.have) for x in out.collect()), key=str) == want, most
        assert ("Generate explode" in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]) == explodes, most
        hits = {(x.resume_id, x.job_id): (x.required_hit, x.preferred_hit) for x in match.match_skills(skills, jobs, pairs).collect()}
        assert hits == {(1, 7): (1, 1), (2, 7): (0, 0), (2, 8): (1, 0), (3, 7): (1, 1), (3, 8): (1, 0), (4, 7): (0, 0), (None, 7): (0, 0)}


def test_lists_of_jobs_do_not_travel_with_pairs(spark, monkeypatch):
    """Pairs took the texts of their job's skills to the candidate, and then the job row with its lists; now hashes, and the candidate row to the job."""
    skills = spark.createDataFrame([(1, "a"), (1, "b"), (1, "cc"), (1, None), (2, "dd"), (None, "a")], "resume_id int, skill string")
    needs = spark.createDataFrame([(7, "a", "required"), (7, "x", "required"), (7, "cc", "preferred"), (8, "yy", "preferred"), (8, None, "required")], "job_id int, skill string, need string")
    pairs = spark.createDataFrame([(1, 7), (1, 7), (1, 8), (2, 7), (None, 7), (1, 9), (5, 8)], "resume_id int, job_id int")
    people = spark.createDataFrame([(1, "p"), (2, "q")], "resume_id int, name string")
    want = sorted([(1, 7, "p", 2, 1, 1, 1)] * 2 + [(1, 8, "p", 0, 0, 1, 0), (2, 7, "q", 2, 0, 1, 0), (None, 7, None, 2, 0, 1, 0), (5, 8, None, 0, 0, 1, 0)], key=str)

    def hits():
        joined = match.join_pairs(match.attach_skills(pairs, skills, needs), people, match.job_lists(needs))
        rows = match.skill_hits(joined).select("resume_id", "job_id", "name", "required_n", "required_hit", "preferred_n", "preferred_hit").collect()
        return joined, sorted((tuple(x) for x in rows), key=str)

    for most in (1000, 0):
        monkeypatch.setattr(match, "LISTED", most)
        joined, got = hits()
        assert got == want, most
        top = joined._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
        assert top.startswith(" Inner") and "job_id" in top.split("\n")[0]  # the wide rows of the jobs come last
        assert match.attach_skills(pairs, skills, needs).where("resume_id = 1 and job_id = 7").first().have == ["a", "cc"]
        with monkeypatch.context() as m:  # skills that share a hash change no count
            m.setattr(match.F, "xxhash64", lambda c: F.length(c).cast("long"))
            assert hits()[1] == want, most
    plan = match.attach_skills(pairs, skills, needs)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan


def test_skill_texts_are_dealt_once(spark, tmp_path):
    """Lists of a job went to its employer and back, and a job's and a candidate's texts were dealt by skill before they were dealt by key."""
    from talentloom.plans.catalogue import match_queries
    from talentloom.plans.views import Tables

    tables = {
        "region": ([(0, "ASIA")], "r_regionkey long, r_name string"),
        "nation": ([(0, "CHINA", 0)], "n_nationkey long, n_name string, n_regionkey long"),
        "supplier": ([(1, "S1", 0, 10.0), (2, "S2", 0, 20.0), (2, "S2", 0, 20.0), (None, "S3", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"),
        "customer": ([(1, "C1", "AUTO", 0, 5.0), (2, "C2", None, 0, None)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey long, c_acctbal double"),
        "part": ([(1, "TIN", "Nut"), (2, "TIN", "Bolt"), (3, "tin", "nut"), (4, None, None)], "p_partkey long, p_type string, p_name string"),
        "orders": ([(1, 1, "1995-01-01"), (2, 2, "1996-01-01"), (3, None, "1996-01-01")], "o_orderkey long, o_custkey long, o_orderdate string"),
        "lineitem": ([(1, 1, 1, 30.0, "1995-02-01"), (1, 2, 1, 5.0, "1995-02-01"), (2, 3, 1, 7.0, "1995-02-01"), (2, 2, 2, 40.0, "1996-02-01"),
                      (3, 1, 2, 40.0, "1996-02-01"), (2, 9, 2, 1.0, "1997-02-01"), (2, 1, None, 1.0, None)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_shipdate string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(spark, str(tmp_path))
    first, second = 1000 + 5 * 12 + 2, 2000 + 6 * 12 + 2
    jobs = sorted((r.job_id, r.required, r.preferred, r.job_state) for r in match_queries.jobs(t).collect())
    assert jobs == [(first, ["tin nut"], ["tin bolt"], "ASIA"), *[(second, ["tin bolt", "tin nut"], [], "ASIA")] * 2]
    have = {(r.resume_id, r.job_id): r.have for r in match_queries.asked(t).collect()}
    assert have == {(1, first): ["tin bolt", "tin nut"], (2, first): ["tin bolt", "tin nut"], (2, second): ["tin bolt", "tin nut"], (None, second): [],
                    (2, second + 12): [], (2, None): []}

    def dealt(df, column):
        """The keys by which rows with this column are dealt out."""
        found = []

        def walk(node):
            names = [node.output().apply(i).name() for i in range(node.output().size())]
            if node.nodeName() == "Exchange" and column in names:
                found.append(node.outputPartitioning().toString().split("#")[0].split("(")[-1])
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(df._jdf.queryExecution().executedPlan())
        return found

    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    try:
        assert dealt(match_queries.jobs(t), "required") == [] and dealt(match_queries.jobs(t), "skill") == ["job_id"]
        held = match._held_lists(t.resume_skills_v().select("resume_id", "skill"))
        assert dealt(held, "skill") == ["resume_id"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
