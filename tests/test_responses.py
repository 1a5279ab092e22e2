import json

import pytest
from pyspark.sql import functions as F

from talentloom import schemas
from talentloom.operators import responses

NAME = {"personalInfo": {"name": {"full": "A B"}}}


def ingest(spark, kind, *answers, as_of="2024-03-01"):
    rows = [(i, a if isinstance(a, str) or a is None else json.dumps(a)) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "id int, response string")
    return [r for r in responses.ingest_responses(df, kind, as_of=as_of).orderBy("id").collect()]


@pytest.mark.parametrize("text, ok", [
    ('```json\n{"comments":"c"}\n```', True), ('{"comments":"c"}', True), ("{'comments':'c'}", False),
    ('{"comments":"c"} trailing', False), ('{"comments":"c"} {"comments":"c"}', False), ('{"comments":"c"}, {"comments":"c"}', False),
    ("[1]", False), ("", False), ('{"comments":"c"', False), ("null", False), (None, False),
    ('{"comments":"c","extra":{"deep":[1,2]}}', True), ('{"comments":"c"', False),
])
def test_json_is_strict(spark, text, ok):
    (row,) = ingest(spark, "salary", text)
    assert row.valid is ok and (row.record is None) != ok


def test_salary(spark):
    rows = ingest(spark, "salary", {"min": "5", "max": 3.0, "comments": "c"}, {"min": 3.7, "comments": "c"},
                  {"min": None, "comments": "c", "currency": "EUR"}, {"currency": None, "comments": "c"}, {"min": 1})
    assert [r.valid for r in rows] == [True, False, True, False, False]
    assert tuple(rows[0].record) == (5, 3, "USD", "c")
    assert tuple(rows[2].record) == (None, None, "EUR", "c")


def test_bias(spark):
    finding = {"category": "Age", "finding": "x", "suggestion": "y"}
    rows = ingest(spark, "bias", {}, {"findings": None}, {"biasDetected": True, "findings": [finding]},
                  {"findings": [{"category": "Age"}]}, {"biasDetected": "perhaps"})
    assert [r.valid for r in rows] == [True, False, True, False, False]
    assert rows[0].record.biasDetected is False and rows[0].record.findings == []
    assert rows[2].record.findings[0].finding == "x"


def test_career(spark):
    rows = ingest(spark, "career", {"comments": "c"}, {"comments": "c", "suggestedNextRoles": None}, {"suggestedNextRoles": ["a"]},
                  {"comments": "c", "improvementAreas": ["a", "b"]})
    assert [r.valid for r in rows] == [True, False, False, True]
    assert rows[0].record.suggestedNextRoles == [] and rows[3].record.improvementAreas == ["a", "b"]


def test_record_required_fields_and_defaults(spark):
    rows = ingest(
        spark, "parse", {}, NAME, {"personalInfo": {"name": {"first": "A"}}},
        {"experience": [{"title": "t", "company": "c"}, {"title": "t"}]},
        {"experience": [{"title": "t", "company": "c", "achievements": ["x"]}], "education": [{"degree": "d", "institution": "i", "gpa": "3.5"}]},
        {"skills": {"technical": [{"category": "c"}]}}, {"skills": {"technical": [{"category": "c", "items": None}]}},
        {"certifications": [{"name": "n", "issue_date": "2020", "expiryDate": "2022"}]}, {"certifications": [{"issuer": "n"}]},
        {"experience": None}, {"education": [{"degree": "d", "institution": "i", "gpa": "good"}]},
    )
    assert [r.valid for r in rows] == [True, True, False, False, True, True, False, True, False, True, False]
    assert rows[0].record.experience == [] and rows[0].record.skills is None and rows[0].record.certifications == []
    role = rows[4].record.experience[0]
    assert role.current is False and role.achievements == ["x"] and role.technologies == []
    assert rows[4].record.education[0].gpa == 3.5
    assert rows[5].record.skills.technical[0]["items"] == [] and rows[5].record.skills.soft == []
    assert rows[7].record.certifications[0].issueDate == "2020" and rows[7].record.certifications[0].expiryDate == "2022"
    assert rows[9].record.experience is None


def test_scores_inside_a_parse_answer(spark):
    scores = {"qualityScore": "85", "completenessScore": 90.0, "industryFit": {"technology": 0.9, "finance": 1}}
    rows = ingest(spark, "parse", NAME | {"aiEnhancements": scores}, NAME | {"aiEnhancements": {"qualityScore": "high"}}, NAME,
                  NAME | {"aiEnhancements": {"industryFit": {"x": "much"}}})
    assert [r.valid for r in rows] == [True, False, True, False]
    e = rows[0].record.aiEnhancements
    assert (e.qualityScore, e.completenessScore, e.suggestions, e.industryFit) == (85, 90, [], {"technology": 0.9, "finance": 1.0})
    assert rows[2].record.aiEnhancements is None
    landed = spark.createDataFrame([("a", "parse", 1, json.dumps(NAME | {"aiEnhancements": scores})), ("a", "anonymize", 1, "{}")],
                                   "id string, kind string, attempt int, response string")
    row = responses.apply_failure_policy(landed).first()
    assert row.ai_enhancements.qualityScore == 85 and row.ai_enhancements.anonymizedData is not None
    assert "aiEnhancements" not in row.structured_data.asDict()


def match_answer(**changes):
    part = {"score": 80, "weight": "20", "details": {"a": 1, "b": [1, 2]}}
    parts = schemas.RAW_RESPONSE["match"]["matchingResults"].dataType["categoryScores"].dataType.names
    answer = {
        "matchId": "0b8f2c9e-7a11-4b5e-9a64-3b5d1c2e4f60", "resumeId": "0b8f2c9e-7a11-4b5e-9a64-3b5d1c2e4f61", "jobTitle": "t",
        "matchingResults": {
            "overallScore": 80.0, "confidence": 0.9, "recommendation": "Strong Match", "categoryScores": {p: part for p in parts},
            "gapAnalysis": {"improvementAreas": [
                {"category": "s", "missing": "one", "impact": "low", "suggestion": "x"},
                {"category": "s", "missing": ["one", "two"], "impact": "low", "suggestion": "x"}]},
            "salaryAlignment": {"candidateExpectation": "1", "jobSalaryRange": "2", "alignment": "unknown"},
        },
        "explanation": {"summary": "s"},
        "metadata": {"matchedAt": "2025-09-10T10:45:00Z", "processingTime": 1.5, "algorithm": "a"},
    }
    answer.update(changes)
    return answer


def test_match(spark):
    rows = ingest(spark, "match", match_answer(), match_answer(matchId="no uuid"), match_answer(explanation={}),
                  match_answer(metadata={"matchedAt": "soon", "processingTime": 1, "algorithm": "a"}))
    assert [r.valid for r in rows] == [True, False, False, True]
    m = rows[0].record.matchingResults
    assert m.overallScore == 80 and m.categoryScores.skillsMatch.weight == 20
    assert [a.missing for a in m.gapAnalysis.improvementAreas] == [["one"], ["one", "two"]]
    assert str(rows[0].record.metadata.matchedAt) == "2025-09-10 10:45:00"
    assert str(rows[3].record.metadata.matchedAt) == "2024-03-01 00:00:00"


def test_failure_policy(spark):
    good = json.dumps(NAME)
    rows = [
        ("a", "parse", 1, good), ("a", "salary", 1, "broken"), ("a", "career", 1, '{"comments":"c"}'),
        ("b", "parse", 1, "broken"), ("b", "career", 1, '{"comments":"c"}'),
        ("c", "parse", 1, "broken"), ("c", "parse", 2, good),
        ("d", "career", 1, '{"comments":"c"}'),
    ]
    out = responses.apply_failure_policy(spark.createDataFrame(rows, "id string, kind string, attempt int, response string"))
    got = {r.id: r for r in out.collect()}
    assert {k: r.processing_status for k, r in got.items()} == {"a": "completed", "b": "ai_failed", "c": "completed", "d": "ai_failed"}
    blocks = got["a"].ai_enhancements
    assert blocks.salaryEstimate is None and blocks.careerProgression.comments == "c" and blocks.qualityScore is None
    assert got["b"].ai_enhancements is None and got["c"].structured_data.personalInfo.name.full == "A B"


def test_echoed_keys_come_from_the_inputs(spark):
    raw = F.from_json(F.lit(json.dumps(match_answer(resumeId="wrong", company="wrong"))), schemas.RAW_RESPONSE["match"])
    answers = spark.range(1).select(
        F.lit("m").alias("match_id"), raw.alias("raw"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("started_at"),
        F.lit("2024-01-01 00:00:02.5").cast("timestamp").alias("finished_at"))
    inputs = spark.createDataFrame([("m", "r1", "Clerk", None)], "match_id string, resume_id string, job_title string, company string")
    r = responses.override_echoed(answers, inputs).first().raw
    assert (r.resumeId, r.jobTitle, r.company, r.metadata.processingTime) == ("r1", "Clerk", None, "2.5")


def test_every_leaf_is_checked(spark):
    """Each text of a whole answer in turn as a number, each list as a text, each object as a list."""
    import copy

    whole = {
        "personalInfo": {"name": {"first": "A", "full": "A B"}, "contact": {"email": "e", "address": {"city": "c"}}}, "summary": {"text": "t"},
        "experience": [{"title": "t", "company": "c", "location": "l", "achievements": ["a"], "technologies": ["b"]}],
        "education": [{"degree": "d", "institution": "i", "honors": ["h"]}], "skills": {"technical": [{"category": "c", "items": ["x"]}], "soft": ["s"], "languages": [{"language": "l"}]},
        "certifications": [{"name": "n", "issuer": "i", "expiry_date": "2020"}], "aiEnhancements": {"suggestions": ["s"], "industryFit": {"x": 0.5}},
    }

    def paths(value, at=()):
        if isinstance(value, dict):
            yield at
            for k, v in value.items():
                yield from paths(v, (*at, k))
        elif isinstance(value, list):
            yield at
            for k, v in enumerate(value):
                yield from paths(v, (*at, k))
        elif isinstance(value, str):
            yield at

    spoilt = []
    for path in [p for p in paths(whole) if p]:
        answer = copy.deepcopy(whole)
        holder = answer
        for step in path[:-1]:
            holder = holder[step]
        old = holder[path[-1]]
        holder[path[-1]] = 5 if isinstance(old, str) else "text" if isinstance(old, list) else [old]
        spoilt.append(answer)
    rows = ingest(spark, "parse", whole, *spoilt)
    assert rows[0].valid and len(spoilt) > 35 and not any(r.valid for r in rows[1:])


def test_a_text_is_parsed_once(spark):
    """One parse to VARIANT in the plan of a kind; the second one stands in the branch for repeated keys."""
    df = spark.createDataFrame([(1, "{}")], "id int, response string")
    for kind in schemas.RESPONSE:
        plan = responses.ingest_responses(df, kind)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson(concat([") == 1 and plan.count("parseJson(") == 2, kind


def test_nothing_can_end_the_text_early(spark):
    rows = ingest(spark, "career", '{"comments":"c"},"1"] {}', '{"comments":"c"}]', '{"comments":"c"', '{"comments":"c"},{"comments":"d"}', ' {"comments":"c"} ', '{"comments":"a\\u0022}"}')
    assert [r.valid for r in rows] == [False, False, False, False, True, True]


def test_objects_are_looked_up_by_path_only_where_the_form_lacks_them(spark):
    """Every object and list of an answer was looked up by its path again; now only what could not be read in its form."""
    finding = {"category": "Age", "finding": "x", "suggestion": "y"}
    rows = ingest(spark, "bias", {"findings": [finding]}, {"findings": {}}, {"findings": []}, {"findings": [1]}, {"findings": [finding, None]}, {"findings": "x"}, {"findings": [[finding]]})
    assert [r.valid for r in rows] == [True, False, True, False, False, False, False]
    rows = ingest(spark, "parse", NAME, {"personalInfo": []}, {"personalInfo": None}, {"personalInfo": {"name": []}}, {"skills": {"technical": {}}}, {"skills": 5}, {"summary": {}})
    assert [r.valid for r in rows] == [True, False, True, False, False, False, True]
    df = responses.parse_json(spark.createDataFrame([("{}",)], "response string"), "bias")
    plan = df.select(responses._well_formed("bias", F.col("answer")))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN isnotnull(lambda" in plan and plan.index("CASE WHEN isnotnull(lambda") < plan.index("$.findings")
