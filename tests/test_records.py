import pytest
from pyspark.sql import functions as F

from talentloom import schemas
from talentloom.operators import records
from talentloom.sources import records_json

NOW = "2024-03-01"


def doc(full=None, city=None, roles=None, skills=None):
    out = {f: None for f in schemas.DOC.names}
    if full or city:
        out["personalInfo"] = {"name": {"full": full}, "contact": {"address": {"city": city}}}
    if roles is not None:
        out["experience"] = [dict.fromkeys(schemas.ROLE.names) | r for r in roles]
    if skills:
        out["skills"] = skills
    return out


def table(spark, *rows):
    base = dict.fromkeys(schemas.RESUMES.names) | {"file_name": "cv.pdf", "file_size": 1, "file_type": "application/pdf"}
    return spark.createDataFrame([base | r for r in rows], schemas.RESUMES)


@pytest.fixture(scope="module")
def stored(spark):
    return table(
        spark,
        {"id": "a", "processing_status": "completed", "structured_data": doc("Ann", "Rome", [{"title": "t", "company": "c", "location": "x"}])},
        {"id": "b", "processing_status": "completed"},
        {"id": "c", "processing_status": "parse_failed"},
        {"id": "d", "processing_status": None},
    )


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id string")


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_gates(spark, stored):
    out = by_id(records.retrieve(stored, ids(spark, "a", "b", "c", "d", "zz")))
    assert {k: r.outcome for k, r in out.items()} == {"a": "ok", "b": "ok", "c": "not_ready", "d": "not_ready", "zz": "not_found"}
    assert out["c"].status == "parse_failed" and out["c"].file_name is None and out["a"].structured_data is not None
    assert {r.id for r in records.ready_for_match(stored).collect()} == {"a"}


def test_assembly(stored):
    out = by_id(records.assemble_record(stored))
    assert out["a"].personalInfo.name.full == "Ann" and out["a"].education == [] and out["a"].skills is None
    assert out["b"].personalInfo is None and out["b"].experience == [] and out["b"].aiEnhancements is None


def test_sections(stored):
    records_ = records.assemble_record(stored)
    assert records.select_sections(records_, ["skills", "metadata"]).columns == ["id", "metadata", "skills"]
    with pytest.raises(ValueError):
        records.select_sections(records_, ["secrets"])


def test_analytics_reads_two_columns(stored, capsys, tmp_path, spark):
    path = str(tmp_path / "r")
    stored.write.parquet(path)
    records.resume_analytics(spark.read.parquet(path), ids(spark, "a")).select("id", "status", "ai_enhancements.qualityScore").explain()
    plan = capsys.readouterr().out
    schema = plan.split("ReadSchema:")[1]
    assert "raw_text" not in schema and "structured_data" not in schema and "anonymizedData" not in schema.split("\n")[0]


def test_patch_changes_only_what_is_given(spark, stored):
    patches = spark.createDataFrame([
        ("a", doc(city="Oslo", roles=[{"title": "t", "company": "c", "description": "new"}, {"title": "t2", "company": "c"}])),
        ("zz", doc("Nobody")),
    ], schemas.obj(id=schemas.S, structured_data=schemas.DOC))
    out = by_id(records.patch_records(stored, patches, NOW))
    d = out["a"].structured_data
    assert d.personalInfo.name.full == "Ann" and d.personalInfo.contact.address.city == "Oslo"
    assert [(e.title, e.location, e.description) for e in d.experience] == [("t", "x", "new"), ("t2", None, None)]
    assert out["a"].processed_at is not None and out["b"].processed_at is None and set(out) == set("abcd")


def test_overwrite_replaces_the_whole_record(spark, stored):
    updates = spark.createDataFrame([("a", doc(city="Oslo")), ("c", doc("Cid")), ("zz", doc("Nobody"))],
                                    schemas.obj(id=schemas.S, structured_data=schemas.DOC))
    out = by_id(records.overwrite_records(stored, updates, NOW))
    assert out["a"].structured_data.personalInfo.name.full is None and out["a"].structured_data.experience is None
    assert out["c"].processing_status == "completed" and out["c"].ai_enhancements is None and set(out) == set("abcd")
    assert by_id(records.overwrite_outcome(stored, updates))["zz"].outcome == "not_found"


def test_delete(spark, stored):
    gone = records.delete_records(stored, ids(spark, "a", "zz"))
    assert {r.id for r in gone.remaining.collect()} == set("bcd")
    assert [tuple(r) for r in gone.files.collect()] == [("a", "a.pdf")]
    told = by_id(records.delete_outcome(stored, ids(spark, "a", "zz")))
    assert told["a"].message == "Resume deleted successfully" and told["zz"].message == "Resume not found"
    assert by_id(records.lookup_status(gone.remaining, ids(spark, "a")))["a"].outcome == "not_found"


def test_status_change_keeps_text_unless_given(spark, stored):
    change = spark.createDataFrame([("c", "ai_failed"), ("zz", "completed")], "id string, status string")
    out = records.advance_status(stored.withColumn("raw_text", F.lit("t")), change, NOW)
    rows = by_id(out.resumes)
    assert rows["c"].processing_status == "ai_failed" and rows["c"].raw_text == "t" and rows["c"].processed_at is not None
    assert rows["a"].processed_at is None and [r.id for r in out.status_events.collect()] == ["c"]


def test_matches(spark):
    m = spark.createDataFrame([("m1", "pending", None, None), ("m2", "completed", None, None), ("m3", "pending", None, None)],
                              "id string, status string, match_result string, completed_at timestamp")
    res = spark.createDataFrame([("m1", '{"x":1}', None), ("m3", None, 'said "no"'), ("zz", "{}", None)],
                                "match_id string, result string, error string")
    done = records.complete_matches(m, res, NOW)
    rows = by_id(done)
    assert rows["m1"].status == "completed" and rows["m3"].status == "failed" and rows["m3"].match_result == '{"error":"said \\"no\\""}'
    assert rows["m2"].completed_at is None and set(rows) == {"m1", "m2", "m3"}
    out = by_id(records.retrieve_match(done, ids(spark, "m1", "m2", "m3", "zz")), "match_id")
    assert {k: r.outcome for k, r in out.items()} == {"m1": "ok", "m2": "no_result", "m3": "not_ready", "zz": "not_found"}


def test_merge_block_keeps_records_without_one(spark, stored):
    blocks = spark.createDataFrame([("a", (1, 2, "USD", "c"))], schemas.obj(id=schemas.S, block=schemas.SALARY_ESTIMATE))
    out = by_id(records.merge_block(stored, "salaryEstimate", blocks))
    assert out["a"].ai_enhancements.salaryEstimate.max == 2 and out["b"].ai_enhancements is None


def test_json_round_trip(stored):
    back = records_json.from_record_json(records_json.to_record_json(stored))
    assert sorted(map(str, back.collect())) == sorted(map(str, stored.collect()))
    text = records_json.to_record_json(stored).filter("id = 'a'").first().structured_data
    assert '"skills":null' in text


def test_foreign_keys(spark):
    m = spark.createDataFrame([("m1", "a"), ("m2", "gone")], "id string, resume_id string")
    keys = records.fk_violations(m, ids(spark, "a", "b"), ids(spark, "a", "b"))
    assert [r.id for r in keys.blocked.collect()] == ["a"] and [r.id for r in keys.orphans.collect()] == ["m2"]
    cascade = records.fk_violations(m, ids(spark, "a", "b"), ids(spark, "a", "b"), cascade=True)
    assert cascade.blocked.count() == 0 and [r.id for r in cascade.matches_left.collect()] == ["m2"]


def test_versions(spark):
    ai = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x")], "id string, version int, v string")
    manual = spark.createDataFrame([("a", 1, "y", "ed"), ("b", 4, "y", "ed")], "id string, version int, v string, editor string")
    out = by_id(records.merge_versions(ai, manual))
    assert (out["a"].v, out["a"].editor, out["b"].v, out["b"].editor) == ("y", "ed", "x", None)
