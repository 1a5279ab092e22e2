"""Résumé texts in several layouts: with rules, with headings by name or in capitals, several entries a section."""

import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from samples import RESUME
from talentloom import schemas
from talentloom.operators.extraction import structure_resumes
from talentloom.operators.intake import create_records
from talentloom.plans import batch
from talentloom.sources import records_json

AS_OF = "2024-02-01"


def headed(change):
    """The sample with each ruled heading written another way."""
    return re.sub(r"---\n([^\n]+)\n---\n", lambda m: change(m[1]), RESUME)


LAYOUTS = {
    "rules": RESUME,
    "names": headed(lambda h: f"{h}\n"),
    "colons": headed(lambda h: f"  {h.upper()}:\n"),
    "other names": headed(lambda h: {"Work Experience": "Employment History", "Professional Summary": "PROFILE"}.get(h, h) + "\n"),
    "capitals": headed(lambda h: h.upper() + "\n"),
}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(list(LAYOUTS.items()), "id string, raw_text string")
    return {r.id: r.structured_data for r in structure_resumes(df, AS_OF).select("id", "structured_data").collect()}


@pytest.mark.parametrize("layout", list(LAYOUTS))
def test_every_layout_reads_alike(docs, layout):
    assert docs[layout] == docs["rules"]
    doc = docs[layout]
    assert [e.title for e in doc.experience] == ["Senior Data Engineer", "Data Engineer"]
    assert [e.institution for e in doc.education] == ["University of Leeds"]
    assert len(doc.skills.technical) == 3 and [x.language for x in doc.skills.languages] == ["Swedish", "English"]
    assert [c.name for c in doc.certifications] == ["Certified Data Architect"] and doc.summary.text.startswith("Senior data engineer")


def test_addresses_and_programming_languages(spark):
    rows = {"12 Oak St, Austin, TX 78701": ("12 Oak St", "Austin", "TX", "78701", None), "Austin, TX": (None, "Austin", "TX", None, None),
            "Lyon, France": (None, "Lyon", None, None, "France"), "7 Quay, Cork, T12 X70A, Ireland": ("7 Quay", "Cork", None, "T12 X70A", "Ireland")}
    texts = [(p, f"Ann Doe\n\n{p} | ann@post.example.org\n\nSkills\n\n- Languages: Python, SQL\n- Spoken languages: Klingon\n") for p in rows]
    out = structure_resumes(spark.createDataFrame(texts, "id string, raw_text string"), AS_OF).select("id", "structured_data").collect()
    for r in out:
        a = r.structured_data.personalInfo.contact.address
        assert (a.street, a.city, a.state, a.zipCode, a.country) == rows[r.id]
        skills = r.structured_data.skills
        assert [(t.category, t["items"]) for t in skills.technical] == [("Languages", ["Python", "SQL"])]
        assert [x.language for x in skills.languages] == ["Klingon"]


def test_pages_come_back_and_are_enriched(spark):
    files = spark.createDataFrame([("/up/a.pdf", "a.pdf", 10), ("/up/b.pdf", "b.pdf", 10), ("/up/c.txt", "c.txt", 10)], "path string, file_name string, file_size long")
    base = create_records(files.withColumn("file_type", F.lit("application/pdf")), AS_OF)
    for name in batch.RECORD_COLUMNS:
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast({"processed_at": "timestamp"}.get(name, "string")))
    base = base.withColumn("route", F.when(F.col("file_name") == "c.txt", "text").otherwise("external_text")).select(batch.RECORD_COLUMNS)
    ids = {r.file_name: r.id for r in base.collect()}
    half = RESUME.index("Work Experience")
    pages = spark.createDataFrame([(ids["a.pdf"], 1, RESUME[half:]), (ids["a.pdf"], 0, RESUME[:half].rstrip("\n")), (ids["b.pdf"], 0, "scan"), (ids["c.txt"], 0, RESUME)],
                                  "doc_id string, page_no int, page_text string")
    back = batch.return_plan(base, pages, AS_OF)
    state = {r.file_name: (r.processing_status, r.raw_text is not None) for r in back.records.collect()}
    assert state == {"a.pdf": ("ai_processing", True), "b.pdf": ("processing", False), "c.txt": ("processing", False)}
    assert [r.file_name for r in back.ocr.collect()] == ["b.pdf"]
    done = {r.file_name: r for r in batch.enrich_plan(back.records, AS_OF).collect()}
    assert done["a.pdf"].processing_status == "completed" and len(done["a.pdf"].structured_data.experience) == 2
    again = batch.return_plan(back.records, spark.createDataFrame([(ids["b.pdf"], 0, "scan")], "doc_id string, page_no int, page_text string"), AS_OF, seen=True)
    assert {r.file_name: r.processing_status for r in again.records.collect()}["b.pdf"] == "ai_processing" and again.ocr.count() == 0


@pytest.mark.parametrize("kind", sorted(schemas.RESPONSE))
def test_prompts_name_what_is_required(kind):
    shape = json.loads(records_json.prompt_head(kind).split("Schema:\n")[1].split("\nInput:")[0])
    for path, fields in schemas.REQUIRED[kind].items():
        at = shape
        for part in [p for p in path.split(".") if p]:
            at = at["properties"][part]
            at = at.get("items", at)
        assert at["required"] == fields and set(fields) <= set(at["properties"])
    if kind == "match":
        assert shape["properties"]["matchingResults"]["properties"]["overallScore"]["type"] == "integer"


def filters_reading(spark, name):
    """The filters of a query that make entries, by its plan."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Filter .*size\(transform.*", plan)


def test_entries_of_work_are_read_once(spark):
    assert not filters_reading(spark, "s14_layout_roles")


def test_entries_of_school_are_read_once(spark):
    assert not filters_reading(spark, "s15_layout_degrees")
