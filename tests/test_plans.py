"""Properties every registered query and the library source must keep."""

import pathlib
import re

import pytest

import __spark_entry__ as entry
from oracle import compare, duck
from talentloom.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(entry.__file__).parent
#: The docx reader, and the dynamic program over the lines of résumé texts (one Arrow function, numbers in and states out).
PYTHON_ALLOWED = {"io06_extract_docx", "r1_intake_plan"} | {
    "s12_split_sections", "s13_extract_contact", "s14_extract_experience", "s15_extract_education", "s16_extract_skills", "s17_extract_certs",
    "s13_layout_contact", "s14_layout_roles", "s15_layout_degrees", "s16_layout_skills", "s17_layout_certs", "s19_quality_scores", "enriched_records"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    run = fn(spark, SF)._jdf.queryExecution()
    assert "Relation" in run.analyzed().toString()
    plan = run.executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in plan
    assert ("InPandas" in plan or "ArrowEval" in plan) == (name in PYTHON_ALLOWED)
    problem = compare(spark, con, SF, fn, sql)
    if problem == "no rows" and sql is None:
        problem = None
    assert problem is None, problem


def test_source_rules():
    for path in (ROOT / "talentloom").rglob("*.py"):
        if path.parent.name == "llm":  # has tests of its own
            continue
        text = path.read_text()
        for bad in ("localCheckpoint", "crossJoin", "broadcast(", ".collect()", "toPandas", "tempfile", ".rdd.map", "mapPartitions"):
            if (path.name, bad) == ("store.py", ".collect()"):  # a manifest and the buckets of some ids: at most a row a bucket
                assert text.count(bad) == 3
                continue
            assert bad not in text, (path, bad)
        assert not re.search(r"\.limit\(", text) or path.name in ("market.py", "search.py", "records.py"), path


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["resume_id", "job_id", "overall_score", "rank"] and df.count() > 0
