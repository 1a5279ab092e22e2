import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from talentloom.operators import market, records
from talentloom.plans.views import Tables
from talentloom.sources import store


def test_versions_and_status_pruning(spark, tmp_path, capsys):
    rows = Tables(spark, "/root/testdata/sf0.001").stored_resumes_v().withColumn(
        "processing_status", F.coalesce("processing_status", F.lit("processing")))
    root = str(tmp_path / "resumes")
    store.write_version(rows, root, 1)
    first = store.read_version(spark, root, 1)
    ids = first.select("id").limit(10)
    store.write_version(records.delete_records(first, ids).remaining, root, 2)
    assert store.read_version(spark, root, 2).count() == rows.count() - 10
    assert first.count() == rows.count()
    with pytest.raises(AnalysisException):
        store.write_version(rows, root, 1)
    records.ready_for_match(first).select("id").explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(processing_status" in plan and "raw_text" not in plan.split("ReadSchema")[1]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    resumes = t.stored_resumes_v().select("id", "file_name")
    matches = t.stored_matches_v().select("id", "resume_id", "status")
    store.save_bucketed(resumes, "b_resumes", "id", 4, str(tmp_path / "r"))
    store.save_bucketed(matches, "b_matches", "resume_id", 4, str(tmp_path / "m"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = records.matches_with_resume(spark.table("b_matches"), spark.table("b_resumes"))
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == matches.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("drop table b_resumes")
        spark.sql("drop table b_matches")


def test_a_change_copies_only_the_buckets_of_its_ids(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows, root = t.stored_resumes_v(), str(tmp_path / "store")
    assert store.create_store(rows, root, buckets=32) == 0
    whole = store.read_store(spark, root)
    assert whole.dtypes == rows.dtypes and sorted(map(str, whole.collect())) == sorted(map(str, rows.collect()))

    def folders(version):
        return {p.name for p in (tmp_path / "store" / "data" / f"version={version}").glob("_bucket=*")}

    ten = spark.createDataFrame([(k,) for k in range(1, 11)], "id long")
    changes = ten.withColumn("status", F.lit("failed"))
    assert store.change_store(spark, root, ten, lambda df: records.advance_status(df, changes, "2024-02-01").resumes) == 1
    assert 0 < len(folders(1)) <= 10 and len(folders(0)) == 32
    want = records.advance_status(rows, changes, "2024-02-01").resumes.select(*rows.columns)
    assert sorted(map(str, store.read_store(spark, root).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, store.read_store(spark, root, 0).collect())) == sorted(map(str, rows.collect()))

    assert store.change_store(spark, root, ten, lambda df: records.delete_records(df, ten).remaining) == 2
    assert len(folders(2)) <= 10 and store.read_store(spark, root).count() == rows.count() - 10
    fresh = rows.limit(3).withColumn("id", F.col("id") + 1_000_000).withColumn("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")))
    fresh = spark.createDataFrame(fresh.collect(), rows.schema)
    assert store.change_store(spark, root, fresh.select("id"), lambda df: df.union(fresh)) == 3
    assert store.read_store(spark, root).count() == rows.count() - 7 and len(folders(3)) <= 3
    with pytest.raises(ValueError, match="other ids"):
        store.change_store(spark, root, ten.limit(1), lambda df: df.union(rows))


def test_a_store_can_lose_all_its_rows(spark, tmp_path):
    rows, root = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, x string"), str(tmp_path / "store")
    store.create_store(rows, root, buckets=4)
    store.change_store(spark, root, rows.select("id"), lambda df: df.where("false"))
    assert store.read_store(spark, root).count() == 0 and store.read_store(spark, root, 0).count() == 3
    store.change_store(spark, root, rows.select("id"), lambda df: df.union(rows))
    assert sorted(map(str, store.read_store(spark, root).collect())) == sorted(map(str, rows.collect()))
    with pytest.raises(ValueError, match="begins"):
        store.create_store(rows.where("false"), str(tmp_path / "none"))


def test_sketches_merge_over_days_and_windows(spark, tmp_path):
    days = spark.range(300_000).select(
        (F.col("id") % 3).cast("string").alias("skill"), F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("seen_on"),
        (F.col("id") % 20_011).alias("resume_id"))
    path = str(tmp_path / "sketches")
    market.skill_sketches(days.union(days.limit(0))).write.parquet(path)
    stored = spark.read.parquet(path)
    for frame in ("90d", "1y", "all"):
        exact = {r.skill: r for r in market.skill_trend(days, frame, "2024-11-30").collect()}
        for r in market.sketched_skill_trend(stored, frame, "2024-11-30").collect():
            for name in ("current", "previous"):
                assert abs(r[name] - exact[r.skill][name]) <= 4 * market.SKETCH_ERROR * exact[r.skill][name]
        assert {r.skill for r in market.sketched_top_skills(stored, frame, "2024-11-30", 3).collect()} == set(exact)
    plan = market.sketched_top_skills(stored, "1y", "2024-11-30")._jdf.queryExecution().optimizedPlan().toString()
    assert "resume_id" not in plan
    empty = days.withColumn("skill", F.lit(None).cast("string"))
    assert market.skill_sketches(empty).count() == 0 and market.sketched_top_skills(market.skill_sketches(empty), "1y", "2024-11-30").count() == 0
