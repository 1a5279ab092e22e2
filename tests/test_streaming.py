import datetime as dt

import pytest
from pyspark.sql import functions as F

from talentloom.operators import progress, records
from talentloom.plans import batch
from talentloom.plans.views import Tables
from talentloom.sources import uploads
from talentloom.streaming import intake, status

SF = "/root/testdata/sf0.001"


def run(stream, tmp_path, name, mode):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert q.exception() is None and not q.isActive
    return stream.sparkSession.table(name)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The status events as several files, newest first."""
    root = str(tmp_path_factory.mktemp("events"))
    table = Tables(spark, SF).batch_events_v().join(Tables(spark, SF).events.select("event_id", "user_id"), "event_id")
    table.orderBy(F.desc("ts")).repartitionByRange(5, F.desc("ts")).write.mode("overwrite").parquet(root)
    return root, table.schema, table


def stream(spark, parts):
    return status.read_status(spark, parts[0], parts[1], 1)


def test_status_stream_equals_batch(spark, parts, tmp_path):
    out = run(status.stream_status(stream(spark, parts)), tmp_path, "status_out", "complete")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, records.latest_status(parts[2]).collect()))


def test_progress_stream_equals_batch(spark, parts, tmp_path):
    out = run(status.stream_bulk_progress(stream(spark, parts), delay="3650 days"), tmp_path, "progress_out", "update")
    names = ["batch", "total", "completed", "failed", "processing", "progress", "status"]
    last = out.groupBy("batch").agg(F.max_by(F.struct(*names[1:]), "n_events").alias("r")).select("batch", "r.*").select(names)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, progress.bulk_progress(parts[2]).select(names).collect()))


def test_quota_stream_equals_batch(spark, parts, tmp_path):
    out = run(status.stream_quota_audit(stream(spark, parts), limit=1, delay="60 days"), tmp_path, "quota_out", "update")
    latest = out.groupBy("user_id", "hour").agg(F.max("n").alias("n"))
    want = progress.quota_audit(parts[2].withColumn("ts", F.col("ts").cast("timestamp")), limit=1)
    got = sorted(map(tuple, latest.collect()))
    assert got and got == sorted(map(tuple, want.collect()))


def test_status_changes_equal_batch(spark, parts, tmp_path):
    out = run(status.stream_status_changes(stream(spark, parts), delay="3650 days"), tmp_path, "changes_out", "update")
    last = out.groupBy("resume_id").agg(F.max_by(F.struct("status", "ts", "event_id"), F.struct("ts", "event_id")).alias("r")).select("resume_id", "r.status", "r.ts")
    want = records.latest_status(parts[2]).select("resume_id", "status", F.col("ts").cast("timestamp").alias("ts"))
    assert out.count() >= last.count() > 0 and sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("kind", ["changes", "progress"])
def test_keyed_state_ends_with_the_watermark(spark, tmp_path, kind):
    root, cp, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
    t0 = dt.datetime(2024, 1, 1)
    schema = "batch bigint, resume_id bigint, ts timestamp, event_id bigint, status string"

    def write(*rows):
        df = spark.createDataFrame([(b, r, t0 + dt.timedelta(seconds=s), n, x) for b, r, s, n, x in rows], schema)
        df.coalesce(1).write.mode("append").parquet(root)

    def go():
        events = status.read_status(spark, root, schema, 1)
        made = status.stream_status_changes(events, "60 seconds", "10 seconds") if kind == "changes" else status.stream_bulk_progress(events, "60 seconds")
        q = (made.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(out)).option("checkpointLocation", cp).outputMode("update")
             .trigger(availableNow=True).start())
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive

    def state(name):
        held = spark.read.format("statestore").option("path", cp).option("stateVarName", name).load()
        return {r.key[0] for r in held.collect()}

    name, first, later = ("newest", {1, 2, 3}, {9}) if kind == "changes" else ("counts", {1, 2}, {3})
    write((1, 1, 0, 1, "processing"), (1, 2, 1, 2, "processing"), (2, 3, 2, 3, "processing"))
    go()
    assert state(name) == first
    write((1, 1, 20, 5, "completed"), (1, 1, 10, 4, "ai_processing"), (1, 2, 1, 1, "ai_failed"))  # the last one is older than what is known
    go()
    write((3, 9, 500, 6, "processing"))
    go()
    write((3, 9, 501, 7, "completed"))
    go()
    assert state(name) == later
    rows = spark.read.parquet(out).collect()
    if kind == "changes":
        assert sorted((r.resume_id, r.status) for r in rows) == [(1, "completed"), (1, "processing"), (2, "processing"), (3, "processing"), (9, "completed"), (9, "processing")]
    else:
        assert sorted((r.batch, r.n_events, r.total, r.completed, r.failed) for r in rows) == [
            (1, 2, 2, 0, 0), (1, 5, 2, 1, 0), (2, 1, 1, 0, 0), (3, 1, 1, 0, 0), (3, 2, 1, 1, 0)]


def test_stuck_alert(spark, tmp_path):
    root = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1)

    def write(*rows):
        df = spark.createDataFrame([(r, t0 + dt.timedelta(seconds=s), x) for r, s, x in rows], "resume_id bigint, ts timestamp, status string")
        df.coalesce(1).write.mode("append").parquet(root)
        return df.schema

    schema = write((1, 0, "processing"), (2, 0, "processing"), (3, 5, "processing"))
    events = status.read_status(spark, root, schema, 1)

    def go():
        q = (status.stream_stuck(events, 120).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive

    go()
    write((2, 60, "completed"), (3, 70, "ai_processing"))
    go()
    write((2, 55, "ai_processing"), (8, 62, "completed"))  # older than the final status of 2
    go()
    write((9, 4000, "completed"))
    go()
    write((9, 4001, "completed"))
    go()
    write((1, 4002, "ai_processing"), (9, 4200, "completed"))  # 1 was told already
    go()
    write((9, 4400, "completed"))
    go()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.resume_id, r.status) for r in out) == [(1, "processing"), (3, "ai_processing")]


def test_intake_stream_equals_batch_and_runs_once_per_file(spark, tmp_path):
    up, out, cp = tmp_path / "up", str(tmp_path / "records"), str(tmp_path / "cp")
    up.mkdir()
    for i in range(6):
        (up / f"cv{i}.txt").write_text(f"person {i}")
    (up / "scan.pdf").write_bytes(b"%PDF")

    def go():
        q = intake.stream_intake(spark, str(up), out, cp, files_per_trigger=3)
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive

    go()
    go()  # nothing new
    (up / "late.html").write_text("later")
    go()
    cols = ["id", "file_name", "processing_status", "raw_text", "route"]
    got = spark.read.parquet(out).select(cols).collect()
    want = batch.intake_plan(uploads.scan_uploads(spark, str(up)), "2024-01-01").select(cols).collect()
    assert len(got) == 8 and sorted(map(str, got)) == sorted(map(str, want))


def test_same_row_twice_counts_once(spark, tmp_path):
    root = str(tmp_path / "rows")
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    rows.coalesce(1).write.parquet(root)
    rows.coalesce(1).write.mode("append").parquet(root)
    s = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(root).withColumn("uploaded_at", F.current_timestamp())
    out = run(intake.dedup_stream(s, ["id"]).select("id"), tmp_path, "dedup_out", "append")
    assert sorted(r.id for r in out.collect()) == ["a", "b"]


def test_checkpoint_folder_comes_from_the_session(spark):
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        assert intake.checkpoint_root(spark) == given.rstrip("/")
    else:
        with pytest.raises(ValueError):
            intake.checkpoint_root(spark)


def test_dedup_query_runs_the_streams_operator(spark, monkeypatch):
    import __spark_entry__

    query = __spark_entry__.queries()["r2_dedup_rows"]
    once = query(spark, "/root/testdata/sf0.001").count()
    monkeypatch.setattr(intake, "dedup_rows", lambda df, keys: df)  # an operator that keeps everything
    assert query(spark, "/root/testdata/sf0.001").count() == 2 * once
