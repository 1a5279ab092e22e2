"""Continuous intake: new files → gates → text → record rows, with the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from talentloom import schemas
from talentloom.plans.batch import intake_plan
from talentloom.sources.uploads import describe_files


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; none is made up here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir, or pass checkpoint=")
    return root.rstrip("/")


def read_uploads(spark: SparkSession, path: str, files_per_trigger: int = 10_000) -> DataFrame:
    """Stream of uploaded files."""
    files = (
        spark.readStream.format("binaryFile").schema(schemas.BINARY_FILE)
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    )
    return describe_files(files)


def dedup_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: of a whole table, or of a stream within its watermark."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def dedup_stream(df: DataFrame, keys: list[str], ts: str = "uploaded_at", delay: str = "1 hour") -> DataFrame:
    """A row delivered again within the delay counts once; older keys are forgotten.

    ``ts`` should be the time of intake: on a time set by the sender, rows older
    than the watermark would be dropped as late.
    """
    return dedup_rows(df.withWatermark(ts, delay), keys)


def stream_intake(spark: SparkSession, path: str, out: str, checkpoint: str | None = None,
                  files_per_trigger: int = 10_000) -> StreamingQuery:
    """Take in all new files below ``path`` and stop; run again for later ones.

    The file sink writes every micro-batch exactly once. State holds ids only.
    """
    records = dedup_stream(intake_plan(read_uploads(spark, path, files_per_trigger), None), ["id"])
    return (
        records.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint or f"{checkpoint_root(spark)}/intake")
        .trigger(availableNow=True).start()
    )
