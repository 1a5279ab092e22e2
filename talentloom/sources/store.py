"""Stored record tables: versions on plain Parquet, bucketed tables for joins by id, tables that change by copying the buckets of some ids."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def write_version(records: DataFrame, root: str, version: int) -> str:
    """Write a new version of a record table beside the old ones; an existing version is never touched.

    Rows are laid out by status, so that gates on the status read only their part.
    """
    path = f"{root.rstrip('/')}/version={version}"
    records.write.mode("errorifexists").partitionBy("processing_status").parquet(path)
    return path


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/version={version}")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Save a table cut and sorted by a key: joins of two such tables on the key need no shuffle."""
    writer = df.write.mode("errorifexists").bucketBy(buckets, key).sortBy(key).format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


# ---- changes by copy on write ------------------------------------------------------
#: Buckets of a changing table; also the most rows of a manifest, which the driver reads.
BUCKETS = 256
_BUCKET = "_bucket"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that goes with the session. In a local session without that setting it is in the warehouse; on a
    cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"{(root or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/talentloom-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return folder


def _bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, root: str, version: int, key: str, buckets: int) -> DataFrame:
    """The rows as files of a version, one folder a bucket; (bucket, version) of the folders that have rows."""
    placed = rows.withColumn(_BUCKET, _bucket_of(key, buckets))
    placed.repartition(_BUCKET).write.mode("errorifexists").partitionBy(_BUCKET).parquet(f"{root}/data/version={version}")
    written = rows.sparkSession.read.schema(f"{key} {rows.schema[key].dataType.simpleString()}, {_BUCKET} int").parquet(f"{root}/data/version={version}")
    return written.select(F.col(_BUCKET).alias("bucket")).distinct().withColumn("written", F.lit(version))


def _write_manifest(entries: DataFrame, root: str, version: int, key: str, buckets: int, schema: str) -> int:
    """A version can be read once its manifest stands: which version's folder each bucket is in."""
    facts = entries.withColumn("key", F.lit(key)).withColumn("buckets", F.lit(buckets)).withColumn("schema", F.lit(schema))
    facts.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifests/version={version}")
    return version


def create_store(rows: DataFrame, root: str, key: str = "id", buckets: int = BUCKETS) -> int:
    """Version 0 of a table that changes by ids: rows in hash buckets of the key, and a manifest. A null key is in a bucket like any other."""
    if rows.isEmpty():
        raise ValueError("a stored table begins with rows")
    return _write_manifest(_write_buckets(rows, root, 0, key, buckets), root, 0, key, buckets, rows.schema.json())


def latest_version(spark: SparkSession, root: str) -> int:
    return spark.read.schema("version int").option("basePath", f"{root}/manifests").parquet(f"{root}/manifests").agg(F.max("version")).first()[0]


def _manifest(spark: SparkSession, root: str, version: int) -> list:
    return spark.read.parquet(f"{root}/manifests/version={version}").collect()  # a row a bucket


def _read_buckets(spark: SparkSession, root: str, entries: list) -> DataFrame:
    schema = StructType.fromJson(json.loads(entries[0]["schema"]))
    paths = [f"{root}/data/version={e['written']}/{_BUCKET}={e['bucket']}" for e in entries if e["written"] is not None]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_store(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the latest one if none is named."""
    return _read_buckets(spark, root, _manifest(spark, root, latest_version(spark, root) if version is None else version))


def change_store(spark: SparkSession, root: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
    """A new version in which ``change`` was applied to the buckets of some ids; the other buckets stay where they are.

    ``change`` is any operator from records to records that touches, adds or removes only rows of the given ids (a column named like the key). Its
    work and what is written grow with the buckets of the ids, not with the table. Older versions stay readable. One writer at a time: a version that
    another one has written is an error.
    """
    before = latest_version(spark, root)
    entries = _manifest(spark, root, before)
    key, buckets, schema = entries[0]["key"], entries[0]["buckets"], entries[0]["schema"]
    touched = {r[0] for r in ids.select(_bucket_of(key, buckets)).distinct().collect()}  # at most a row a bucket
    held = [e for e in entries if e["bucket"] in touched]
    rows = _read_buckets(spark, root, held or [dict(entries[0].asDict(), written=None)])
    changed = change(rows).select(*[f.name for f in rows.schema.fields])
    written = {r["bucket"]: r["written"] for r in _write_buckets(changed, root, before + 1, key, buckets).collect()}
    if not set(written) <= touched:
        raise ValueError("the change reached rows of other ids than the given ones")
    kept = {e["bucket"]: e["written"] for e in entries if e["bucket"] is not None and e["bucket"] not in touched}
    lines = sorted((kept | written).items()) or [(None, None)]
    manifest = spark.createDataFrame(lines, "bucket int, written int")
    return _write_manifest(manifest, root, before + 1, key, buckets, schema)
