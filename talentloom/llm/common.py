"""Shared helpers of the training-data operators: tables, stored steps, hashed words, connected components."""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words a worker remembers with their hashes; beyond it the memory starts anew, results do not change.
REMEMBERED_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. In a local session that names none, as in tests, the warehouse; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or spark.conf.get("spark.sql.warehouse.dir")


#: Folders of the steps that ``concluded`` functions under way have stored, by thread.
_UNDER_WAY = threading.local()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage, survives lost executors, goes when the session ends.

    Shuffle files of the step go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/talentloom-{uuid.uuid4().hex}"
    cleaned = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, cleaned)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if getattr(_UNDER_WAY, "steps", None):
        _UNDER_WAY.steps[-1].append(place)
    return spark.read.schema(df.schema).parquet(path)


def concluded(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of a function that stores steps; the steps go as soon as the result is written, not with the session."""
    _UNDER_WAY.steps = [*getattr(_UNDER_WAY, "steps", []), []]
    try:
        made = make()
    finally:
        *_UNDER_WAY.steps, steps = _UNDER_WAY.steps
    result = stored(made)
    for place in steps:
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return result


def row_key(*columns: str) -> Column:
    """A key of a row by its content: rows of equal key are copies of each other, so repeated or null ids do no harm."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that a frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class WordHashes(dict):
    """64-bit hashes of words as bytes, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xA3B195354A39B70D)
    return values ^ (values >> np.uint64(32))


def batches_of(rows: Iterable, weight, most: int):
    """Lists of neighbouring rows whose weights add up to ``most`` or a single heavier row."""
    held, total = [], 0
    for row in rows:
        size = weight(row)
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append(row)
        total += size
    if held:
        yield held


#: Bytes of rows that a Python task takes up at once.
SLICE_BYTES = 3_000_000


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of some megabytes, so that a task's memory does not hang on the batches it gets."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def give_back() -> None:
    """Hand freed memory of this worker back to the system: workers live on between tasks and operators, and what they keep adds up in an executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What operators keep in a worker from task to task, by operator: how to forget it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """Note that an operator keeps something in this worker until a task of another operator runs there."""
    _KEPT[owner] = forget


def forget_others(owner: str) -> None:
    for other in [o for o in _KEPT if o != owner]:
        _KEPT.pop(other)()


def releasing(run, owner: str = ""):
    """A function of batches that forgets what other operators keep in its worker, and hands its memory back when a task ends."""
    def wrapped(batches):
        forget_others(owner)
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def components(edges: DataFrame) -> DataFrame:
    """Connected components by alternating stars: (a, b) edges of long ids to (node, root) rows, root the smallest id reachable.

    Each round keeps one row per edge and uses only minima, joins and distinct, so a hub of many edges needs no list. Rounds are stored; their
    number grows with the logarithm of the longest path. Self edges and repeated edges do no harm; null ends are dropped.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
