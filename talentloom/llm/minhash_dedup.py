"""Near-duplicate documents by bottom-k sketches of one hash function, with inverted lists of the retained values.

1. A text becomes the set of 64-bit hashes of its word shingles; the ``KEEP`` least are its sketch (the whole set, if that is smaller). Equal
   sets fold into a class, one member works for all.
2. Inverted lists: retained values that stand side by side in a sketch form runs of ``_run`` values, and each run lists the classes that hold it.
   Of the least values of the union of two similar sets at least four fifths are common; where three common ones follow each other, both sketches
   have the same run. For sets inside a sketch that is certain (``_short`` ones are listed by their subsets), for larger ones at similarity 0.8 the
   chance of no common run among 48 values is about 1e-8. Sets that share little have next to no common run, so frequent shingles make no lists.
3. Stars first: each class is compared with one other class of like size, the one of its lists that is in most lists (of near copies the least
   changed); links found join components. What is left are pairs of one list in different components. Of these only pairs are formed that can be
   similar: shingles that no other class of an open list has are in no common part, which bounds the similarity from above, without error. A group of
   thousands of near copies so costs a pair a class, and few more.
4. Every pair passes the estimate on the sketch of the union (share of common values among its least ``KEEP``), then the exact similarity on full sets.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from talentloom.llm.common import components, concluded, mixed, releasing, row_key, slices, stored, unused, WordHashes

#: Values in a sketch.
KEEP = 48


def shingle_set(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``size`` words; of all words as one, if they are fewer."""
    if not words:
        return np.zeros(0, np.int64)
    size = min(size, len(words))
    single = hashes.of(words)
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + single[k : len(words) - size + 1 + k])
    return np.unique(total.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def _sketches(size: int):
    hashes = WordHashes()

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(words_of(t), size, hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists([s[:KEEP] for s in sets])],
                names=["id", "row", "n", "key", "sketch"])
    return run


def _full_sets(size: int):
    hashes = WordHashes()

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(words_of(t), size, hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), _lists(sets)], names=["row", "members"])
    return run


def _run(percent: int) -> int:
    """Values of a run: as many as common values must follow each other somewhere, at most three."""
    return max(1, min(3, -(-percent // max(1, 100 - percent)) - 1))


def _short(percent: int) -> int:
    """Largest union in which a run may be missing: there similar sets are found by their common subsets."""
    def least_run(union: int) -> int:
        gaps = union - -(-percent * union // 100)
        return -(-(union - gaps) // (gaps + 1))

    return max((u for u in range(1, KEEP + 1) if least_run(u) < _run(percent)), default=0)


def _runs(percent: int):
    """Rows (row, n, value): the runs of each sketch, and the large enough subsets of short sets."""
    size, short = _run(percent), _short(percent)

    def run(batches):
        for batch in slices(batches):
            keys, rows, sizes = [], [], []
            for row, n, sketch in zip(batch.column("row").to_pylist(), batch.column("n").to_pylist(), batch.column("sketch")):
                values = sketch.values.to_numpy().view(np.uint64)
                found = []
                if len(values) >= size:
                    total = np.full(len(values) - size + 1, 7, np.uint64)
                    for k in range(size):
                        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + values[k : len(values) - size + 1 + k])
                    found.append(total)
                if n <= short:
                    least = -(-percent * n // 100)
                    subsets = [c for k in range(max(1, least), n + 1) for c in combinations(values.tolist(), k)]
                    found.append(np.array([xxhash.xxh3_64_intdigest(np.array(c, np.uint64).tobytes()) for c in subsets], np.uint64))
                for part in found:
                    keys.append(part)
                    rows.append(np.full(len(part), row, np.int64))
                    sizes.append(np.full(len(part), n, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(keys).view(np.int64))],
                                                 names=["row", "n", "value"])
    return run


def _likely(a: Column, b: Column, percent: int) -> Column:
    """Estimate on the sketch of the union: at least the share of common values that a similar pair has with near certainty."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, KEEP)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) * 100 >= F.size(union) * (percent - 30)


def _side(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.col("row").alias(name), F.col(value).alias(f"{value}_{name}"))


def _close(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) pairs that pass the estimate."""
    both = pairs.distinct().join(_side(sketches, "a", "sketch"), "a").join(_side(sketches, "b", "sketch"), "b")
    return both.where(_likely(F.col("sketch_a"), F.col("sketch_b"), percent)).select("a", "b")


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar, by the estimate first and then by their full sets."""
    close = stored(_close(pairs, sketches, percent))
    both = close.join(_side(sets, "a", "members"), "a").join(_side(sets, "b", "members"), "b")
    common = F.size(F.array_intersect("members_a", "members_b"))
    return stored(both.where(common * 100 >= (F.size("members_a") + F.size("members_b") - common) * percent).select("a", "b"))


def _placed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists with the component that each class is in so far."""
    joined = components(links).withColumnRenamed("node", "row")
    return lists.join(joined, "row", "left").withColumn("root", F.coalesce("root", "row"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, row, n_shingles, component_id, chosen), one per document.

    Two documents link if 100 times the common shingles are ``percent`` times the shingles of both or more; component_id is the smallest id
    reachable by links. A null or empty text has no shingles and links with nothing. A text of fewer than ``words`` words is one shingle. ``row`` is
    a key of id and text; ``chosen`` is true on the one document of a component that stays (least id, then least key), the same on rows
    repeated whole. Null ids are kept as they are and are smaller than none. Other columns are not read; an empty table gives no rows.
    """
    return concluded(docs.sparkSession, lambda: _grouped(docs, words, percent, id_col, text_col))


def _grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", row_key("id", "text"))
    kind = docs.schema[id_col].dataType.simpleString()
    sketched = stored(keyed.mapInArrow(releasing(_sketches(words)), f"id {kind}, row long, n long, key binary, sketch array<long>"))
    classes = sketched.where("n > 0").groupBy("key").agg(F.min("row").alias("rep"))
    reps = stored(sketched.join(classes.select(F.col("rep").alias("row")).distinct(), "row", "left_semi").where("n > 0")
                  .select("row", "n", "sketch").dropDuplicates(["row"]))

    runs = reps.mapInArrow(releasing(_runs(percent)), "row long, n long, value long")
    often = runs.groupBy("value").agg(F.count("*").alias("times")).where("times > 1").select("value")
    lists = stored(runs.join(often, "value"))

    sets = stored(keyed.select("text", "row").join(lists.select("row").distinct(), "row", "left_semi").mapInArrow(
        releasing(_full_sets(words)), "row long, members array<long>"))

    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) / 2))
    banded = lists.join(lists.groupBy("row").agg(F.count("*").alias("degree")), "row").withColumn("band", band)
    leaders = banded.groupBy("value", "band").agg(F.max(F.struct("degree", "row")).alias("lead"))
    stars = banded.join(leaders, ["value", "band"]).groupBy(F.col("row").alias("b")).agg(F.max("lead").alias("lead")).select(F.col("lead.row").alias("a"), "b")
    links = _verified(stars.where("a <> b"), reps, sets, percent)

    placed = _placed(lists, links)
    split = placed.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("value")
    open_lists = stored(placed.join(split, "value"))
    shingles = sets.join(open_lists.select("row").distinct(), "row", "left_semi").select("row", F.explode("members").alias("shingle"))
    alone = shingles.groupBy("shingle").agg(F.count("*").alias("times"), F.min("row").alias("row")).where("times = 1").groupBy("row").agg(F.count("*").alias("alone"))
    bound = stored(open_lists.join(alone, "row", "left").select("value", "row", "n", "root", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most"))
                   .where(F.col("most") * 100 >= F.col("n") * percent))
    left = bound.select("value", *[F.col(c).alias(f"{c}_a") for c in ("row", "n", "root", "most")])
    right = bound.select("value", *[F.col(c).alias(f"{c}_b") for c in ("row", "n", "root", "most")])
    common = F.least("most_a", "most_b")
    cross = left.join(right, "value").where((F.col("root_a") < F.col("root_b")) & (common * 100 >= (F.col("n_a") + F.col("n_b") - common) * percent)).select(
        F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    more = _verified(cross, reps, sets, percent)
    joined = components(links.union(more)).withColumnRenamed("node", "rep")

    classes = sketched.where("n > 0").groupBy("key").agg(F.min("row").alias("rep"), F.min(F.struct("id", "row")).alias("low"))
    classes = stored(classes.join(joined, "rep", "left").select("key", "low", F.coalesce("root", "rep").alias("root")))
    heads = classes.groupBy("root").agg(F.min("low").alias("head"))
    found = classes.join(heads, "root").select("key", "head")
    return sketched.select("id", "row", "n", "key").join(found, "key", "left").select(
        "id", "row", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("head.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("head.row") == F.col("row")).otherwise(F.lit(True)).alias("chosen"))


def without_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group of near duplicates; rows repeated whole count as copies, all columns stay."""
    key, again = unused(docs, "row_key"), unused(docs, "row_again")
    rows = near_duplicates(docs, words, percent, id_col, text_col).groupBy("row").agg(
        F.max("chosen").alias("chosen"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    stay = rows.where("chosen").select(F.col("row").alias(key), ((F.col("copies") > 1) & (F.col("n") > 0)).alias(again))
    found = docs.withColumn(key, row_key(id_col, text_col)).join(stay, key)
    return found.where(~F.col(again)).union(found.where(again).dropDuplicates([key])).select(*docs.columns)


def component_rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
