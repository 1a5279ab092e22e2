"""Benchmark decontamination with a stored positional inverted index of the training texts.

1. Test items are taken in blocks of at most ``BLOCK_WORDS`` words; the words of a block are broadcast, everything else stays distributed.
2. Index: documents are dealt into segments of some megabytes where they lie (no shuffle). For each test term a segment stores one posting
   list, the gaps between the term's positions in the segment. Documents in a segment stand apart by more than any window, so no match
   crosses from one to the next. The index is written to the shared folder.
3. Terms are counted over the index. Windows with a term the corpus lacks are dropped; the others order their terms from the rarest.
4. Per segment, the positions of each window's rarest term, less the term's offset in the window, are the candidate starts; they are
   intersected with the offset-adjusted lists of the next rarest terms. What is left are exact phrase matches. Proximity matches ask
   instead that every term of the window lies within ``near`` words of its rarest term, in any order.

A segment is bounded, so no task or list grows with the corpus, and equal or frequent passages weigh on no single task.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from talentloom.llm.common import batches_of, concluded, releasing, row_key, slices, stored, unused

#: Words of neighbouring item words in a window.
WINDOW = 10
#: Words of test items matched in one pass over the index.
BLOCK_WORDS = 500_000
#: Bytes of text in a segment of the index.
SEGMENT_BYTES = 4_000_000
#: Maps bytes to lower-case words: letters and digits of ASCII and all beyond it are in words, the rest parts them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SHIFT = 1 << 33


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def windows_of(words: list, size: int = WINDOW) -> list[tuple]:
    """Runs of ``size`` words; all words as one window if they are fewer, none without words."""
    return [tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def _index(vocabulary, apart: int, id_type: pa.DataType):
    names = ["segment", "term", "gaps", "ids", "rows", "sizes"]

    def segment(key, held):
        places, terms, sizes, base = [], [], [], 0
        for _, text, _ in held:
            found = np.fromiter(map(vocabulary.value.get, text, repeat(-1)), np.int32, len(text))
            known = np.flatnonzero(found >= 0)
            places.append(known + base)
            terms.append(found[known])
            sizes.append(len(text))
            base += len(text) + apart
        place, term = np.concatenate(places), np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        place, term = place[order], term[order]
        start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        gaps = np.diff(place, prepend=0)
        gaps[start] = place[start]
        n, ends = len(start), np.append(start, len(place)).astype(np.int32)
        spelled = vocabulary.value["\0words"]
        return pa.RecordBatch.from_arrays([
            pa.array([key] * (n + 1), pa.int64()), pa.array([spelled[t] for t in term[start].tolist()] + [None], pa.string()),
            pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1])), pa.array(gaps, pa.int64())),
            pa.array([None] * n + [[i for i, _, _ in held]], pa.list_(id_type)), pa.array([None] * n + [[r for _, _, r in held]], pa.list_(pa.int64())),
            pa.array([None] * n + [sizes], pa.list_(pa.int64()))], names=names)

    def run(batches):
        def rows():
            for batch in slices(batches):
                for i, text, row in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("row").to_pylist()):
                    yield i, words_of(text), row

        first = TaskContext.get().partitionId() << 32  # a key of its own for each segment, alike when a lost task runs again
        for n, held in enumerate(batches_of(rows(), lambda r: 8 * len(r[1]) + 100, SEGMENT_BYTES)):
            yield segment(first + n, held)
    return run


def _matches(plan, apart: int, near: int | None):
    """For a segment: candidates from the rarest terms, thinned by the lists of the others."""
    def run(table: pa.Table) -> pa.Table:
        vocabulary, groups = plan.value
        terms, lists = table.column("term").to_pylist(), table.column("gaps").combine_chunks()
        head = [k for k, t in enumerate(terms) if t is None]
        ids = [i for k in head for i in table.column("ids")[k].as_py()]
        rows = [i for k in head for i in table.column("rows")[k].as_py()]
        sizes = np.array([i for k in head for i in table.column("sizes")[k].as_py()], np.int64)
        base = np.cumsum(sizes + apart) - sizes - apart
        held = sorted((vocabulary[t], k) for k, t in enumerate(terms) if t is not None and t in vocabulary)
        keys = np.concatenate([np.cumsum(lists[k].values.to_numpy()) + t * _SHIFT for t, k in held]) if held else np.zeros(0, np.int64)
        spans, items, close = [set() for _ in ids], [set() for _ in ids], [set() for _ in ids]
        for size, by_rarity, offsets, owner in groups if len(keys) else ():
            low = np.searchsorted(keys, by_rarity[:, 0] * _SHIFT)
            count = np.searchsorted(keys, by_rarity[:, 0] * _SHIFT + _SHIFT) - low
            window = np.repeat(np.arange(len(count)), count)
            place = keys[np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(window))] - by_rarity[window, 0] * _SHIFT
            if near is not None:
                w, p = window, place
                for k in range(1, size):
                    want = by_rarity[w, k] * _SHIFT
                    at = np.searchsorted(keys, want + np.maximum(p - near, 0))
                    ok = keys[np.minimum(at, len(keys) - 1)] - want
                    ok = (at < len(keys)) & (ok >= 0) & (ok <= p + near)
                    w, p = w[ok], p[ok]
                for d, i in set(zip((np.searchsorted(base, p, "right") - 1).tolist(), owner[w].tolist())):
                    close[d].add(i)
            start = place - offsets[window, 0]
            for k in range(1, size):
                if not len(window):
                    break
                want = by_rarity[window, k] * _SHIFT + start + offsets[window, k]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                ok = keys[at] == want
                window, start = window[ok], start[ok]
            doc = np.searchsorted(base, start, "right") - 1
            for d, low_word, i in zip(doc.tolist(), (start - base[doc]).tolist(), owner[window].tolist()):
                spans[d].add((low_word, low_word + size))
                items[d].add(i)
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        return pa.Table.from_arrays([
            pa.array(ids, table.schema.field("ids").type.value_type), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()),
            pa.array([[{"low": a, "high": b} for a, b in merged(s)] for s in spans], kind), pa.array([sorted(s) for s in items], pa.list_(pa.string())),
            pa.array([sorted(s) for s in close], pa.list_(pa.string()))], names=["id", "row", "n_words", "spans", "items", "near_items"])
    return run


def merged(spans) -> list[tuple[int, int]]:
    """Union of spans, touching ones joined."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(s) for s in out]


def _blocks(items: DataFrame) -> list[DataFrame]:
    """Items dealt into blocks of at most about ``BLOCK_WORDS`` words, whole items."""
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    count = int(total // BLOCK_WORDS) + 1
    return [items.where(F.pmod(F.xxhash64("item"), F.lit(count)) == k) for k in range(count)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, near: int | None = None, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Rows (id, row, n_words, spans, items, near_items): per document its words, the runs of words hit by a test window, the items with
    such windows, and with ``near`` the items with a proximity match.

    A null or empty text has no words and no hits; so has every document if the benchmark is empty. Items without an id or without words are
    passed over, repeated items count once. Repeated rows come back as often as they came. Other columns are not read.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", row_key("id", "text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col("text")).where("item is not null and text is not null").distinct()
    kind, apart = docs.schema[id_col].dataType.simpleString(), window + 2 * (near or 0) + 1
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    found = None
    for block in _blocks(items):
        tests = [(r["item"], words_of(r["text"])) for r in block.collect()]  # at most BLOCK_WORDS words
        wanted = sorted({(w, i) for i, words in tests for w in windows_of(words, window)})
        spelled = sorted({t for w, _ in wanted for t in w})
        numbers = {t: k for k, t in enumerate(spelled)}
        vocabulary = spark.sparkContext.broadcast(numbers | {"\0words": [t.decode() for t in spelled]})
        index = stored(keyed.mapInArrow(releasing(_index(vocabulary, apart, id_type)), (
            f"segment long, term string, gaps array<long>, ids array<{kind}>, rows array<long>, sizes array<long>")))
        counts = dict(index.where("term is not null").groupBy("term").agg(F.sum(F.size("gaps")).alias("n")).collect())  # one row per test term
        groups = []
        for size in sorted({len(w) for w, _ in wanted}):
            chosen = [(w, i) for w, i in wanted if len(w) == size and all(t.decode() in counts for t in w)]
            if chosen:
                order = [sorted(range(size), key=lambda k: (counts[w[k].decode()], w[k], k)) for w, _ in chosen]
                groups.append((size, np.array([[numbers[w[k]] for k in o] for (w, _), o in zip(chosen, order)], np.int64),
                               np.array(order, np.int64), np.array([i for _, i in chosen], object)))
        plan = spark.sparkContext.broadcast(({t.decode(): k for t, k in numbers.items()}, groups))
        hits = index.groupBy("segment").applyInArrow(_matches(plan, apart, near), (
            f"id {kind}, row long, n_words long, spans array<struct<low:long,high:long>>, items array<string>, near_items array<string>"))
        found = hits if found is None else _joined(stored(found), hits)
    return found


def _joined(one: DataFrame, two: DataFrame) -> DataFrame:
    """Hits of two blocks of items."""
    other = two.where("size(spans) > 0 or size(near_items) > 0").dropDuplicates(["row"]).select(
        "row", F.col("spans").alias("s"), F.col("items").alias("i"), F.col("near_items").alias("c"))
    both = one.join(other, "row", "left")
    add = lambda a, b: F.array_sort(F.array_union(a, F.coalesce(b, F.slice(a, 1, 0))))
    return both.select("id", "row", "n_words", add(F.col("spans"), F.col("s")).alias("spans"), add(F.col("items"), F.col("i")).alias("items"),
                       add(F.col("near_items"), F.col("c")).alias("near_items"))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        F.greatest(a["end"], s["high"]).alias("end"),
        (a["total"] + F.greatest(s["high"] - F.greatest(a["end"], s["low"]), F.lit(0).cast("long"))).alias("total")), lambda a: a["total"])


def hit_digest(found: DataFrame) -> DataFrame:
    """One row per document: words, words hit, items and their digest."""
    hit = _covered(F.col("spans"))
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a hit, all columns."""
    key = unused(docs, "row_key")
    hit = concluded(docs.sparkSession, lambda: contamination(docs, benchmark, window, None, id_col, text_col).where(F.size("spans") > 0)
                    .select(F.col("row").alias(key)).distinct())
    return docs.withColumn(key, row_key(id_col, text_col)).join(hit, key, "left_anti").drop(key)


#: SQL twin of the digest: windows as joined words, looked up at every place of every text.
SQL = """
with chars as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as up, 'abcdefghijklmnopqrstuvwxyz' as low),
item_words as (select item_id, regexp_extract_all(translate(text, up, low), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark, chars where text is not null),
windows as (select distinct item_id, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') as phrase, least(10, len(w)) as size
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as k from item_words where len(w) > 0)),
doc_words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents, chars),
sizes as (select distinct size from windows),
places as (select doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') as phrase
  from (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as k from doc_words, sizes where len(w) >= size)),
hits as (select doc_id, k, p.size, item_id from places p join windows v on p.phrase = v.phrase and p.size = v.size),
covered as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(generate_series(k, k + size - 1)) as pos from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc_words d left join covered c on c.doc_id = d.doc_id left join items i on i.doc_id = d.doc_id
"""
