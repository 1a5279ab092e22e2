"""Near-duplicate vectors, every link found.

1. Equal vectors fold into one. Centroids come from a bounded sample; each vector belongs to the shard of its nearest centroid, large shards are dealt
   into parts. Inside a shard the members are compared, which gives each a label: the smallest id of its component in the shard.
2. Shards go out in chunks of bounded size, and all vectors are searched in every shard of a chunk that may hold a link: a shard is left out only if its
   radius, or the border between its centroid and the nearest one of the vector, puts all members beyond the angle. A shard that lies wholly
   within the angle is counted by its size.
3. Products in single precision decide where their error cannot matter, the others are verified by the cosine in double precision.
4. Links are counted, not listed; components come from pairs of labels, whose number hangs on shards and not on the pairs in a crowd.
5. An audit compares vectors of the largest shards and of drawn ones with all vectors, in blocks. Any difference is an error.

The bounds spare work where vectors lie in groups. Vectors without any structure are all compared: the work then grows with the square of their number,
what is stored and sent does not.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talentloom.llm.common import components, stored

#: Vectors of a shard, sample for centroids, vectors of the audit.
SHARD, SAMPLE, AUDIT = 1000, 20_000, 512
#: Bytes of vectors in a chunk of shards; vectors compared at a time.
CHUNK_BYTES, ROWS = 48_000_000, 2048


def valid(vector: str):
    """Arrays with components, none of them null or not finite, not all zero."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def centroids(sample: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """Directions in two levels, by a few rounds of spherical k-means."""
    rng = np.random.default_rng(seed)

    def means(x: np.ndarray, k: int) -> np.ndarray:
        k = max(1, min(k, len(x)))
        at = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(6):
            near = np.argmax(x @ at.T, axis=1)
            total = np.zeros_like(at)
            np.add.at(total, near, x)
            size = np.linalg.norm(total, axis=1)
            at[size > 0] = total[size > 0] / size[size > 0][:, None]
        return at

    tops = means(sample, int(np.ceil(np.sqrt(count))))
    near = np.argmax(sample @ tops.T, axis=1)
    return np.concatenate([means(sample[near == t], -(-count * int((near == t).sum()) // len(sample))) for t in range(len(tops)) if (near == t).any()])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centroid of each vector."""
    return np.concatenate([np.argmax(x[k : k + ROWS] @ centres.T, axis=1) for k in range(0, len(x), ROWS)] or [np.zeros(0, int)])


def linked(x: np.ndarray, single: np.ndarray, y: np.ndarray, single_y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have a cosine of ``least`` or more: single precision where its error cannot matter, else double."""
    close = single @ single_y.T
    error = 1.2e-7 * (x.shape[1] + 4)  # twice the bound on rounding of unit vectors
    fine = close >= least + error
    rows, cols = np.nonzero((close >= least - error) & ~fine)
    for low in range(0, len(rows), 100_000):
        r, c = rows[low : low + 100_000], cols[low : low + 100_000]
        fine[r, c] = np.einsum("ij,ij->i", x[r], y[c]) >= least
    return fine


def local_labels(x: np.ndarray, reps: np.ndarray, least: float) -> np.ndarray:
    """The smallest rep of each member's component among the members."""
    single, front = x.astype(np.float32), np.zeros(0, int)
    label, left = np.empty(len(x), np.int64), np.argsort(reps)
    while len(left):
        lead, front, left = reps[left[0]], left[:1], left[1:]
        while len(front):
            label[front] = lead
            hit = np.zeros(len(left), bool)
            for low in range(0, len(front), ROWS):
                part = front[low : low + ROWS]
                hit |= linked(x[part], single[part], x[left], single[left], least).any(axis=0)
            front, left = left[hit], left[~hit]
    return label


class Chunk:
    """Some shards: members by shard, and what rules a shard out or in for a vector."""

    def __init__(self, shard: np.ndarray, cell: np.ndarray, rep: np.ndarray, label: np.ndarray, copies: np.ndarray, vectors: np.ndarray, centres: np.ndarray):
        order = np.lexsort((rep, shard))
        self.rep, self.label, self.copies, self.x = rep[order], label[order], copies[order], vectors[order]
        self.starts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        self.ends = np.append(self.starts[1:], len(order))
        self.cell = cell[order][self.starts]
        self.centres = centres
        cosine = np.einsum("ij,ij->i", self.x, centres[cell[order]])
        self.radius = np.arccos(np.clip(np.minimum.reduceat(cosine, self.starts), -1, 1))
        self.size = np.add.reduceat(self.copies, self.starts)

    def asked(self, x: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, shard): whether members may link, and whether all of them do. ``own`` is the nearest centroid of each vector."""
        angle, eps = np.arccos(np.clip(least, -1, 1)), 1e-6
        centre = self.centres[self.cell]
        cosine = x @ centre.T
        to = np.arccos(np.clip(cosine, -1, 1))
        ahead = np.einsum("ij,ij->i", x, self.centres[own])[:, None] - cosine  # members are on the other side of the border
        apart = np.sqrt(np.maximum(2 - 2 * self.centres[own] @ centre.T, 0))
        beyond = ahead > (np.sqrt(max(2 - 2 * least, 0)) + eps) * apart + eps
        every = to + self.radius <= angle - eps
        return ~every & ~beyond & (to <= angle + self.radius + eps), every


def searched(x: np.ndarray, own: np.ndarray, rep: np.ndarray, label: np.ndarray, chunk: Chunk, least: float, listed: bool) -> tuple[np.ndarray, set, list]:
    """Copies of linked members by vector, the vector itself included, pairs of labels that link, and if asked the pairs of reps."""
    single, single_y = x.astype(np.float32), chunk.single
    counts, joined, pairs = np.zeros(len(x), np.int64), set(), []
    may, every = chunk.asked(x, own, least)
    counts += every @ chunk.size
    for k, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist())):
        names, which = np.unique(chunk.label[a:b], return_inverse=True)
        rows = np.flatnonzero(every[:, k])
        joined.update((i, j) for i in np.unique(label[rows]).tolist() for j in names.tolist() if i != j)
        if listed:
            pairs += [(np.repeat(rep[rows], b - a), np.tile(chunk.rep[a:b], len(rows)))]
        rows = np.flatnonzero(may[:, k])
        if not len(rows):
            continue
        r, c = np.nonzero(linked(x[rows], single[rows], chunk.x[a:b], single_y[a:b], least))
        if len(r):
            counts[rows] += np.bincount(r, chunk.copies[a:b][c], len(rows)).astype(np.int64)
            mine, place = np.unique(label[rows], return_inverse=True)
            met = np.zeros((len(mine), len(names)), bool)
            met[place[r], which[c]] = True
            joined.update((i, j) for i, j in zip(mine[np.nonzero(met)[0]].tolist(), names[np.nonzero(met)[1]].tolist()) if i != j)
            if listed:
                pairs.append((rep[rows][r], chunk.rep[a:b][c]))
    return counts, joined, pairs


def _cells(centres):
    def run(batches):
        for batch in batches:
            x = matrix(batch.column("vector"))
            cell = nearest(x, centres.value) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *[batch.column(c) for c in ("rep", "copies", "vector")]], names=["cell", "rep", "copies", "vector"])
    return run


def _labelled(least: float):
    def run(table: pa.Table) -> pa.Table:
        label = local_labels(matrix(table.column("vector")), table.column("rep").to_numpy(), least)
        return table.select(["shard", "cell", "rep", "copies", "vector"]).append_column("label", pa.array(label))
    return run


def _searched(shared, least: float, listed: bool):
    """Rows (rep, links, -, -) with the count of a vector in the chunk, and (-, -, a, b) with linked labels, or reps where pairs are listed."""
    def run(batches):
        chunk = shared.value
        chunk.single = chunk.x.astype(np.float32)
        told = set()
        for batch in batches:
            whole, cells, reps, labels = matrix(batch.column("vector")), *[batch.column(c).to_numpy() for c in ("cell", "rep", "label")]
            for low in range(0, len(reps), ROWS):
                part = slice(low, low + ROWS)
                counts, joined, pairs = searched(whole[part], cells[part], reps[part], labels[part], chunk, least, listed)
                some = np.flatnonzero(counts)
                new = [] if listed else sorted(joined - told)
                told |= joined
                first = np.concatenate([p[0] for p in pairs]) if pairs else np.array([a for a, _ in new], np.int64)
                second = np.concatenate([p[1] for p in pairs]) if pairs else np.array([b for _, b in new], np.int64)
                for columns in ((reps[part][some], counts[some], None, None), (None, None, first, second)):
                    n = max(len(c) for c in columns if c is not None)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], names=["rep", "links", "a", "b"])
    return run


def _compared(shared, least: float):
    """Rows (rep, low, high) of the audit: copies of surely and of possibly linked rows, by comparing with every row in double precision."""
    def run(batches):
        ids, asked = shared.value
        low, high = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                close, copies = matrix(batch.column("vector")) @ asked.T, batch.column("copies").to_numpy()
                low += copies @ (close >= least + 1e-12)
                high += copies @ (close >= least - 1e-12)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, low, high)], names=["rep", "low", "high"])
    return run


def _audited(placed: DataFrame, shards: list, counted: DataFrame, least: float) -> float:
    """The share of links found of vectors from the largest shards and from drawn ones; an error if it is not all of them."""
    by_size = sorted(shards, key=lambda r: (-r["n"], r["shard"]))[: AUDIT // 2]
    ids = sorted({r["first"] for r in by_size} | {r["first"] for r in sorted(shards, key=lambda r: r["drawn"])[: AUDIT // 2]})
    chosen = placed.where(F.col("rep").isin(ids)).select("rep", "vector").toArrow()  # bounded: AUDIT
    asked = placed.sparkSession.sparkContext.broadcast((chosen.column("rep").to_numpy(), matrix(chosen.column("vector"))))
    truth = placed.select("copies", "vector").mapInArrow(_compared(asked, least), "rep long, low long, high long").groupBy("rep").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    rows = truth.join(counted, "rep", "left").select("low", "high", F.coalesce("links", F.lit(0)).alias("links")).collect()
    wrong = sum(not r["low"] <= r["links"] <= r["high"] for r in rows)
    if wrong:
        raise RuntimeError(f"the audit found {wrong} of {len(rows)} vectors with other links than the search")
    return min(1.0, sum(r["links"] for r in rows) / max(1, sum(r["low"] for r in rows)))


def _search(vectors: DataFrame, least: float, listed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """(rep, label) of (rep, copies, vector) rows of one size, (rep, links) with the row's own copies, (a, b) links of labels or reps, recall of the audit."""
    context = vectors.sparkSession.sparkContext
    n = vectors.count()
    drawn = vectors.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(min(n, SAMPLE)).toArrow()  # bounded: SAMPLE
    sample = matrix(drawn.column("vector"))
    centres = centroids(sample, -(-n // SHARD))
    shared = context.broadcast(centres)
    celled = stored(vectors.select("rep", "copies", "vector").mapInArrow(_cells(shared), "cell int, rep long, copies long, vector array<double>"))
    parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(2 * SHARD)).alias("parts"))
    dealt = celled.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("rep"), "parts"))
    dealt = dealt.withColumn("shard", F.col("cell").cast("long") * (1 << 32) + F.col("part")).drop("parts", "part")
    placed = stored(dealt.groupBy("shard").applyInArrow(_labelled(least), "shard long, cell int, rep long, copies long, vector array<double>, label long"))
    shards = placed.groupBy("shard").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("rep", F.lit(1))).alias("first"),
                                         F.min(F.xxhash64("rep", F.lit(1))).alias("drawn")).orderBy("shard").collect()  # one row per shard
    most, chunks, held = max(1, CHUNK_BYTES // (8 * sample.shape[1])), [], 0
    for r in shards:
        if not chunks or held + r["n"] > most:
            chunks.append([r["shard"], r["shard"]])
            held = 0
        chunks[-1][1] = r["shard"]
        held += r["n"]
    out = None
    for low, high in chunks:
        got = placed.where(F.col("shard").between(low, high)).toArrow()  # bounded: CHUNK_BYTES
        chunk = Chunk(*[got.column(c).to_numpy() for c in ("shard", "cell", "rep", "label", "copies")], matrix(got.column("vector")), centres)
        sent = context.broadcast(chunk)
        found = stored(placed.select("cell", "rep", "label", "vector").mapInArrow(_searched(sent, least, listed), "rep long, links long, a long, b long"))
        sent.unpersist()
        out = found if out is None else out.union(found)
    counted = stored(out.where("rep is not null").groupBy("rep").agg(F.sum("links").alias("links")))
    return placed.select("rep", "label"), counted, out.where("a is not null").select("a", "b"), _audited(placed, shards, counted, least)


def links(vectors: DataFrame, least: float) -> tuple[DataFrame, float]:
    """(a, b) pairs, both ways, of (rep, vector) rows of one size whose cosine is ``least`` or more, and the recall of the audit."""
    _, _, pairs, recall = _search(vectors.select("rep", F.lit(1).cast("long").alias("copies"), "vector"), least, listed=True)
    return pairs.where("a <> b"), recall


def linked_vectors(table: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per vector.

    Two vectors link if their cosine in double precision is ``least`` or more. A vector that is null, empty or zero, or holds null or non-finite
    components, links with nothing, as do vectors of another length. Equal vectors link with each other. component_id is the smallest id
    reachable by links. Repeated rows are vectors of their own. Null ids are smaller than none. Other columns are not read.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.where(valid("vector")).withColumn("key", F.md5(F.to_json(F.struct("vector"))))
    classes = stored(good.groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"), F.first("vector").alias("vector"))
                     .select("key", "copies", "low", "vector", F.xxhash64("key").alias("rep"), F.size("vector").alias("size")))
    sizes = [r["size"] for r in classes.groupBy("size").count().collect()]  # one row per length of vector
    parts = [_search(classes.where(F.col("size") == size).select("rep", "copies", "vector"), least)[:3] for size in sorted(sizes)]
    bare = rows.withColumn("key", F.when(valid("vector"), F.md5(F.to_json(F.struct("vector"))))).select("vec_id", "key")
    if not parts:
        return bare.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    labels, counted, edges = (reduce(DataFrame.union, x) for x in zip(*parts))
    roots = components(edges).withColumnRenamed("node", "label")
    facts = (classes.select("key", "rep", "copies", "low").join(counted, "rep", "left").join(labels, "rep").join(roots, "label", "left")
             .withColumn("root", F.coalesce("root", "label")))
    heads = facts.groupBy("root").agg(F.min("low").alias("head"))
    facts = facts.join(heads, "root").select("key", (F.coalesce("links", "copies") - 1).alias("n_links"), "head")
    out = bare.join(facts, "key", "left")
    component = F.when(F.col("key").isNotNull(), F.col("head")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
