"""Stupid-backoff scores of every document against all other documents, computed relationally.

1. Documents are dealt into segments of some megabytes by a hash of the row. A segment explodes its n-grams (64-bit hashes of runs of 1 to ``order``
   words) and keeps each once, with its count: a run of sorted hashes per hash bucket.
2. Buckets gather the runs of all segments: together they are the n-gram count table, partitioned by hash. Joined to the runs they came from, each gets
   the counts of its n-grams in all other segments. A frequent n-gram is one entry per segment, so no bucket is hot. Words and pairs go in a first round,
   each greater length in one of its own: the answers of a round are stored and its runs go before the next, so that disk holds the runs of one round.
3. Counts return to the segments, which add their own; most long n-grams stand in one segment only, and their zeros take next to no room. A document's own n-grams are taken off, and the scores of its words are summed per document.

Runs travel as byte planes of differences, which shuffle compression packs well. The number of segments and buckets grows with the input, their
size does not. Nothing but the total number of words comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talentloom.llm.common import concluded, mixed, row_key, stored, WordHashes

#: Longest n-gram, weight of each step back.
ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a segment.
SEGMENT_BYTES = 6_000_000
_START = np.uint64(0x9AE16A3B2F90404F)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split() if text else []


def rounds_of(order: int) -> list[tuple[int, ...]]:
    """The lengths of n-grams by the round in which they are counted."""
    return [tuple(range(1, min(order, 2) + 1)), *[(k,) for k in range(3, order + 1)]]


def grams_of(texts: list[str | None], order: int, lengths: tuple[int, ...], hashes: WordHashes) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words per text, and for each of the lengths k the hash of the k-gram that ends at each word; texts start with ``order`` - 1 marks."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    marks = np.full(order - 1, _START, np.uint64)
    single = np.concatenate([x for w in split for x in (marks, hashes.of(w))]) if split else np.zeros(0, np.uint64)
    keep = np.ones(len(single), bool)
    first = np.cumsum(sizes + order - 1) - sizes - order + 1
    for k in range(order - 1):
        keep[first + k] = False
    at = np.flatnonzero(keep)
    out = []
    for k in lengths:
        total = np.full(len(at), k, np.uint64)
        for back in range(k - 1, -1, -1):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + single[at - back])
        out.append(total)
    return sizes, out


def start_grams(order: int, lengths: tuple[int, ...]) -> np.ndarray:
    """Hashes of the runs of start marks of these lengths below ``order``, the contexts of first words."""
    out = []
    for k in lengths:
        if k < order:
            total = np.full(1, k, np.uint64)
            for _ in range(k):
                total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + np.array([_START]))
            out.append(total)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def planes(values: np.ndarray) -> bytes:
    """64-bit values as eight planes of bytes."""
    return np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


_HASHES = WordHashes()


def _joined(sizes: np.ndarray, grams: list[np.ndarray], order: int, lengths: tuple[int, ...]) -> np.ndarray:
    """The grams of these lengths in one array; each text with words adds the runs of start marks once."""
    return np.concatenate([*grams, np.tile(start_grams(order, lengths), int(np.count_nonzero(sizes)))])


def _buckets(every: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's run of the sorted hashes starts; buckets are equal ranges of the hash."""
    edges = np.array([((k << 64) + buckets - 1) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(every, edges), len(every))


def _requests(order: int, lengths: tuple[int, ...], buckets: int):
    def run(table: pa.Table) -> pa.Table:
        sizes, grams = grams_of(table.column("text").to_pylist(), order, lengths, _HASHES)
        every, counts = np.unique(_joined(sizes, grams, order, lengths), return_counts=True)
        at = _buckets(every, buckets)
        out = [(k, planes(np.diff(every[a:b], prepend=np.uint64(0))), planes(counts[a:b])) for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if b > a]
        segment = table.column("segment")[0].as_py()
        return pa.Table.from_arrays([pa.array([k for k, _, _ in out], pa.int32()), pa.array([segment] * len(out), pa.int32()),
                                     pa.array([g for _, g, _ in out], pa.binary()), pa.array([c for _, _, c in out], pa.binary())],
                                    names=["bucket", "segment", "grams", "counts"])
    return run


def _answers(table: pa.Table) -> pa.Table:
    """A bucket: its part of the count table, joined back to each run without the run's own counts."""
    runs = [np.cumsum(unplanes(g.as_py()), dtype=np.uint64) for g in table.column("grams")]
    counts = [unplanes(c.as_py()) for c in table.column("counts")]
    every, place = np.unique(np.concatenate(runs), return_inverse=True)
    total = np.zeros(len(every), np.uint64)
    here = np.concatenate(counts)
    np.add.at(total, place, here)
    found, ends = total[place] - here, np.cumsum([len(r) for r in runs])
    return pa.Table.from_arrays([table.column("segment").combine_chunks(), table.column("bucket").combine_chunks(),
                                 pa.array([planes(found[e - len(r) : e]) for e, r in zip(ends.tolist(), runs)], pa.binary())], names=["segment", "bucket", "totals"])


def word_scores(left: list[np.ndarray], contexts: list[np.ndarray], backoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Per word the log score without the total of words, and 1 where that total divides.

    ``left`` has for k = 1, 2, … the counts of the word's k-gram in other texts, ``contexts`` for k = 2, … those of the (k-1)-gram before it.
    """
    n = len(left[0])
    score, by_total, open_ = np.zeros(n), np.zeros(n), np.ones(n, bool)
    for k in range(len(left), 1, -1):
        hit = open_ & (left[k - 1] > 0)
        score[hit] += np.log(left[k - 1][hit] / np.maximum(contexts[k - 2][hit], 1))
        open_ &= ~hit
        score[open_] += np.log(backoff)
    score[open_] += np.log(np.maximum(left[0][open_], backoff))
    by_total[open_] = 1
    return score, by_total


def _scores(order: int, backoff: float):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rounds = rounds_of(order)
        sizes, grams = grams_of(texts.column("text").to_pylist(), order, tuple(range(1, order + 1)), _HASHES)
        n, docs = len(grams[0]), len(sizes)
        number = np.repeat(np.arange(docs), sizes)
        summed = backed = np.zeros(docs)
        if n:
            runs = sorted(zip(answers.column("round").to_pylist(), answers.column("bucket").to_pylist(), answers.column("totals")), key=lambda x: x[:2])
            left, starts = [], []
            for turn, lengths in enumerate(rounds):
                joined = _joined(sizes, grams[lengths[0] - 1 : lengths[-1]], order, lengths)
                _, place, held = np.unique(joined, return_inverse=True, return_counts=True)
                totals = np.concatenate([unplanes(t.as_py()) for r, _, t in runs if r == turn]).astype(np.int64) + held
                for k in range(len(lengths)):
                    here = place[k * n : (k + 1) * n]
                    rest = totals[here] - 1
                    several = np.flatnonzero(held[here] > 1)  # what the segment holds once, the text holds once
                    _, which, own = np.unique(here[several] * docs + number[several], return_inverse=True, return_counts=True)
                    rest[several] -= own[which] - 1
                    left.append(rest)
                # runs of start marks that the other texts hold, by length
                starts += (totals[place[len(lengths) * n :][: sum(k < order for k in lengths)]] - 1).tolist()
            heads = np.flatnonzero(np.diff(number, prepend=-1))
            contexts = []
            for k in range(order - 1):
                before = np.concatenate((left[k][:1], left[k][:-1]))
                before[heads] = starts[k]
                contexts.append(before)
            score, by_total = word_scores(left, contexts, backoff)
            summed, backed = np.bincount(number, score, docs), np.bincount(number, by_total, docs)
        return pa.Table.from_arrays([texts.column("id").combine_chunks(), pa.array(sizes), pa.array(backed.astype(np.int64)), pa.array(summed)],
                                    names=["id", "n_words", "n_backed_off", "log_score"])
    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, n_backed_off, log_score, mean_score): per document the sum and the mean of the log scores of its words.

    A word scores count(n-gram) / count(its context) by the longest n-gram that other documents hold, times ``backoff`` per step back; at last
    count(word) / all words, an unknown word counting as ``backoff``. Counts leave out the document itself, copies of it are other documents. Texts
    start with start marks. A null or empty text has no words, score 0 and a null mean. An empty table gives no rows.
    """
    return concluded(docs.sparkSession, lambda: _scored(docs, order, backoff, id_col, text_col))


def _scored(docs: DataFrame, order: int, backoff: float, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = int(size // SEGMENT_BYTES) + 1
    buckets = max(segments, min(8 * segments, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = base.withColumn("segment", F.pmod(F.xxhash64(row_key("id", "text")), F.lit(segments)).cast("int"))
    answered = None
    for turn, lengths in enumerate(rounds_of(order)):
        asked = dealt.groupBy("segment").applyInArrow(_requests(order, lengths, buckets), "bucket int, segment int, grams binary, counts binary")
        found = stored(asked.groupBy("bucket").applyInArrow(_answers, "segment int, bucket int, totals binary")).withColumn("round", F.lit(turn))
        answered = found if answered is None else answered.union(found)
    scored = stored(dealt.groupBy("segment").cogroup(answered.groupBy("segment")).applyInArrow(
        _scores(order, backoff), f"id {kind}, n_words long, n_backed_off long, log_score double"))
    words = scored.agg(F.sum("n_words")).first()[0] or 1
    total = F.col("log_score") - F.col("n_backed_off") * F.log(F.lit(float(max(words, 1))))
    return scored.select("id", "n_words", "n_backed_off", total.alias("log_score"),
                         F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("mean_score"))
