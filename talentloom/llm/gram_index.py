"""Spelling variants: frequent words of a corpus, those one insertion, deletion or replacement apart, and the usual form of each.

A word is marked at both ends and cut into grams of variable length, one from every place: the shortest one of two characters or more that is not frequent
among the words, six characters at most, or up to the end of the word. The frequent grams are the dictionary: all grams of two to five characters that stand
more than ``rare`` times in the words; frequent grams are the ones that get longer, so lists stay short where words are alike and grams stay short where they
are not. Whether a gram ends hangs on its own characters alone, so an edit changes only the grams that it touches: all others stand in the other word too, as
far from its start if they are before the edit, as far from its end if they are behind it.

That gives the bound by which lists are merged. Of a set of grams of a word, an edit affects at most as many as cover one place; if the bound is below their
number, every word one edit away is in one of their lists. The least set of that kind is two grams without a common place, and every word has one since no gram
is longer than the shortest word. Of all such pairs the word takes the one whose lists are the shortest, estimated on a sample of words. Lists are
kept by gram, place and length of word: a list for words of length n has words of length n, and words of length n + 1 with the place counted as if one
character before or behind it were gone. So each word reads two lists, which have all near words as long as it or longer by one; shorter ones find it from
their side. What stands in a list is checked by its distance.

Long lists are split by a hash of the word, and a word that reads one reads every part.

No side of a join is broadcast: rows of lists are made by a function and an explode, and Spark guesses their size from the words read, far too low.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talentloom.llm.common import mixed, slices, stored

#: Words of fewer characters or occurrences are not looked at; a form is so many times as frequent as its variant.
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: One of so many runs loses a character, drawn by document and run.
SLIP = 199
#: A gram in more than so many places of the words is frequent; twice as many and so on, until the dictionary has at most MOST_GRAMS (8 bytes each).
RARE, MOST_GRAMS = 64, 2_000_000
#: Words on which the lengths of lists are estimated; words of a list that are read at once.
SAMPLE, LIST_PART = 100_000, 4096
#: Distinct words of a task that are counted before they go on; cells of the matrices that words are cut in.
COUNTED, CELLS = 300_000, 2_000_000

_RUNS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))
_LONGEST, _SHORTEST = 6, 2
_OPEN, _CLOSE = 1, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


# --- words ------------------------------------------------------------------------------------------------------------------------------------------

def runs_of(text: str) -> list[bytes]:
    """Runs of letters, A to Z in lower case, in Latin-1; no letter of a run lies outside it."""
    return text.encode("latin-1", "replace").translate(_RUNS).split()


def slipped(key: bytes, run: bytes, slip: int) -> bytes:
    """The run, without one of its characters where the draw says so."""
    draw = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(key + b":"))
    if draw % slip:
        return run
    at = draw % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, slip: int = SLIP,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word, n) of the words of whole texts. A null text has none, a null id counts as an empty one, repeated rows count as often as they stand."""
    def run(batches):
        total: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                key = (key or "").encode()
                for word, n in Counter([w for w in runs_of(text or "") if len(w) >= least_chars]).items():
                    word = slipped(key, word, slip)
                    if len(word) >= least_chars:
                        total[word] += n
                if len(total) > COUNTED:
                    yield rows()
                    total.clear()
        yield rows()

    found = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- grams ------------------------------------------------------------------------------------------------------------------------------------------

def matrices(words: list[str]):
    """(places of the words, marked code points, sizes) of words of like length, some megabytes at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        step = max(1, CELLS // (int(lengths[order[at]]) + 2))
        places = order[at : at + step]
        while len(places) > 1 and (int(lengths[places[-1]]) + 2) * len(places) > 2 * CELLS:
            places = places[: len(places) // 2]
        at += len(places)
        width = int(lengths[places[-1]])
        codes = np.zeros((len(places), width + 2), np.uint64)
        codes[:, 1 : width + 1] = np.array([words[k] for k in places], f"<U{width}").view(np.uint32).reshape(len(places), width)
        codes[:, 0] = _OPEN
        sizes = lengths[places] + 2
        codes[np.arange(len(places)), sizes - 1] = _CLOSE
        yield places, codes, sizes


def windows(codes: np.ndarray, sizes: np.ndarray, longest: int):
    """(length, hashes, inside): hashes of the stretches of 2, 3 … characters from every place, and whether they lie inside the word."""
    hashes = codes
    for length in range(_SHORTEST, longest + 1):
        hashes = mixed(hashes[:, : codes.shape[1] - length + 1] * _STEP + codes[:, length - 1 :])
        yield length, hashes, np.arange(hashes.shape[1])[None, :] + length <= sizes[:, None]


def gram_counts(words: DataFrame) -> DataFrame:
    """Rows (gram, n): hashes of all stretches of two to five characters of marked words, and how often they stand."""
    def run(batches):
        for batch in slices(batches):
            for _, codes, sizes in matrices(batch.column("word").to_pylist()):
                found = np.concatenate([h[inside] for _, h, inside in windows(codes, sizes, _LONGEST - 1)])
                grams, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def dictionary(words: DataFrame, rare: int = RARE, most: int = MOST_GRAMS) -> np.ndarray:
    """Sorted hashes of the frequent grams, ``most`` of them at most: the bar doubles until they fit."""
    grams = stored(gram_counts(words).where(F.col("n") > rare))
    bars = [rare << k for k in range(40)]
    sizes = grams.agg(*[F.count(F.when(F.col("n") > b, 1)) for b in bars]).first()
    bar = next(b for b, n in zip(bars, sizes) if n <= most)
    held = grams.where(F.col("n") > bar).select("gram").toArrow().column("gram").to_numpy()
    return np.sort(held.view(np.uint64))


def grams_of(codes: np.ndarray, sizes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, length) of the gram from every place of marked words; length 0 where none begins."""
    kept = lengths = growing = None
    for length, hashes, inside in windows(codes, sizes, _LONGEST):
        if kept is None:
            kept, lengths, growing = hashes.copy(), np.where(inside, length, 0), inside
        else:
            growing = growing[:, : hashes.shape[1]] & inside
            kept[:, : hashes.shape[1]][growing] = hashes[growing]
            lengths[:, : hashes.shape[1]][growing] = length
        if len(frequent):
            place = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
            growing = growing & (frequent[place] == hashes)
        else:
            growing = np.zeros_like(growing)
    return kept, lengths


def affected(lengths: np.ndarray) -> np.ndarray:
    """The bound of each word: the most grams that one edit can change, which is the most that cover one place."""
    starts = np.arange(lengths.shape[1])[None, :]
    cover = np.zeros((len(lengths), lengths.shape[1] + 1), np.int64)
    for back in range(_LONGEST):
        reach = (lengths > back).astype(np.int64)
        cover[:, back:][:, : lengths.shape[1]] += reach[:, : cover.shape[1] - back]
    return cover.max(axis=1) if starts.size else np.zeros(len(lengths), np.int64)


def list_keys(grams: np.ndarray, chars, places) -> np.ndarray:
    """Keys of the lists of a gram, for words of so many characters, at a place."""
    return mixed(grams ^ mixed((np.asarray(chars, np.uint64) << np.uint64(32)) + np.asarray(places, np.uint64) + _STEP))


def listings(codes: np.ndarray, sizes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): every list that a word stands in, for words as long and for words shorter by one."""
    grams, lengths = grams_of(codes, sizes, frequent)
    row, place = np.nonzero(lengths)
    gram, chars = grams[row, place], sizes[row] - 2
    behind = place > 0
    keys = [list_keys(gram, chars, place), list_keys(gram, chars - 1, place), list_keys(gram[behind], chars[behind] - 1, place[behind] - 1)]
    return np.concatenate(keys), np.concatenate([row, row, row[behind]])


class Lengths:
    """Estimated lengths of lists, from the lists of a sample of words."""

    def __init__(self, words: list[str], frequent: np.ndarray, share: int):
        keys = [listings(codes, sizes, frequent)[0] for _, codes, sizes in matrices(words)] or [np.zeros(0, np.uint64)]
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        self.keys, self.n = found[n > 1], n[n > 1] * share

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(keys.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 1)


def readings(codes: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, lengths_of: Lengths) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the two lists that each word reads, of two grams without a common place, those with the least to read."""
    grams, lengths = grams_of(codes, sizes, frequent)
    m, width = lengths.shape
    keys = list_keys(grams, (sizes - 2)[:, None], np.arange(width)[None, :])
    cost = np.where(lengths > 0, lengths_of.of(keys).astype(float), np.inf)
    best, at = np.full((m, width + 1), np.inf), np.zeros((m, width + 1), np.int64)  # the cheapest gram from a place on
    for place in range(width - 1, -1, -1):
        better = cost[:, place] <= best[:, place + 1]
        best[:, place] = np.where(better, cost[:, place], best[:, place + 1])
        at[:, place] = np.where(better, place, at[:, place + 1])
    rows = np.arange(m)
    behind = np.minimum(np.arange(width)[None, :] + lengths, width)
    first = np.argmin(cost + best[rows[:, None], behind], axis=1)
    second = at[rows, behind[rows, first]]
    return np.concatenate([keys[rows, first], keys[rows, second]]), np.concatenate([rows, rows])


# --- pairs ------------------------------------------------------------------------------------------------------------------------------------------

def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, n, other, other_n), each pair of words one edit apart once, from rows (word, n) of distinct words of six characters or more.

    Words with null or of fewer characters find nothing. A table without rows gives none, other columns play no part, and a word may be of any length.
    """
    spark = words.sparkSession
    words = stored(words.select("word", "n").where(F.char_length("word") >= _LONGEST))
    frequent = dictionary(words)
    share = max(1, words.count() // SAMPLE)
    sample = [r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word").toLocalIterator()]
    held = spark.sparkContext.broadcast((frequent, Lengths(sample, frequent, share)))

    def rows(read):
        def run(batches):
            frequent, lengths_of = held.value
            for batch in slices(batches):
                column, n = batch.column("word"), batch.column("n")
                for places, codes, sizes in matrices(column.to_pylist()):
                    keys, row = readings(codes, sizes, frequent, lengths_of) if read else listings(codes, sizes, frequent)
                    taken = pa.array(places[row])
                    parts = 1 + lengths_of.of(keys) // LIST_PART
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(parts), column.take(taken), n.take(taken)], names=["key", "parts", "word", "n"])

        return words.mapInArrow(run, "key long, parts long, word string, n long")

    listed = rows(False).select("key", F.pmod(F.xxhash64("word"), "parts").alias("part"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    asked = rows(True).select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "word", "n")
    later = (F.char_length("other") > F.char_length("word")) | (F.col("word") < F.col("other"))
    met = asked.join(listed.hint("merge"), ["key", "part"]).where(later & (F.levenshtein("word", "other", 1) == 1))
    return met.groupBy("word", "other").agg(F.first("n").alias("n"), F.first("other_n").alias("other_n"))


# --- forms ------------------------------------------------------------------------------------------------------------------------------------------

def last_forms(forms: DataFrame) -> DataFrame:
    """Rows (word, root): forms followed to their end, from rows (word, form) whose forms never lead in a circle. Each round doubles the steps taken."""
    steps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = stored(steps.join(further.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if now.where("_moved").isEmpty():
            return now.select("word", "root")
        steps = now.select("word", "root")


def spelling_variants(docs: DataFrame, ratio: int = RATIO, least_count: int = LEAST_COUNT, slip: int = SLIP,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n): every frequent word of the texts, its near words counted, and its usual form.

    The form is the near word of largest n, of equal ones the first in code-point order, if its n is at least ``ratio`` times the word's; else null, and the
    word its own root. Null and empty texts have no words, null ids draw like empty ones, repeated rows count as often as they stand; a table without
    rows gives none. Words are looked at whole, whatever the length of the text or the word.
    """
    words = stored(word_counts(docs, _LONGEST, least_count, slip, id_col, text_col))
    pairs = stored(near_words(words))
    ways = pairs.select("word", "other", "other_n").union(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = words.join(best.hint("merge"), "word", "left").withColumn("best_n", -F.col("best.less"))
    usual = F.col("best_n") >= ratio * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best.other")).alias("form"),
                                F.when(usual, F.col("best_n")).alias("form_n")))
    roots = last_forms(found.where("form is not null").select("word", "form"))
    return found.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
