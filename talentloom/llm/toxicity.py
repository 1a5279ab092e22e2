"""Toxicity of whole texts: gradient-boosted trees over dense features, with isotonic calibration.

Features count, per word of the text: words of two learned lexicons (sure and likely marks of toxic texts; whole words and stems of five letters), the same
written with digits or signs in the place of letters, second persons, lexicon words close to a second person, capitals, words in capitals,
punctuation, runs of marks, and words that mix letters with digits or signs; then counts and the length.

Lexicons, trees and calibration are fitted on disjoint parts of a bounded sample of labelled rows (``SAMPLE``). Everything else runs over every text:
one pass, no shuffle. Trees are grown in numpy on binned features.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from talentloom.llm.common import slices, stored

#: Most labelled documents that the model is fitted on, and most entries of the lexicons.
SAMPLE, ENTRIES = 20_000, 4000
#: Letters of a stem; least toxic texts with an entry; its share of toxic use at equal class sizes, for sure and for likely ones.
STEM, LEAST, SURE, LIKELY = 5, 5, 0.96, 0.85
#: Trees, their depth, rate, bins of a feature, weight of the prior in a leaf.
TREES, DEPTH, RATE, BINS, PRIOR = 80, 3, 0.15, 32, 2.0
#: Words on either side of a second person that are close to it.
CLOSE = 6
#: Second persons of English, German, French and Spanish (fixed values).
SECOND_PERSONS = frozenset("you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner ihr euch euer eure tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Letters that digits and signs stand for; one may be read in two ways.
_LETTERS = [str.maketrans("013457@$!", f"o{one}eastasi", "*._-'’") for one in "il"]
_SURE, _LIKELY, _SECOND, _CAPITALS, _MIXED, _HIDDEN = (1 << k for k in range(6))
FEATURES = ("sure", "likely", "hidden", "second", "close", "capitals", "shouted", "punctuation", "runs", "mixed", "n_sure", "n_likely", "n_close", "length")


def terms(word: str) -> tuple[str, ...]:
    """Lexicon terms of a bare lower-case word: itself and its stem."""
    return (word, word[:STEM] + "~") if len(word) > STEM else (word,)


class WordKinds(dict):
    """Kinds of a word as bits, remembered."""

    def __init__(self, sure: frozenset, likely: frozenset):
        super().__init__()
        self.sure, self.likely = sure, likely

    def __missing__(self, raw: str) -> int:
        word = _EDGE.sub("", raw)
        low, kinds = word.lower(), 0
        if low:
            found = terms(low)
            kinds |= _SURE * (not self.sure.isdisjoint(found)) | _LIKELY * (not self.likely.isdisjoint(found)) | _SECOND * (low in SECOND_PERSONS)
            if len(word) > 2 and word.isupper() and word.isalpha():
                kinds |= _CAPITALS
            if not word.isalpha() and any(c.isalpha() for c in word):
                kinds |= _MIXED
                plain = {t for letters in _LETTERS for t in terms(low.translate(letters))}
                if not kinds & (_SURE | _LIKELY) and not (self.sure.isdisjoint(plain) and self.likely.isdisjoint(plain)):
                    kinds |= _HIDDEN
        self[raw] = kinds
        return kinds


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_UPPER, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_MARKS[[ord("!"), ord("?")]] = True


def features(text: str | None, kinds: WordKinds) -> list[float]:
    """The features of a text; zeros for an empty one."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    if len(kinds) > 300_000:
        kinds.clear()
    found = np.fromiter(map(kinds.__getitem__, words), np.uint8, len(words))
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(words)
    marked = np.flatnonzero(found & (_SURE | _LIKELY | _HIDDEN))
    second = np.flatnonzero(found & _SECOND)
    close = 0
    if len(marked) and len(second):
        at = np.searchsorted(second, marked)
        ahead = second[np.minimum(at, len(second) - 1)] - marked
        behind = marked - second[np.maximum(at - 1, 0)]
        close = int(np.count_nonzero((np.abs(ahead) <= CLOSE) | (np.abs(behind) <= CLOSE)))
    sure, likely, hidden = (int(np.count_nonzero(found & bit)) for bit in (_SURE, _LIKELY, _HIDDEN))
    marks = _MARKS[data]
    return [sure / n, likely / n, hidden / n, len(second) / n, close / n, np.count_nonzero(_UPPER[data]) / len(data), np.count_nonzero(found & _CAPITALS) / n,
            np.count_nonzero(_PUNCTUATION[data]) / len(data), np.count_nonzero(marks[1:] & marks[:-1]) / n, np.count_nonzero(found & _MIXED) / n,
            float(sure), float(likely), float(close), float(np.log1p(n))]


class Trees:
    """Boosted trees for a yes or no label, on binned features."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.start = 0.0
        self.trees: list[list[tuple[int, int, float]]] = []  # heap order: feature (-1: leaf), bin, value

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1).astype(np.int64) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])) for v in x.T]
        self.edges = [np.unique(np.append(e, [0.0])) for e in self.edges]
        self.edges = [e if len(e) < BINS else e[: BINS - 1] for e in self.edges]
        b = self.bins(x)
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(rate / (1 - rate)))
        total = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            tree = self._grow(b, p - y, p * (1 - p))
            self.trees.append(tree)
            total += self._leaves(tree, b)
        return self

    def _grow(self, b: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float]]:
        tree: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (DEPTH + 1))
        rows_of = {1: np.arange(len(b))}
        for node in range(1, 2 ** (DEPTH + 1)):
            rows = rows_of.pop(node, None)
            if rows is None:
                continue
            g, h = gradient[rows], weight[rows]
            tree[node] = (-1, 0, float(-RATE * g.sum() / (h.sum() + PRIOR)))
            if node >= 2**DEPTH or len(rows) < 20:
                continue
            best = (1e-6, -1, 0)
            for k in range(b.shape[1]):
                left_g = np.cumsum(np.bincount(b[rows, k], g, BINS))[:-1]
                left_h = np.cumsum(np.bincount(b[rows, k], h, BINS))[:-1]
                right_g, right_h = g.sum() - left_g, h.sum() - left_h
                gain = left_g**2 / (left_h + PRIOR) + right_g**2 / (right_h + PRIOR) - g.sum() ** 2 / (h.sum() + PRIOR)
                gain[(left_h < 0.5) | (right_h < 0.5)] = 0
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), k, at)
            if best[1] >= 0:
                tree[node] = (best[1], best[2], 0.0)
                right = b[rows, best[1]] > best[2]
                rows_of[2 * node], rows_of[2 * node + 1] = rows[~right], rows[right]
        return tree

    @staticmethod
    def _leaves(tree: list[tuple[int, int, float]], b: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree))
        node = np.ones(len(b), np.int64)
        for _ in range(DEPTH):
            k = feature[node]
            node = np.where(k >= 0, 2 * node + (b[np.arange(len(b)), np.maximum(k, 0)] > cut[node]), node)
        return value[node]

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.start + sum((self._leaves(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising fit of y on x (pool adjacent violators), each pool drawn half a case to the middle."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, lowest x, highest x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            s, n, _, high = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = high
    at = [v for p in pools for v in ((p[2], p[3]) if p[3] > p[2] else (p[2],))]
    value = [(p[0] + 0.5) / (p[1] + 1) for p in pools for _ in range(2 if p[3] > p[2] else 1)]
    return np.array(at), np.maximum.accumulate(np.array(value))


class Model:
    """Lexicons, trees and calibration."""

    def __init__(self, sure: frozenset, likely: frozenset, trees: Trees | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.sure, self.likely, self.trees, self.knots = sure, likely, trees, knots

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        logits = self.trees.logits(x)
        if self.knots is not None:
            return np.interp(logits, *self.knots)
        return 1 / (1 + np.exp(-logits))


def _term_counts(batches):
    for batch in slices(batches):
        counts: dict[tuple[str, int], int] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = {_EDGE.sub("", w).lower() for w in set((text or "").split())}
            for term in {t for w in words if w for t in terms(w)}:
                counts[term, toxic] = counts.get((term, toxic), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()),
                                          pa.array(list(counts.values()), pa.int64())], names=["term", "toxic", "n"])


def lexicons(rows: DataFrame) -> tuple[frozenset, frozenset]:
    """Sure and likely terms of (text, toxic) rows: distributed counts, at most ``ENTRIES`` of them come to the driver."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not sizes.get(1) or not sizes.get(0):
        return frozenset(), frozenset()
    counts = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_term_counts, "term string, toxic int, n long")
    toxic, clean = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    share = (F.col("a") / sizes[1]) / (F.col("a") / sizes[1] + (F.col("b") + 0.2) / sizes[0])
    kept = (counts.groupBy("term").agg(toxic.alias("a"), clean.alias("b")).where(F.col("a") >= LEAST).withColumn("share", share)
            .where(F.col("share") >= LIKELY).orderBy(F.desc("a"), "term").limit(ENTRIES).select("term", "share").collect())
    return frozenset(r["term"] for r in kept if r["share"] >= SURE), frozenset(r["term"] for r in kept if r["share"] < SURE)


def _feature_rows(sure: frozenset, likely: frozenset):
    def run(batches):
        kinds = WordKinds(sure, likely)
        for batch in slices(batches):
            x = [features(t, kinds) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("part"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "part", "x"])
    return run


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """At most ``SAMPLE`` labelled rows (text, toxic, part) outside the held-out fold; part deals them to lexicons (0-4), trees (5-7), calibration (8, 9)."""
    marks = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"), folds, fold))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("draw", F.xxhash64("doc_id")))
    sample = marks.orderBy("draw", "doc_id").limit(SAMPLE)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most SAMPLE rows of three numbers
    return found.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", F.pmod(F.shiftright("draw", 20), F.lit(10)).cast("int").alias("part"))


def train(rows: DataFrame) -> Model:
    """Model of (text, toxic, part) rows. Without both labels every score is 0; too few rows to calibrate keep the trees' own probability."""
    rows = stored(rows)
    sure, likely = lexicons(rows.where("part < 5"))
    got = rows.where("part >= 5").mapInArrow(_feature_rows(sure, likely), "toxic int, part int, x array<double>").toArrow()  # bounded by SAMPLE
    y, part = (np.array(got.column(c).to_pylist(), np.int64) for c in ("toxic", "part"))
    x = np.array(got.column("x").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y, part))  # in an order that does not hang on the tasks
    x, y, part = x[order], y[order], part[order]
    grown, held = part < 8, part >= 8
    if len(set(y[grown].tolist())) < 2:
        return Model(sure, likely, None, None)
    trees = Trees().fit(x[grown], y[grown].astype(float))
    enough = min(np.count_nonzero(y[held] == 1), np.count_nonzero(y[held] == 0)) >= 20
    return Model(sure, likely, trees, isotonic(trees.logits(x[held]), y[held].astype(float)) if enough else None)


def _scored(shared):
    def run(batches):
        model = shared.value
        kinds = WordKinds(model.sure, model.likely)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            x = np.array([features(t, kinds) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
            score = np.clip(model.scores(x), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], names=["id", "score"])
    return run


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) of every text. A null or empty text has zero features and gets the score of these."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicons of at most ENTRIES terms and a fixed number of trees
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _scored(shared), f"id {docs.schema[id_col].dataType.simpleString()}, score double")


def held_out(id_column: Column, folds: int = 5, fold: int = 0) -> Column:
    """Rows whose crc32 of the id as text leaves ``fold``; a null id is in no fold held out."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(folds)) == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of documents, by a model of labelled rows outside the held-out fold."""
    found = scored(docs, train(training_rows(docs, labels)))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
