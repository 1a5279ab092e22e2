"""Language of a text: averaged embeddings of hashed subwords under a linear softmax, trained by stochastic gradient descent in numpy.

A word, in lower case and without what is no letter, gives its hashed n-grams of bytes with its borders, and itself. The mean of their vectors, times a
matrix, gives a score per language. The model is fitted on the driver on a bounded sample of labelled rows (``PER_LANGUAGE`` documents of
each language, a few short stretches of words of each). A held-back part of the sample sets the temperature of the probabilities and the bar
below which a prediction is rejected. Prediction is linear, so every task sums one small vector per word, remembered, over the whole text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from talentloom.llm.common import mixed, releasing, slices

#: Most labelled documents of a language that the model is fitted on, and words in the stretches taken of each.
PER_LANGUAGE, STRETCHES = 1000, (3, 8, 30)
#: Hash buckets, size of a vector, lengths of n-grams of bytes.
BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (2, 3, 4)
#: Passes over the sample, rate of learning, rows of a step.
PASSES, RATE, STEP = 6, 0.5, 32
#: Share of held-back stretches, and share of them that the bar of rejection may cost.
HELD_BACK, REJECTED = 0.15, 0.0005
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(word: str) -> str:
    return word if word.isalpha() else _NO_LETTER.sub("", word)


def buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word and of the word itself, and the place of their word; none for a word without letters."""
    marked = [f"<{w}>".encode() if w else b"" for w in map(letters, words)]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    place = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes from here to the end of the word
    values, places = [], []
    for n in GRAMS:
        starts = np.flatnonzero(left >= n)
        total = np.full(len(starts), n, np.uint64)
        for k in range(n):
            total = (total + data[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
        values.append(total)
        places.append(place[starts])
    if len(data):
        some = np.flatnonzero(sizes)
        whole = (data + np.uint64(1)) * mixed(left.astype(np.uint64))
        values.append(np.add.reduceat(whole, (np.cumsum(sizes) - sizes)[some]))
        places.append(some)
    return (mixed(np.concatenate(values)) % np.uint64(BUCKETS)).astype(np.int32), np.concatenate(places)


class Model:
    """Languages, score of each bucket for each language, temperature, and the bar of rejection."""

    def __init__(self, languages: list[str], scores: np.ndarray, temperature: float = 1.0, bar: float = 0.0):
        self.languages, self.scores, self.temperature, self.bar = languages, scores, temperature, bar

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        return softmax(logits * self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _means(table: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[values], starts, axis=0) / sizes[:, None]


def fit(values: np.ndarray, sizes: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Model:
    """Model of examples given as runs of buckets; every eighth or so example is held back for the temperature and the bar."""
    if not len(sizes):
        return Model(languages, np.zeros((BUCKETS, max(1, len(languages))), np.float32))
    rng = np.random.default_rng(seed)
    starts = np.cumsum(sizes) - sizes
    order = rng.permutation(len(sizes))
    back, train = order[: int(len(order) * HELD_BACK)], order[int(len(order) * HELD_BACK) :]
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    matrix = np.zeros((WIDTH, len(languages)), np.float32)
    matrix[:] = rng.normal(0, 0.1, matrix.shape)
    weight = len(labels) / (len(languages) * np.maximum(np.bincount(labels, minlength=len(languages)), 1))
    done, total = 0, PASSES * len(train)
    for _ in range(PASSES):
        rng.shuffle(train)
        for at in range(0, len(train), STEP):
            rows = train[at : at + STEP]
            n = sizes[rows]
            ids = np.concatenate([values[starts[r] : starts[r] + k] for r, k in zip(rows.tolist(), n.tolist())])
            first = np.cumsum(n) - n
            hidden = _means(table, ids, first, n)
            error = softmax(hidden @ matrix)
            error[np.arange(len(rows)), labels[rows]] -= 1
            error *= weight[labels[rows]][:, None]
            rate = RATE * (1 - done / total)
            back_hidden = (error @ matrix.T) / n[:, None]
            matrix -= (rate / len(rows) * 4 * (hidden.T @ error)).astype(np.float32)
            np.add.at(table, ids, (-rate * np.repeat(back_hidden, n, axis=0)).astype(np.float32))
            done += len(rows)
    model = Model(languages, (table @ matrix).astype(np.float32))
    if len(back):
        ids = np.concatenate([values[starts[r] : starts[r] + k] for r, k in zip(back.tolist(), sizes[back].tolist())])
        logits = _means(model.scores, ids, np.cumsum(sizes[back]) - sizes[back], sizes[back])
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(np.maximum(softmax(logits * t)[np.arange(len(back)), labels[back]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        top = model.probabilities(logits)
        right = top.max(axis=1)[top.argmax(axis=1) == labels[back]]
        model.bar = float(min(np.quantile(right, REJECTED), 1.5 / max(len(languages), 2))) if len(right) else 0.0
    return model


def stretches(text: str) -> list[list[int]]:
    """Buckets of a few stretches of words, spread over the text."""
    words, out = text.lower().split(), []
    for k, size in enumerate(STRETCHES):
        at = zlib.crc32(f"{k} {len(words)} {text[:40]}".encode()) % max(1, len(words) - size + 1)
        ids = buckets(words[at : at + size])[0].tolist()
        if ids:
            out.append(ids)
    return out


def _examples(batches):
    for batch in slices(batches):
        values, langs = [], []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            for ids in stretches(text):
                values.append(ids)
                langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.int32())), pa.array(langs, pa.string())], names=["ids", "lang"])


def train(labelled: DataFrame) -> Model:
    """Model of (id, text, lang) rows; rows without text or lang are passed over. Reads at most ``PER_LANGUAGE`` texts of each language."""
    known = labelled.where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return Model([], np.zeros((BUCKETS, 1), np.float32))
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, 1.3 * PER_LANGUAGE / n))))])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    sample = (known.withColumn("draw", draw).where(F.col("draw") <= F.element_at(share, F.col("lang"))).withColumn("rank", rank)
              .where(F.col("rank") <= PER_LANGUAGE).select("id", "text", "lang"))
    got = sample.select("text", "lang").mapInArrow(releasing(_examples), "ids array<int>, lang string").toArrow()  # bounded by the sample
    languages = sorted(counts)
    ids = got.column("ids").combine_chunks()
    ids = ids if isinstance(ids, pa.ListArray) else ids.chunk(0) if ids.num_chunks else pa.array([], pa.list_(pa.int32()))
    langs = np.array([languages.index(x) for x in got.column("lang").to_pylist()], np.int64)
    sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
    values = ids.values.to_numpy()[ids.offsets[0].as_py() : ids.offsets[-1].as_py()] if len(ids) else np.zeros(0, np.int32)
    rows = np.lexsort((np.arange(len(sizes)), [zlib.crc32(v.tobytes()) for v in np.split(values, np.cumsum(sizes)[:-1])])) if len(sizes) else np.zeros(0, int)
    starts = np.cumsum(sizes) - sizes  # in an order that does not hang on the tasks
    values = np.concatenate([values[starts[r] : starts[r] + sizes[r]] for r in rows]) if len(rows) else values
    return fit(values, sizes[rows], langs[rows], languages)


#: Words with their scores that a worker remembers at most.
REMEMBERED = 150_000


def _predictions(model, text_name: str, names: list[str]):
    def run(batches):
        m = model.value
        classes = max(1, len(m.languages))

        rows: dict[str, int] = {}
        table = np.zeros((0, classes + 1))  # per word the summed scores and the number of buckets

        for batch in slices(batches):
            texts = batch.column(text_name).to_pylist()
            split = [t.lower().split() if t else [] for t in texts]
            every = set().union(*split)
            new = list(every.difference(rows))
            if len(rows) + len(new) > REMEMBERED:
                rows.clear()
                table, new = table[:0], list(every)
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            values, place = buckets(new)
            fresh = [np.bincount(place, m.scores[values, k], len(new)) for k in range(classes)] + [np.bincount(place, minlength=len(new))]
            table = np.concatenate((table, np.stack(fresh, axis=1))) if new else table
            sums = np.zeros((len(texts), classes + 1))
            for k, words in enumerate(split):
                if words:
                    sums[k] = table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
            some = (sums[:, -1] > 0) & (len(m.languages) > 0)
            p = m.probabilities(sums[:, :-1] / np.maximum(sums[:, -1:], 1)) if len(texts) else np.zeros((0, classes))
            best = p.argmax(axis=1)
            score = np.where(some, p.max(axis=1) if len(texts) else 0, 0.0)
            lang = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(~some | (score < m.bar))],
                names=[*names, "lang_pred", "score", "rejected"])
    return run


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred, score and rejected as last columns, columns of the input as c0, c1 and so on.

    A null text, a text without letters, and every text if no language was learned are ``und`` with score 0 and rejected. Others get the
    likeliest language, and are rejected if its calibrated probability is below the model's bar.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    schema = ", ".join(f"{n} {t.dataType.simpleString()}" for n, t in zip(names, docs.schema.fields))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages
    return docs.toDF(*names).mapInArrow(releasing(_predictions(shared, names[docs.columns.index(text_col)], names)), f"{schema}, lang_pred string, score double, rejected boolean")


def held_out(id_column: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows whose crc32 of the id as text leaves ``fold``; a null id is in no fold held out."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(folds)) == fold, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Labelled rows outside the held-out fold, as (id, text, lang)."""
    seen = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return seen.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))


def languages(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, rejected) of documents, by a model of the rows outside the held-out fold."""
    found = identified(docs.select("doc_id", "text"), train(training_rows(docs)))
    return found.select(F.col("c0").alias("doc_id"), held_out(F.col("c0")).alias("held_out"), "lang_pred", "score", "rejected")


def without_rejected(docs: DataFrame) -> DataFrame:
    """The documents whose language the model does not reject, all columns."""
    found = identified(docs, train(training_rows(docs))).where("not rejected")
    return found.drop("lang_pred", "score", "rejected").toDF(*docs.columns)
