"""Removal of long repeated byte strings with a run-length compressed Burrows-Wheeler index.

Steps, each a Spark plan over rows:

1. Texts of equal bytes fold into one class. Every long enough member of a class of two or more is repeated as a whole.
2. Winnowing routes work: of each ``length - q + 1`` neighbouring q-grams the one of least hash is the *anchor* of the ``length``-byte string that
   spans them, so equal strings have equal anchors. Anchor hashes seen once are counted away; they cannot lie in a repeated string.
3. What is left falls into snippets, the strings of one anchor in one place (at most ``2 * length`` bytes and a little). Equal snippets fold
   into a weight by a 128-bit key (hash and anchor): in a Burrows-Wheeler transform they would be runs of equal letters. A snippet with a
   weight of two is repeated as a whole, and an anchor with such a snippet alone is a single run.
4. Different snippets of one anchor are cut from one of their texts each and meet in one task. There an index is built over them: suffixes sorted, the transform kept as runs, the suffixes at run
   ends sampled, and the common prefix across each run border. Matching statistics stream over the texts: inside a run the match of a
   position is that of its left neighbour less one, so run ends alone decide. Positions matching ``length`` bytes or more are marked.
5. Anchors with more than ``GROUP`` different snippets (edges of a passage that a great many documents share) do not meet in one task: their
   strings are counted one by one by a 128-bit hash, an exact way of any size.
6. Marks return to the documents, join into runs, and the bytes left are kept.

No step keeps a list that grows with the corpus in one task; hot hashes are counted with partial sums, the joins on them can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from talentloom.llm.common import batches_of, mixed, releasing, row_key, slices

#: A repeated string has so many bytes.
LENGTH = 200
#: Most different snippets of an anchor that are sorted together.
GROUP = 4096
#: Bytes of snippets indexed at once in a task, and bytes of text hashed at once.
INDEX_BYTES, SHEET = 1_500_000, 200_000
_BASE = 0x9E3779B97F4A7C15
_BREAK = 0xFF  # in no UTF-8 text


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, inverse, np.uint64))


_POWERS: list[np.ndarray] = []


def gram_hashes(text: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram of some text."""
    n = len(text)
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = _powers(1 << max(19, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text + np.uint64(1)) * _POWERS[0][:n], out=total[1:])
    grams = total[q:] - total[:-q]
    grams *= _POWERS[1][: n - q + 1]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    return grams


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def sheets(texts: list[bytes], length: int) -> Iterator[tuple]:
    """Runs of starts of ``length``-byte strings with one anchor, for many texts at a time.

    Yields (text number, low, high, anchor, twice) arrays, a row per run: the starts low to high of a text have the anchor; twice tells that the
    anchor stands in two places of the run. Long texts come in slices, so memory is bounded.
    """
    wide = length - length // 2 + 1
    parts = ((k, at, text[at : at + SHEET + length - 1]) for k, text in enumerate(texts) for at in range(0, len(text) - length + 1, SHEET))
    for held in batches_of(parts, lambda part: len(part[2]), SHEET):
        number = np.array([k for k, _, _ in held])
        offset = np.array([at for _, at, _ in held])
        sizes = np.array([len(x) for _, _, x in held])
        first = np.cumsum(sizes) - sizes
        grams = gram_hashes(np.frombuffer(b"".join(x for _, _, x in held), np.uint8), length // 2)
        own = window_least(grams, wide)
        stop = first + sizes - length + 1
        edge = np.unique(np.concatenate((np.flatnonzero(own[1:] != own[:-1]) + 1, first, stop)))
        low, high = edge[:-1], edge[1:]
        part = np.searchsorted(first, low, "right") - 1
        inside = low < stop[part]
        low, high, part = low[inside], high[inside], part[inside]
        twice = _repeats_inside(grams, own, low, high, wide)
        yield number[part], low - first[part] + offset[part], high - first[part] + offset[part], own[low], twice


def _repeats_inside(grams: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, wide: int) -> np.ndarray:
    """Which runs of one anchor hold it in two places: long runs, and stretches of a text that goes in short circles."""
    twice = high - low > wide
    near = np.lib.stride_tricks.sliding_window_view(np.concatenate((grams, np.zeros(wide, np.uint64))), wide)[:: wide - 1]
    hits = np.flatnonzero((near[:, 1:] == near[:, :1]).any(axis=1)) * (wide - 1)  # a circle of the length of a string passes one of these places
    if len(hits):
        close = np.searchsorted(hits, high + 2 * wide) > np.searchsorted(hits, low - 2 * wide)
        for k in np.flatnonzero(close & ~twice).tolist():
            twice[k] = np.count_nonzero(grams[low[k] : high[k] + wide - 1] == own[low[k]]) > 1
    return twice


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def anchor_rows(length: int):
    """Rows (anchor, place, row): the anchors of each text; place tells a different place of a different text apart."""
    def run(batches):
        for batch in slices(batches):
            texts, row = [t.encode() for t in batch.column("text").to_pylist()], batch.column("row").to_numpy()
            whole = np.array([xxhash.xxh3_64_intdigest(t) if len(t) >= length else 0 for t in texts], np.uint64)
            for number, low, _, anchor, twice in sheets(texts, length):
                k = np.concatenate((np.arange(len(low)), np.flatnonzero(twice)))
                at = np.concatenate((low, low[twice] + (1 << 40))).astype(np.uint64)  # a second place, told by an offset beyond any text
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(anchor[k])), pa.array(_signed(mixed(whole[number[k]] + at))), pa.array(row[number[k]])], names=["anchor", "place", "row"])
    return run


def _snippets(batch: pa.RecordBatch, column: str, length: int):
    """(row, text, wanted values, [(low, high, anchor)]) per text: the snippets whose anchor is wanted."""
    wide = length - length // 2 + 1
    wanted = batch.column(column).to_pylist()
    held = [(t.encode(), r, w) for t, r, w in zip(batch.column("text").to_pylist(), batch.column("row").to_pylist(), wanted) if w]
    for number, low, high, anchor, _ in sheets([t for t, _, _ in held], length):
        border = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1], [True])))
        for a, b in zip(border[:-1].tolist(), border[1:].tolist()):
            text, row, w = held[number[a]]
            own = _signed(anchor[a:b])
            good = np.flatnonzero(np.isin(own, np.array([x if isinstance(x, int) else x["anchor"] for x in w], np.int64)))
            yield row, text, w, [(start, min(start + wide, last), x) for first, last, x in zip(low[a:b][good].tolist(), high[a:b][good].tolist(), own[good].tolist())
                                 for start in range(first, last, wide)]


def _mark(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece) - (1 << 63)


def place_rows(length: int):
    """Rows (anchor, mark, row, start, count): the snippets of repeated anchors, each by its hash, with the number of its starts."""
    def run(batches):
        for batch in slices(batches):
            out = [(x, _mark(text[low : high + length - 1]), row, low, high - low)
                   for row, text, _, found in _snippets(batch, "anchors", length) for low, high, x in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["anchor", "mark", "row", "start", "count"])
    return run


def snippet_rows(length: int):
    """Rows (anchor, mark, weight, crowded, snippet): the wanted snippets of each text, each once."""
    def run(batches):
        for batch in slices(batches):
            out, done = ([], [], [], [], []), set()
            for row, text, wanted, found in _snippets(batch, "wanted", length):
                weights = {(x["anchor"], x["mark"]): (x["weight"], x["crowded"]) for x in wanted}
                for low, high, anchor in found:
                    key = (anchor, _mark(text[low : high + length - 1]))
                    if key in weights and (row, key) not in done:
                        done.add((row, key))
                        for column, value in zip(out, (*key, *weights[key], text[low : high + length - 1])):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.bool_()), pa.array(out[4], pa.binary())],
                    names=["anchor", "mark", "weight", "crowded", "snippet"])
    return run


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of texts, with the suffixes at both ends of each run and the prefix shared over run borders."""

    def __init__(self, texts: list[bytes]):
        joined = bytes([_BREAK]).join(texts) + bytes([_BREAK])
        self.text = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.ends = np.repeat(self.starts + sizes - 1, sizes)  # end of the text that each position is in
        self.depth = int(sizes.max())
        padded = np.concatenate((self.text, np.zeros(8, np.uint8))).astype(np.uint64)
        words = np.zeros(len(self.text), np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | padded[k : k + len(self.text)]
        self.words = words
        order = self._suffixes()
        before = self.text[order - 1]
        border = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == _BREAK)) + 1  # the break before each text counts as a letter of its own
        run_start = np.concatenate(([0], border))
        run_end = np.concatenate((border, [len(order)])) - 1
        self.letters, self.lengths = before[run_start], run_end - run_start + 1
        self.first, self.last = order[run_start], order[run_end]
        self.shared = self._common(self.last[:-1], self.first[1:])

    def _suffixes(self) -> np.ndarray:
        """Positions in the order of what follows them, as deep as the longest text."""
        n = len(self.words)
        order = np.argsort(self.words)
        rank = self._ranks(order, self.words[order])
        deep = 8
        while deep < self.depth and rank[order[-1]] < n - 1:
            second = np.zeros(n, np.int64)
            second[: n - deep] = rank[deep:] + 1
            key = rank * (n + 1) + second
            order = np.argsort(key)
            rank = self._ranks(order, key[order])
            deep *= 2
        return order

    @staticmethod
    def _ranks(order: np.ndarray, values: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(values[1:] != values[:-1])))
        return rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b, as far as the text of either goes."""
        most = np.minimum(self.ends[a] - a, self.ends[b] - b)
        got = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            at = got[live]
            differ = self.words[a[live] + at] ^ self.words[b[live] + at]
            same = np.full(len(live), 8, np.int64)
            for k in range(7, -1, -1):
                same[(differ >> np.uint64(8 * (7 - k))) & np.uint64(0xFF) != 0] = k
            got[live] += same
            live = live[(same == 8) & (got[live] < most[live])]
        return np.minimum(got, most)

    def matching(self) -> np.ndarray:
        """For each position of the text, the bytes from there that also stand elsewhere, streamed from the run ends."""
        reach = np.zeros(len(self.text), np.int64)
        np.maximum.at(reach, self.first[1:], self.first[1:] + self.shared)
        np.maximum.at(reach, self.last[:-1], self.last[:-1] + self.shared)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(len(self.text)), 0)


def index_rows(length: int):
    """Snippets sorted by anchor -> rows (anchor, mark, low, high): runs of starts in a snippet that are repeated."""
    def found(groups):
        out = ([], [], [], [])
        held = [row for group in groups for row in group]
        index = RunIndex([row[2] for row in held])
        repeated = index.matching() >= length
        for row, start in zip(held, index.starts.tolist()):
            count = len(row[2]) - length + 1
            hit = np.full(count, True) if row[3] > 1 else repeated[start : start + count]
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            for low, high in zip(edge[::2].tolist(), edge[1::2].tolist()):
                for column, value in zip(out, (row[0], row[1], low, high)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["anchor", "mark", "low", "high"])

    def run(batches):
        groups, size, group = [], 0, []
        for batch in slices(batches):
            columns = [batch.column(c).to_pylist() for c in ("anchor", "mark", "snippet", "weight")]
            for row in zip(*columns):
                if group and group[0][0] != row[0]:
                    groups.append(group)
                    group = []
                    if size >= INDEX_BYTES:
                        yield found(groups)
                        groups, size = [], 0
                group.append(row)
                size += len(row[2])
        if group:
            groups.append(group)
        if groups:
            yield found(groups)
    return run


def single_rows(length: int):
    """Snippets of crowded anchors -> rows (anchor, mark, low, gram, weight): every string on its own, by a 128-bit hash."""
    def run(batches):
        for batch in slices(b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            out = ([], [], [], [], [])
            for anchor, mark, snippet, weight in zip(*[batch.column(c).to_pylist() for c in ("anchor", "mark", "snippet", "weight")]):
                for low in range(len(snippet) - length + 1):
                    for column, value in zip(out, (anchor, mark, low, xxhash.xxh3_128_digest(snippet[low : low + length]), weight)):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=["anchor", "mark", "low", "gram", "weight"])
    return run


def removed_runs(marks: list[dict] | None, whole: bool, size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked starts cover."""
    if whole and size >= length:
        return [(0, size)]
    runs: list[list[int]] = []
    for low, high in sorted((m["low"], m["high"]) for m in marks or ()):
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high + length - 1)
        else:
            runs.append([low, high + length - 1])
    return [tuple(r) for r in runs]


def kept_rows(length: int, carry: list[str], letters: bool):
    """Each row with its removed runs (byte offsets) and what is left; with ``letters``, letters cut at an edge go too."""
    def run(batches):
        for batch in slices(batches):
            texts, marks, whole = (batch.column(c).to_pylist() for c in ("text", "marks", "whole"))
            sizes, runs_out, left = [], [], []
            for text, mark, all_of_it in zip(texts, marks, whole):
                data = text.encode()
                runs = removed_runs(mark, bool(all_of_it), len(data), length)
                parts = [data[low:high] for low, high in zip([0] + [r[1] for r in runs], [r[0] for r in runs] + [len(data)])]
                if letters:
                    parts = [part.decode("utf-8", "ignore").encode() for part in parts]
                sizes.append(len(data))
                runs_out.append([{"low": a, "high": b} for a, b in runs])
                left.append(b"".join(parts))
            spans = pa.array(runs_out, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), spans, pa.array(left, pa.binary()), *[batch.column(c) for c in carry]],
                names=["id", "n_bytes", "spans", "kept", *carry])
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                   letters: bool = False) -> DataFrame:
    """Rows (id, n_bytes, spans, kept): per document the maximal runs of bytes covered by a ``length``-byte string that also starts elsewhere,
    in another document or another place of the same one, and the bytes outside them.

    Texts are UTF-8 bytes and matches stay inside a document. A null text counts as empty. Texts below ``length`` bytes lose nothing. Repeated
    rows and rows of equal id are documents of their own and come back as often as they came. Columns in ``carry`` come along as
    ``_<name>``, others are not read. An empty table gives no rows. ``letters`` drops letters that the edge of a run cuts.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"_{c}") for c in carry])
    keyed = base.withColumn("row", row_key("id", "text"))
    seen = keyed.select("text", "row").mapInArrow(releasing(anchor_rows(length)), "anchor long, place long, row long")
    repeated = seen.groupBy("anchor").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo <> hi").select("anchor")
    hits = seen.select("anchor", "row").join(repeated, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))

    folded = keyed.select("row", F.unhex(F.md5("text")).alias("key"))
    classes = folded.groupBy("key").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    members = folded.distinct().join(classes, "key").select("row", "rep", (F.col("copies") > 1).alias("whole"))

    first = members.where("row = rep").join(hits, "row").select("row", "anchors")
    texts = keyed.select("id", "text", "row")
    cut = (texts.join(first, "row", "left").select("id", "text", "row", "anchors").mapInArrow(
        releasing(place_rows(length)), "anchor long, mark long, row long, start long, count long"))
    different = cut.groupBy("anchor", "mark").agg(F.count("*").alias("weight"), F.min("row").alias("row"), F.max("count").alias("count"))
    groups = different.groupBy("anchor").agg(F.count("*").alias("n"), F.max("weight").alias("top"))
    weighed = different.join(groups, "anchor")
    wanted = (weighed.where("n > 1 or weight = 1").groupBy("row").agg(
        F.collect_list(F.struct("anchor", "mark", "weight", (F.col("n") > GROUP).alias("crowded"))).alias("wanted")))
    asked = texts.join(wanted, "row", "left").select("id", "text", "row", "wanted")
    snippets = asked.mapInArrow(releasing(snippet_rows(length)), "anchor long, mark long, weight long, crowded boolean, snippet binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    indexed = (snippets.where("not crowded").repartition(parts, "anchor").sortWithinPartitions("anchor", "mark").mapInArrow(
        releasing(index_rows(length)), "anchor long, mark long, low long, high long"))
    cut_out, one_by_one = snippet_rows(length), single_rows(length)
    singles = asked.mapInArrow(releasing(lambda batches: one_by_one(b.filter(b.column("crowded")) for b in cut_out(batches))),  # both in one worker
                               "anchor long, mark long, low long, gram binary, weight long")
    often = singles.groupBy("gram").agg(F.sum("weight").alias("times")).where("times > 1").select("gram")
    counted = singles.join(often, "gram").select("anchor", "mark", "low", (F.col("low") + 1).alias("high"))
    alone = weighed.where("n = 1 and weight > 1").select("anchor", "mark", F.lit(0).cast("long").alias("low"), F.col("count").alias("high"))
    places = cut.select("anchor", "mark", "row", "start").join(indexed.union(counted).union(alone), ["anchor", "mark"])
    marks = places.groupBy("row").agg(F.collect_list(F.struct(
        (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))).alias("marks"))

    facts = members.join(marks, "row", "left").where("whole or marks is not null").select("row", "whole", "marks")
    kinds = "".join(f", _{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return keyed.join(facts, "row", "left").mapInArrow(
        releasing(kept_rows(length, [f"_{c}" for c in carry], letters)),
        f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, spans array<struct<low:long,high:long>>, kept binary{kinds}")


def span_digest(spans: DataFrame) -> DataFrame:
    """One row per document: removed bytes, runs, and the digest of the bytes kept."""
    lengths: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["high"] - s["low"])
    return spans.select(F.col("id").alias("doc_id"), "n_bytes", lengths.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the repeated bytes taken out of their text, letters whole. Other columns stay; a null text becomes empty."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    left = repeated_spans(docs, length, id_col, text_col, others, letters=True)
    return left.select(*[
        F.col("id").alias(c) if c == id_col else F.col("kept").cast("string").alias(c) if c == text_col else F.col(f"_{c}").alias(c) for c in docs.columns])
