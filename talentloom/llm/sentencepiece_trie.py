"""SentencePiece encoding and decoding with one forward pass over a trie of words.

A text is marked (a leading mark, marks for spaces) and cut before each run of marks; no piece reaches over such a cut. The distinct marked
words of a stretch of rows are sorted, which is a depth-first walk of their trie: from one word to the next, only the forward scores beyond the
common prefix are computed anew.

Forward pass: ``best[i]`` is the best path that ends at letter i, extended by each piece that ends there.
* Unigram vocabulary: paths are compared by the sum of piece scores.
* Byte-pair vocabulary: a path is open only if each two neighbouring pieces would stay apart when merged by rank (their joined text encodes to just
  these two). One path per prefix is open, and it is the merged encoding; so results are those of the merge procedure.
Letters outside the vocabulary become their bytes. The vocabulary is read on the driver and broadcast: its size is that of the file.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talentloom.llm.common import keeps, releasing, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words and neighbouring pairs that a worker remembers at most; characters of text whose words form one trie.
REMEMBERED, PAIRS, STRETCH = 300_000, 400_000, 2_500_000


class Vocabulary:
    """Pieces with ids and scores, and the kind of model."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str, byte_ids: dict[int, int], control: set[int], unknown: int):
        self.pieces, self.scores, self.kind, self.byte_ids, self.unknown = pieces, scores, kind, byte_ids, unknown
        self.ids = {p: i for i, p in enumerate(pieces) if i not in control and i not in byte_ids.values() and i != unknown}
        #: Every ending of a piece, with the piece that it is, or -1.
        self.endings = {p[k:]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.outside = min(scores) - 10.0
        spelled = {i: bytes([b]) for b, i in byte_ids.items()}
        self.bytes = [spelled.get(i, b"" if i in control else p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)]

    @staticmethod
    def load(path: str = MODEL, kind: str | None = None) -> Vocabulary:
        """Vocabulary of a model file. kind: ``bpe`` or ``unigram``; else as the scores tell (ranks are whole numbers)."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.get_piece_size())
        pieces, scores = [model.id_to_piece(i) for i in size], [model.get_score(i) for i in size]
        by_byte = {int(pieces[i][3:5], 16): i for i in size if model.is_byte(i)}
        control = {i for i in size if model.is_control(i) or model.is_unused(i)}
        normal = [s for i, s in enumerate(scores) if i not in control and not model.is_byte(i) and not model.is_unknown(i)]
        return Vocabulary(pieces, scores, kind or ("bpe" if all(s == int(s) for s in normal) else "unigram"), by_byte, control, model.unk_id())


class Encoder:
    """Encodes sorted words by a forward pass that shares prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.apart: dict[int, bool] = {}  # by the pair of neighbours as one number
        self.size = len(vocabulary.pieces)

    def merged(self, text: str) -> list[str]:
        """Letters merged by rank, the best pair first, the leftmost of equals."""
        parts, ids, scores = list(text), self.v.ids, self.v.scores
        while len(parts) > 1:
            pairs = [(scores[i], -k) for k in range(len(parts) - 1) if (i := ids.get(parts[k] + parts[k + 1])) is not None]
            if not pairs:
                break
            k = -max(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def open(self, before: int, piece: int) -> bool:
        """Whether a piece may follow another one (-1: a border) under the merge procedure."""
        if before < 0:
            known = len(self.merged(self.v.pieces[piece])) == 1
        else:
            a, b = self.v.pieces[before], self.v.pieces[piece]
            known = self.merged(a + b) == [a, b]
        self.apart[before * self.size + piece] = known
        return known

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word of a sorted list."""
        endings, scores, outside, apart, size = self.v.endings, self.v.scores, self.v.outside, self.apart, self.size
        unigram = self.v.kind == "unigram"
        if len(apart) > PAIRS:
            apart.clear()
        before = ""
        last, back, total = [-1], [0], [0.0]  # per prefix: last piece (-1: none or bytes), where it starts, score of the path
        out = []
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del last[same + 1 :], back[same + 1 :], total[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                found, start, score, low = -1, end - 1, None, end - 1
                while low >= 0:
                    piece = endings.get(word[low:end])
                    if piece is None:
                        break
                    if piece >= 0:
                        if unigram:
                            if score is None or total[low] + scores[piece] > score:
                                found, start, score = piece, low, total[low] + scores[piece]
                        else:
                            may = apart.get(last[low] * size + piece)
                            if self.open(last[low], piece) if may is None else may:
                                found, start, score = piece, low, 0.0
                                break
                    low -= 1
                last.append(found)
                back.append(start)
                total.append(total[end - 1] + outside if score is None else score)
            before = word
            path, at = [], len(word)
            while at:
                if last[at] >= 0:
                    path.append(last[at])
                else:
                    path.extend(reversed(self.spelled(word[back[at] : at])))
                at = back[at]
            path.reverse()
            out.append(path)
        return out

    def spelled(self, letters: str) -> list[int]:
        got = [self.v.byte_ids.get(b) for b in letters.encode()]
        return [self.v.unknown] if None in got else got


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def cutter(vocabulary: Vocabulary) -> re.Pattern:
    """Cuts a marked text into words: before each run of marks and around line ends, if these are in no piece."""
    if any("\n" in p for p in vocabulary.ids):
        return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
    return re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")


_OWNER = "sentencepiece"
_WORKER: dict[int, tuple[Encoder, dict[str, bytes]]] = {}


def _memory(vocabulary: Vocabulary) -> tuple[Encoder, dict[str, bytes]]:
    """Encoder and known words of this worker; the encoder stays from task to task while the vocabulary does, the words of a task go with it."""
    key = hash((vocabulary.kind, tuple(vocabulary.pieces), tuple(vocabulary.scores)))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(vocabulary), {}
        keeps(_OWNER, _WORKER.clear)
    return _WORKER[key]


def _encoded(shared, text_name: str, names: list[str]):
    def run(batches):
        encoder, known = _memory(shared.value)
        cut = cutter(shared.value)

        def rows(part: pa.RecordBatch, words: list[list[str] | None]) -> pa.RecordBatch:
            every = set().union(*[ws for ws in words if ws])
            new = every.difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = every
            new = sorted(new)
            known.update(zip(new, (array("i", x).tobytes() for x in encoder.encode(new))))
            joined = [b"".join(map(known.__getitem__, ws)) if ws else b"" for ws in words]
            offsets = np.cumsum([0] + [len(j) // 4 for j in joined]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(joined), np.int32)), mask=pa.array([ws is None for ws in words]))
            return pa.RecordBatch.from_arrays([*part.columns, ids], names=[*names, "ids"])

        for batch in batches:
            texts, at = batch.column(text_name), 0
            while at < batch.num_rows:
                size, end, words = 0, at, []
                while end < batch.num_rows and (end == at or size < STRETCH):
                    text = texts[end].as_py()
                    words.append(None if text is None else cut.findall(marked(text)))
                    size += len(text or "")
                    end += 1
                yield rows(batch.slice(at, end - at), words)
                at = end
        known.clear()
    return run


def encoded(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """The rows, columns as c0, c1 and so on, with ``ids`` last: the piece ids of the whole text; empty for an empty text, null for null."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.toDF(*names).mapInArrow(releasing(_encoded(shared, names[docs.columns.index(text_col)], names), _OWNER), f"{schema}, ids array<int>")


def spell(ids, table: list[bytes]) -> str:
    """Text of piece ids: joined pieces, marks as spaces, the leading one gone. Broken byte runs show as U+FFFD."""
    text = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _decoded(shared, names: list[str]):
    def run(batches):
        table = shared.value.bytes
        for batch in slices(batches):
            column = batch.column("ids")
            values, offsets, null = column.values.to_numpy(), column.offsets.to_numpy(), column.is_null().to_pylist()
            texts = [None if null[k] else spell(values[offsets[k] : offsets[k + 1]].tolist(), table) for k in range(len(column))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])
    return run


def decoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows with ``decoded`` last: the text of their ``ids``, null for null."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    return rows.mapInArrow(releasing(_decoded(shared, rows.columns), _OWNER), f"{schema}, decoded string")


def round_trip(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids, n_pieces, round_trip): the ids of each text, and whether they spell it again. A null text has null ids, 0 pieces, and spells null.

    Texts that hold the mark itself (U+2581) spell a space in its place.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    encode, decode = _encoded(shared, "c1", ["c0", "c1"]), _decoded(shared, ["c0", "c1", "ids"])
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, text_col)]
    rows = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1")).mapInArrow(  # both ways in one worker
        releasing(lambda batches: decode(encode(batches)), _OWNER), f"c0 {kinds[0]}, c1 {kinds[1]}, ids array<int>, decoded string")
    return rows.select(F.col("c0").alias("doc_id"), "ids", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
                       F.col("decoded").eqNullSafe(F.col("c1")).alias("round_trip"))


def id_digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.greatest("n_pieces", F.lit(0)).alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
