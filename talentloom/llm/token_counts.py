"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A text is cut into pre-tokens by the tokenizer's pattern; runs of ``LEAF`` of them are the leaves of a tree whose nodes hold characters and tokens below
them. An edit finds its leaves by characters, cuts and counts again from the leaf before the edit (a pre-token depends on what follows it, at most into the
next one) until a cut falls on the start of an old leaf beyond the edit, and writes the sums of these leaves and of their ancestors. All other leaves
stay. Tokens of a pre-token are counted by byte-pair merges and remembered by the worker.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from talentloom.llm.common import slices

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Cuts a text into pre-tokens, as the vocabulary was made (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a leaf; pre-tokens that a worker remembers at most.
LEAF, REMEMBERED = 32, 400_000


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Token bytes with their ranks, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Counter(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)

    def __missing__(self, piece: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class Tree:
    """Segment tree in heap order: node 1 is the root, leaves are ``width`` to ``2 * width - 1``; each node holds characters and tokens."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.width = len(chars) // 2

    @staticmethod
    def over(leaf_chars: np.ndarray, leaf_tokens: np.ndarray) -> Tree:
        width = 1 << max(0, int(len(leaf_chars) - 1).bit_length())
        both = []
        for leaves in (leaf_chars, leaf_tokens):
            nodes = np.zeros(2 * width, np.int64)
            nodes[width : width + len(leaves)] = leaves
            level = width
            while level > 1:
                nodes[level // 2 : level] = nodes[level : 2 * level : 2] + nodes[level + 1 : 2 * level : 2]
                level //= 2
            both.append(nodes)
        return Tree(*both)

    @staticmethod
    def of(text: str, counter: Counter) -> Tree:
        pieces = counter.cut.findall(text)
        if not pieces:
            return Tree.over(np.zeros(1, np.int64), np.zeros(1, np.int64))
        at = np.arange(0, len(pieces), LEAF)
        chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at)
        return Tree.over(chars, np.add.reduceat(np.fromiter(map(counter.__getitem__, pieces), np.int64, len(pieces)), at))

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last leaf with characters for the end of the text), and where it starts."""
        node, start = 1, 0
        place = min(max(place, 0), int(self.chars[1]) - 1)
        while node < self.width:
            left = int(self.chars[2 * node])
            node, start = (2 * node, start) if place - start < left else (2 * node + 1, start + left)
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """New sums of a leaf and of its ancestors."""
        node = leaf + self.width
        more, tokens_more = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more
            self.tokens[node] += tokens_more
            node //= 2


def apply_edit(text: str, tree: Tree, low: int, high: int, put: str, counter: Counter) -> tuple[str, Tree, int]:
    """Replace text[low:high]; gives the new text, its tree, and the characters that were cut and counted again."""
    new = text[:low] + put + text[high:]
    if not tree.chars[1] or not new:
        return new, Tree.of(new, counter), len(new)
    shift = len(new) - len(text)
    first, start = tree.find(low - 1)
    if first:
        first, start = tree.find(start - 1)  # the leaf before, for what looks ahead
    last, end = tree.find(high)
    end += int(tree.chars[last + tree.width])  # first character after the leaf that holds the end of the edit
    at, pieces = start, []
    while True:
        stop = min(end + shift, len(new))
        for found in counter.cut.finditer(new, at):
            pieces.append(found[0])
            at = found.end()
            if at >= stop:
                break
        if at <= stop or end >= len(text):
            break
        last, end = tree.find(end)  # the cut does not fall on the start of a leaf: one more
        end += int(tree.chars[last + tree.width])
    leaves = last - first + 1
    if len(pieces) > 4 * LEAF * leaves:
        return new, Tree.of(new, counter), len(new)
    bounds = np.linspace(0, len(pieces), leaves + 1).astype(int).tolist()
    for k in range(leaves):
        part = pieces[bounds[k] : bounds[k + 1]]
        tree.put(first + k, sum(map(len, part)), sum(map(counter.__getitem__, part)))
    return new, tree, at - start


def token_trees(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, chars, tokens): the nodes of each text's tree. A null text has the tree of an empty one."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = Counter(ranks.value)
        for batch in slices(batches):
            trees = [Tree.of(t or "", counter) for t in batch.column("text").to_pylist()]
            sizes = np.cumsum([0] + [len(t.chars) for t in trees]).astype(np.int32)
            nodes = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(v))) for v in ([t.chars for t in trees], [t.tokens for t in trees])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), *nodes], names=["id", "text", "chars", "tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, text string, chars array<long>, tokens array<long>")


def edited(trees: DataFrame, edits_of: Callable[[str], list[tuple[int, int, str]]], path: str = RANKS) -> DataFrame:
    """Rows (id, text, chars, tokens, n_edits, n_before, n_recounted) after the edits that ``edits_of`` gives for each text.

    Edits are (low, high, put) in characters of the text as it was, apart from each other and in any order. n_before is the count before them,
    n_recounted the characters cut and counted again. A null text stays null, without edits.
    """
    ranks = trees.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = trees.schema["id"].dataType.simpleString()

    def run(batches):
        counter = Counter(ranks.value)
        for batch in slices(batches):
            texts, out = [], []
            chars, tokens = batch.column("chars"), batch.column("tokens")
            for k, text in enumerate(batch.column("text").to_pylist()):
                tree = Tree(chars[k].values.to_numpy().copy(), tokens[k].values.to_numpy().copy())
                edits, before, again = sorted(edits_of(text), reverse=True) if text else [], tree.total, 0
                for low, high, put in edits:
                    text, tree, counted = apply_edit(text, tree, low, high, put, counter)
                    again += counted
                texts.append(text)
                out.append((tree, len(edits), before, again))
            sizes = np.cumsum([0] + [len(t.chars) for t, *_ in out]).astype(np.int32)
            nodes = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(v))) for v in ([t.chars for t, *_ in out], [t.tokens for t, *_ in out])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), *nodes, *[pa.array([r[c] for r in out], pa.int64()) for c in (1, 2, 3)]],
                                             names=["id", "text", "chars", "tokens", "n_edits", "n_before", "n_recounted"])

    return trees.mapInArrow(run, f"id {kind}, text string, chars array<long>, tokens array<long>, n_edits long, n_before long, n_recounted long")


_PRIVATE = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+?\d[\d ().-]{5,}\d")


def mask_private(text: str) -> list[tuple[int, int, str]]:
    """Edits that put marks in the place of e-mail addresses and long numbers."""
    return [(m.start(), m.end(), "[email]" if "@" in m[0] else "[number]") for m in _PRIVATE.finditer(text)]


def count_rows(found: DataFrame) -> DataFrame:
    """One row per document: tokens before and after, edits, characters before recounting."""
    return found.select(F.col("id").alias("doc_id"), "n_edits", F.col("n_before").alias("n_tokens_before"),
                        F.element_at("tokens", 2).alias("n_tokens"), F.element_at("chars", 2).alias("n_chars"), "n_recounted")
