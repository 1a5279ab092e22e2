"""Fill-in-middle rows: a text is cut twice and its middle moved to the end, between marks.

Texts are handled as their UTF-8 bytes. Cuts are drawn in units of tokens, code points or bytes; slicing needs them in bytes, reports in code points.
``Exceptions`` is the index between the two: it records only the characters of more than one byte, by their code-point place and the bytes they have in
excess. A cut is converted by one search in these places; a text, or a stretch of it, without such characters costs nothing but a subtraction.

Draws come from a hash of the seed and the document's id, so that a row's form hangs neither on other rows nor on partitions. The work is one pass over
the rows without a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from talentloom.functions.values import let
from talentloom.llm.common import slices

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("token", "char", "byte")
#: Of 100 texts so many are rewritten, and so many of these with the suffix first.
RATE, SUFFIX_FIRST = 50, 80

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes beyond the first of a character, by its first byte; 0 for ASCII and for bytes inside a character.
_EXCESS = np.zeros(256, np.int64)
_EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:] = 1, 2, 3


class Exceptions:
    """Places and excess bytes of the multibyte characters of a text."""

    def __init__(self, data: np.ndarray):
        starts = np.flatnonzero(data >= 0xC0)
        excess = _EXCESS[data[starts]]
        self.after = np.concatenate([[0], np.cumsum(excess)])  # excess before each exception, and of all
        self.places = starts - self.after[:-1]
        self.ends = self.places + 1 + self.after[1:]  # byte behind each exception
        self.chars = len(data) - int(self.after[-1])

    def to_bytes(self, cuts):
        """Byte places of cuts before code points."""
        return cuts + self.after[np.searchsorted(self.places, cuts, "left")]

    def to_chars(self, cuts):
        """Code-point places of byte cuts; a cut inside a character moves before it."""
        ended = np.searchsorted(self.ends, cuts, "right")
        inside = np.append(self.places, self.chars)[ended]
        return np.minimum(cuts - self.after[ended], inside)


def token_ends(data: np.ndarray) -> np.ndarray:
    """Bytes behind the tokens of a text: white space with the word behind it, and white space at the end."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(data))


def draws(seed: int, key: str) -> list[int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def _cuts(data: np.ndarray, unit: str, one: int, two: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Units of a text, and its two cuts in bytes and in code points."""
    index = Exceptions(data)
    ends = token_ends(data) if unit == "token" else None
    n = len(ends) if unit == "token" else index.chars if unit == "char" else len(data)
    at = np.sort(np.array([one % (n + 1), two % (n + 1)], np.int64))
    if unit == "char":
        return n, index.to_bytes(at), at
    if unit == "token":
        at = np.append(0, ends)[at]
    chars = index.to_chars(at)
    return n, at if unit == "token" else index.to_bytes(chars), chars


def rewritten(data: bytes, key: str, unit: str, seed: int, rate: int, suffix_first: int) -> tuple:
    """(units, form, cuts in code points or None, output) of one text."""
    h1, h2, h3, h4 = draws(seed, key)
    n, cut, chars = _cuts(np.frombuffer(data, np.uint8), unit, h1, h2)
    if not data or h3 % 100 >= rate or any(mark.encode() in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, data
    before, middle, behind = data[: cut[0]], data[cut[0] : cut[1]], data[cut[1] :]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < suffix_first:
        return n, "spm", chars, b"".join([s, behind, p, before, m, middle])
    return n, "psm", chars, b"".join([p, before, s, behind, m, middle])


def fill_in_middle(docs: DataFrame, unit: str = "token", seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_units, form, prefix_chars, middle_chars, output): one for each row of the table.

    Form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain`` (the text as it is). Null and empty texts and texts that hold a
    mark stay plain, null as the empty text; a plain row has no cuts. A null id draws like an empty one; repeated ids draw alike, and each of their
    rows is given. A table without rows gives none, other columns play no part, and a text of any length is cut as a whole.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}, not {unit!r}")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            keys = batch.column("key").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            rows = [rewritten(t or b"", k or "", unit, seed, rate, suffix_first) for k, t in zip(keys, texts)]
            cuts = [(None, None) if c is None else (int(c[0]), int(c[1] - c[0])) for _, _, c, _ in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                pa.array([c[0] for c in cuts], pa.int64()), pa.array([c[1] for c in cuts], pa.int64()),
                pa.array([r[3] for r in rows], pa.binary()).cast(pa.string()),
            ], names=["id", "n_units", "form", "prefix_chars", "middle_chars", "output"])

    asked = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return asked.mapInArrow(run, f"id {kind}, n_units long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that a row was made of. The text of a marked row holds no mark, so its three marks are the only ones."""
    def joined(order):
        return let(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), lambda parts: F.concat(*[F.get(parts, F.lit(k)) for k in order]))

    return F.when(form == "psm", joined((1, 3, 2))).when(form == "spm", joined((2, 3, 1))).otherwise(output)


def row_digest(rows: DataFrame) -> DataFrame:
    """One row per document: units, form, cuts, and digests of the output and of the text rebuilt from it."""
    return rows.select(
        F.col("id").alias("doc_id"), F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


SQL = r"""
with drawn as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as tokens
  from documents),
numbers as (
  select *, len(tokens) as n, [cast('0x' || substr(h, 8 * k + 1, 8) as bigint) for k in range(4)] as r from drawn),
formed as (
  select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or r[3] % 100 >= 50 then 'plain'
                 when r[4] % 100 < 80 then 'spm' else 'psm' end as form,
         least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b
  from numbers),
cut as (
  select *, array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle, array_to_string(tokens[b + 1:n], '') as suffix
  from formed)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from cut
"""
