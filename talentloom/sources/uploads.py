"""Uploaded files: scan, size gate, media routing, text of the text and docx routes."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talentloom import rules
from talentloom.functions.text import file_suffix

ROUTE_TEXT, ROUTE_DOCX, ROUTE_EXTERNAL, ROUTE_FALLBACK, ROUTE_REJECTED = (
    "text", "docx", "external_text", "text_fallback", "unsupported",
)


def scan_uploads(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``: path, file_name, file_size, modified_at, content.

    ``content`` is only read when a later step asks for it, so gates on name and
    size cost a listing, not a read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return describe_files(files)


def describe_files(files: DataFrame) -> DataFrame:
    """Name the columns of a binaryFile scan (batch or stream).

    The name comes from the file metadata: a filter on it, or on a route made
    from it, then skips files before they are opened. Metadata names are
    URL-encoded.
    """
    stored = F.col("_metadata.file_name")
    name = F.coalesce(F.try_url_decode(F.regexp_replace(stored, r"\+", "%2B")), stored)
    return files.select(
        "path",
        name.alias("file_name"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified_at"),
        "content",
    )


def size_gate(df: DataFrame, size: str = "file_size", limit: int = rules.MAX_FILE_BYTES) -> DataFrame:
    """Add ``accepted`` and ``reject_reason``; only sizes above the limit are rejected."""
    over = F.col(size) > limit
    megabytes = 1024 * 1024
    reason = F.format_string(rules.TOO_LARGE.replace("%g", f"{limit / megabytes:g}"), F.col(size) / megabytes)
    return df.withColumn("accepted", ~over).withColumn("reject_reason", F.when(over, reason))


def media_type_of(name: Column) -> Column:
    """Media type from the file suffix."""
    table = F.create_map(*[F.lit(x) for pair in rules.MEDIA_BY_SUFFIX.items() for x in pair])
    suffix = F.lower(F.substring(file_suffix(name), 2, 10))
    return F.coalesce(F.try_element_at(table, suffix), F.lit(rules.MEDIA_UNKNOWN))


def route_media(df: DataFrame, strict: bool = False, file_type: str = "file_type") -> DataFrame:
    """Add ``route``.

    PDF and images are handed to an outside text extractor (``external_text``,
    they come back as pages); other types fall back to plain text. ``strict``
    rejects files whose suffix is not in the supported list instead.
    """
    media = F.coalesce(F.col(file_type), F.lit(""))
    route = (
        F.when(media == rules.MEDIA_PDF, ROUTE_EXTERNAL)
        .when(media.isin(rules.MEDIA_DOCX, rules.MEDIA_DOC), ROUTE_DOCX)
        .when(media.startswith(rules.MEDIA_IMAGE_PREFIX), ROUTE_EXTERNAL)
        .when(media == rules.MEDIA_TEXT, ROUTE_TEXT)
        .otherwise(ROUTE_FALLBACK)
    )
    if strict:
        suffix = F.lower(F.substring(file_suffix(F.col("file_name")), 2, 10))
        supported = suffix.isin(*rules.SUPPORTED_SUFFIXES)
        route = F.when(supported, route).otherwise(ROUTE_REJECTED)
    return df.withColumn("route", route)


def external_hand_off(routed: DataFrame) -> DataFrame:
    """The list for the outside extractor: accepted files of the pdf and image routes."""
    accepted = routed.filter(F.col("accepted")) if "accepted" in routed.columns else routed
    keep = [c for c in ("id", "path", "file_name", "file_type") if c in routed.columns]
    return accepted.filter(F.col("route") == ROUTE_EXTERNAL).select(*keep)


def decoded_text(content: Column) -> Column:
    """Strict UTF-8; one bad byte makes the text empty. Line ends become ``\\n``."""
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def decode_text(df: DataFrame) -> DataFrame:
    return df.withColumn("raw_text", decoded_text(F.col("content")))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


_MAIN = "/officeDocument"
_RELATION = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _main_part(archive: zipfile.ZipFile) -> str:
    """Name of the main document: what the relations of the package say, else the usual one."""
    if "_rels/.rels" in archive.namelist():
        for relation in ET.fromstring(archive.read("_rels/.rels")).iter(_RELATION):
            if relation.get("Type", "").endswith(_MAIN):
                return relation.get("Target", "").lstrip("/")
    return "word/document.xml"


def _runs(node: ET.Element) -> Iterator[ET.Element]:
    """Runs of a paragraph, also inside links and insertions; what stands inside a run, as a text box does, is not body text."""
    for child in node:
        if child.tag == f"{_W}r":
            yield child
        else:
            yield from _runs(child)


def _docx_text(content: bytes) -> str:
    """Body paragraphs joined by line feeds; '' for whatever is not a readable docx."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            body = ET.fromstring(archive.read(_main_part(archive))).find(f"{_W}body")
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        return "\n".join(
            "".join(
                (node.text or "") if node.tag == f"{_W}t" else marks.get(node.tag, "")
                for run in _runs(paragraph) for node in run
            )
            for paragraph in body.findall(f"{_W}p")
        )
    except Exception:  # any unreadable file counts as a file without text
        return ""


def extract_docx(df: DataFrame) -> DataFrame:
    """Text of the docx route, file by file inside Arrow batches."""
    return extract_with(df, _docx_text)


def extract_with(df: DataFrame, fn: Callable[[bytes], str]) -> DataFrame:
    """Fill ``raw_text`` from ``content`` by a Python function (for routes with a user's own extractor).

    ``content`` does not travel back from Python: only the text does. Spark limits
    Arrow batches by bytes, so large files do not pile up in a worker.
    """
    keep = [f for f in df.schema.fields if f.name not in ("content", "raw_text")]
    names = [f.name for f in keep]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["raw_text string"])

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            out["raw_text"] = [fn(bytes(c)) if c is not None else "" for c in batch["content"]]
            yield out

    return df.select(*names, "content").mapInPandas(extract, out_schema)


def read_texts(routed: DataFrame) -> DataFrame:
    """Raw text of the accepted files of the text, fall-back and docx routes.

    Every route opens its own files only: the route follows from the file name,
    so the scan of a branch skips all other files, and Python sees only docx.
    """
    kept = routed.filter(F.col("accepted"))
    plain = decode_text(kept.filter(F.col("route").isin(ROUTE_TEXT, ROUTE_FALLBACK))).drop("content")
    docx = extract_docx(kept.filter(F.col("route") == ROUTE_DOCX))
    return plain.unionByName(docx)
