"""Text which comes back page by page from an outside extractor."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def assemble_pages(pages: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(doc_id, page_no, page_text) → (doc_id, n_pages, raw_text), one row per document, pages in order, each ended by a line feed.

    Empty pages are left out, unless ``keep_empty`` (the OCR rule). The pages of a
    document meet in one task: the size gate bounds a file, and so its text.
    """
    text = F.coalesce(F.col("page_text"), F.lit(""))
    kept = pages if keep_empty else pages.filter(text != "")
    grouped = kept.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"),
        F.array_sort(F.collect_list(F.struct("page_no", text.alias("page_text")))).alias("_pages"),
    )
    joined = F.array_join(F.transform("_pages", lambda p: F.concat(p.page_text, F.lit("\n"))), "")
    return grouped.select("doc_id", "n_pages", joined.alias("raw_text"))
