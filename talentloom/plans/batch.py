"""Batch plans: files → records → enriched records → tables for the relational operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from talentloom import rules, schemas
from talentloom.functions.dates import parse_loose_date
from talentloom.functions.text import norm_skill
from talentloom.operators import enrich
from talentloom.operators.extraction import structure_resumes
from talentloom.operators.intake import create_records, needs_ocr, text_gate
from talentloom.operators.records import merge_block
from talentloom.operators.text_analysis import bias_report, detect_language
from talentloom.sources.pages import assemble_pages
from talentloom.sources.uploads import ROUTE_EXTERNAL, media_type_of, read_texts, route_media, size_gate

RECORD_COLUMNS = ["id", "path", "file_name", "file_size", "file_type", "stored_name", "route", "processing_status",
                  "uploaded_at", "processed_at", "raw_text"]


def admit(files: DataFrame, as_of: str | None) -> DataFrame:
    """Size gate, media type, route and record row for every file; no file content is read for this."""
    typed = files.withColumn("file_type", media_type_of(F.col("file_name")))
    return create_records(route_media(size_gate(typed)), as_of)


def intake_plan(files: DataFrame, as_of: str | None) -> DataFrame:
    """Record rows of the accepted files, of a table or a stream of files.

    Text of the text and docx routes is read at once. PDF and image files are not
    opened: they stay in ``processing`` until their pages come back from the
    outside extractor.
    """
    admitted = admit(files, as_of)
    read = text_gate(read_texts(admitted)).withColumn("processed_at", F.col("uploaded_at"))
    waiting = (
        admitted.filter(F.col("accepted") & (F.col("route") == ROUTE_EXTERNAL)).drop("content")
        .withColumn("raw_text", F.lit(None).cast("string")).withColumn("processed_at", F.lit(None).cast("timestamp"))
    )
    return read.select(*RECORD_COLUMNS).unionByName(waiting.select(*RECORD_COLUMNS))


class Returned(NamedTuple):
    records: DataFrame
    ocr: DataFrame


def return_plan(records: DataFrame, pages: DataFrame, as_of: str, seen: bool = False) -> Returned:
    """Bring the pages (doc_id, page_no, page_text) of handed-off files back into their records.

    A text that is too short goes to the outside reader of images once more (``ocr``: the list to hand off) and its record waits on; with
    ``seen`` the pages come from there and are taken as they are. Other records pass unchanged. ``enrich_plan`` takes on from here.
    """
    texts = needs_ocr(assemble_pages(pages, keep_empty=seen)).select(
        F.col("doc_id").alias("id"), F.col("raw_text").alias("_text"), (F.col("needs_ocr") & F.lit(not seen)).alias("_again"))
    waiting = (F.col("route") == ROUTE_EXTERNAL) & (F.col("processing_status") == rules.PROCESSING)
    joined = records.join(texts, "id", "left").withColumn("_back", waiting & F.col("_text").isNotNull() & ~F.col("_again"))
    judged = text_gate(joined.withColumnRenamed("processing_status", "_status"), "_text")
    out = judged.select(*[
        F.when(F.col("_back"), F.col("processing_status")).otherwise(F.col("_status")).alias(c) if c == "processing_status"
        else F.when(F.col("_back"), F.col("_text")).otherwise(F.col("raw_text")).alias(c) if c == "raw_text"
        else F.when(F.col("_back"), F.lit(as_of).cast("timestamp")).otherwise(F.col("processed_at")).alias(c) if c == "processed_at"
        else F.col(c) for c in records.columns
    ])
    ocr = joined.filter(waiting & F.col("_again")).select("id", "path", "file_name", "file_type")
    return Returned(out, ocr)


def complete_from_log(records: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """Add the uploads of a log (path, file_name, file_size, file_type) that the scan did not deliver.

    Spark's file sources pass over files without content: such uploads are
    ``parse_failed``. Others in the log without a file are ``save_failed``.
    """
    missing = create_records(route_media(log), as_of).join(records.select("id"), "id", "left_anti")
    status = F.when(F.col("file_size") == 0, rules.PARSE_FAILED).otherwise(rules.SAVE_FAILED)
    added = (
        missing.withColumn("processing_status", status).withColumn("processed_at", F.lit(as_of).cast("timestamp"))
        .withColumn("raw_text", F.lit(None).cast("string"))
    )
    return records.unionByName(added.select(*RECORD_COLUMNS))


def enrich_plan(records: DataFrame, as_of: str) -> DataFrame:
    """Structured data and in-row enhancements of the records which have text; the others pass unchanged in status.

    One projection without a shuffle. Salary and career blocks need comparisons
    with other records; ``merge_block`` adds them.
    """
    kept = [c for c in records.columns if c not in ("processing_status", "processed_at")]
    has_text = F.col("processing_status") == rules.AI_PROCESSING
    out = structure_resumes(records, as_of)
    out = detect_language(out, "raw_text", words=F.col("words"))
    out = bias_report(out, as_of, education=F.col("structured_data.education"), language=F.col("language"), words=F.col("words"))
    out = enrich.anonymize(enrich.quality_scores(out))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in schemas.ENHANCEMENTS.fields}
    empty |= {"qualityScore": F.col("qualityScore"), "completenessScore": F.col("completenessScore"),
              "suggestions": F.col("suggestions"), "industryFit": F.col("industry_fit"),
              "biasReport": F.col("biasReport"), "anonymizedData": F.col("anonymizedData")}
    blocks = F.struct(*[value.alias(name) for name, value in empty.items()])
    return out.select(
        *kept,
        F.when(has_text, rules.COMPLETED).otherwise(F.col("processing_status")).alias("processing_status"),
        F.when(has_text, F.lit(as_of).cast("timestamp")).otherwise(F.col("processed_at")).alias("processed_at"),
        F.when(has_text, F.col("structured_data")).alias("structured_data"),
        F.when(has_text, blocks).alias("ai_enhancements"),
    )


def experience_rows(resumes: DataFrame, as_of: str) -> DataFrame:
    """(resume_id, exp_id, title, start_date, end_date, is_current) from the nested records."""
    rows = resumes.select(F.col("id").alias("resume_id"), F.posexplode("structured_data.experience").alias("pos", "e"))
    return rows.select(
        "resume_id", F.concat_ws("#", "resume_id", "pos").alias("exp_id"), "e.title",
        parse_loose_date(F.col("e.start_date"), as_of).alias("start_date"),
        parse_loose_date(F.col("e.end_date"), as_of).alias("end_date"), F.col("e.current").alias("is_current"),
    )


def skill_rows(resumes: DataFrame) -> DataFrame:
    """(resume_id, category, skill) with normalised distinct skills."""
    groups = resumes.select(F.col("id").alias("resume_id"), F.explode("structured_data.skills.technical").alias("t"))
    items = groups.select("resume_id", F.col("t.category").alias("category"), F.explode("t.items").alias("item"))
    return items.select("resume_id", "category", norm_skill(F.col("item")).alias("skill")).filter("skill <> ''").distinct()


def compare_plan(resumes: DataFrame, market: DataFrame, as_of: str) -> DataFrame:
    """Fill the two blocks that need other records: salaryEstimate from the market, careerProgression from all careers.

    ``market`` is (level, industry, country, salary). A record without
    comparables or dated roles keeps a null block.
    """
    doc = F.col("structured_data")
    done = resumes.filter(F.col("processing_status") == rules.COMPLETED)
    people = done.select(
        F.col("id").alias("resume_id"), doc["summary"]["careerLevel"].alias("level"),
        doc["summary"]["industryFocus"].alias("industry"), doc["personalInfo"]["contact"]["address"]["country"].alias("country"),
    )
    salary = enrich.estimate_salary(people, market).filter(F.col("comparables") > 0).select(
        F.col("resume_id").alias("id"), F.struct("min", "max", "currency", "comments").alias("block")
    )
    roles = experience_rows(done, as_of).filter(F.col("start_date").isNotNull())
    path = enrich.suggest_career(roles, skill_rows(done))
    career = path.select(
        F.col("resume_id").alias("id"),
        F.struct(
            F.col("next_roles").alias("suggestedNextRoles"), F.col("improvement_areas").alias("improvementAreas"),
            F.concat(F.lit("From careers which went on from "), "title").alias("comments"),
        ).alias("block"),
    )
    return merge_block(merge_block(resumes, "salaryEstimate", salary), "careerProgression", career)
