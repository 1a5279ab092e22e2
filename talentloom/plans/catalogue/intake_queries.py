"""Sources, gates, routes, bulk intake."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from talentloom import rules
from talentloom.operators import intake, match, records
from talentloom.plans import batch
from talentloom.plans.catalogue.registry import query, quoted, uuid_sql
from talentloom.sources import pages, records_json, uploads

AS_OF = "2024-02-01"
SMALL_LIMIT = 5000


@query("io02_size_gate", f"""
    select doc_id, n_chars <= {SMALL_LIMIT} as accepted,
           case when n_chars > {SMALL_LIMIT} then 'File size exceeds the {SMALL_LIMIT / (1024 * 1024):g}MB limit. File size: '
                || printf('%.2f', n_chars / (1024 * 1024.0)) || ' MB' end as reject_reason
    from documents""")
def _(t):
    return uploads.size_gate(t.documents, "n_chars", SMALL_LIMIT).select("doc_id", "accepted", "reject_reason")


_TYPES = (rules.MEDIA_PDF, rules.MEDIA_DOCX, "image/png", rules.MEDIA_TEXT, "text/html")
_SUFFIXES = (".pdf", ".docx", ".doc", ".txt", ".JPG", ".xyz", "")


def _pick(values, key):
    """One of the values by the remainder of a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _typed(t):
    return t.documents.select(
        "doc_id", _pick(_TYPES, F.col("doc_id")).alias("file_type"),
        F.concat(F.lit("cv"), F.col("doc_id").cast("string"), _pick(_SUFFIXES, F.col("doc_id"))).alias("file_name"),
        (F.col("n_chars") <= SMALL_LIMIT).alias("accepted"),
    )


_ROUTE_SQL = "case doc_id % 5 when 0 then 'external_text' when 1 then 'docx' when 2 then 'external_text' when 3 then 'text' else 'text_fallback' end"


@query("io03_route_media", f"select doc_id, {_ROUTE_SQL} as route from documents")
def _(t):
    return uploads.route_media(_typed(t)).select("doc_id", "route")


@query("io04_route_strict", f"""
    select doc_id, case when doc_id % 7 >= 5 then 'unsupported' else {_ROUTE_SQL} end as route from documents""")
def _(t):
    return uploads.route_media(_typed(t), strict=True).select("doc_id", "route")


@query("io05_decode_text", """
    select page_id, md5(case when page_id % 2 = 1 then '' else replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)) end) as digest
    from pages""")
def _(t):
    content = F.col("html").cast("binary")
    spoiled = F.when(F.col("page_id") % 2 == 1, F.concat(content, F.unhex(F.lit("FFFE")))).otherwise(content)
    return uploads.decode_text(t.pages.select("page_id", spoiled.alias("content"))).select(
        "page_id", F.md5("raw_text").alias("digest")
    )


_CONTROL = r"[\x00-\x09\x0b-\x1f]"


def _write_docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    head = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    for batch in batches:
        files = []
        for text in batch["text"]:
            body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("word/document.xml", head + body + "</w:body></w:document>")
            files.append(buffer.getvalue())
        yield pd.DataFrame({"doc_id": batch["doc_id"], "content": files})


@query("io06_extract_docx", rf"""
    select doc_id, md5(regexp_replace(text, '{_CONTROL}', '', 'g')) as digest from documents""")
def _(t):
    plain = t.texts().select("doc_id", F.regexp_replace("text", _CONTROL, "").alias("text"))
    files = plain.mapInPandas(_write_docx, "doc_id bigint, content binary")
    return uploads.extract_docx(files).select("doc_id", F.md5("raw_text").alias("digest"))


@query("io07_assemble_pages", """
    select doc_id, count(*) as n_pages, string_agg(page_text || chr(10), '' order by page_no) as raw_text
    from doc_pages_v where page_text <> '' group by 1""")
def _(t):
    return pages.assemble_pages(t.doc_pages_v())


_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


@query("io08_needs_ocr", f"select doc_id, length(trim(text, {_WS})) < 100 as needs_ocr from documents")
def _(t):
    return intake.needs_ocr(t.documents, "text").select("doc_id", "needs_ocr")


@query("io09_text_gate", f"""
    select doc_id, case when regexp_extract(text, '{rules.EMAIL_PATTERN}') = '' then 'parse_failed' else 'ai_processing' end as processing_status
    from documents""")
def _(t):
    found = t.documents.select("doc_id", F.regexp_extract("text", rules.EMAIL_PATTERN, 0).alias("raw_text"))
    return intake.text_gate(found).select("doc_id", "processing_status")


def _files(t):
    return t.documents.select(
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.col("n_chars").alias("file_size"), F.lit(rules.MEDIA_TEXT).alias("file_type"),
    )


_FILE_ID = uuid_sql("source || '/' || doc_id || '.txt|' || n_chars")


@query("io10_create_records", f"""
    select {_FILE_ID} as id, doc_id || '.txt' as file_name, n_chars as file_size, 'text/plain' as file_type,
           'processing' as processing_status from documents""")
def _(t):
    return intake.create_records(_files(t), AS_OF).select("id", "file_name", "file_size", "file_type", "processing_status")


_NAMES = (".profile", "a.tar.gz", "a", ".a.b", "x.")


@query("io11_stored_name", """
    select doc_id, doc_id || case doc_id % 5 when 1 then '.gz' when 3 then '.b' else '' end as stored_name from documents""")
def _(t):
    name = _pick(_NAMES, F.col("doc_id"))
    return t.documents.select("doc_id", intake.stored_name(F.col("doc_id").cast("string"), name).alias("stored_name"))


@query("io12_create_matches", f"""
    select {uuid_sql("a.resume_id || '|' || job_id")} as id, a.resume_id, job_id, 'pending' as status
    from applications_v a join stored_resumes_v r on r.id = a.resume_id where processing_status = 'completed'""")
def _(t):
    ready = records.ready_for_match(t.stored_resumes_v())
    return match.create_matches(ready, t.applications_v(), AS_OF).select("id", "resume_id", "job_id", "status")


@query("io13_record_json", """
    select id, case when processing_status = 'completed' then full_name end as full_name,
           case when processing_status = 'completed' then 'null' end as certifications, true as same
    from stored_resumes_v""")
def _(t):
    stored = t.stored_resumes_v().select("id", "structured_data", F.col("structured_data").alias("before"))
    text = records_json.to_record_json(stored).withColumn("json", F.col("structured_data"))
    back = records_json.from_record_json(text)
    listed = F.regexp_extract("json", r'"certifications":(null|\[)', 1)
    return back.select(
        "id", F.col("structured_data.personalInfo.name.full").alias("full_name"),
        F.when(F.col("json").isNotNull(), listed).alias("certifications"),
        F.col("structured_data").eqNullSafe(F.col("before")).alias("same"),
    )


@query("io14_build_prompts", f"""
    select doc_id as id, 'parse' as kind, md5({quoted(records_json.prompt_head('parse'))} || text) as digest from documents""")
def _(t):
    prompts = records_json.build_prompts(t.documents, "parse", F.col("text"), "doc_id")
    return prompts.select("id", "kind", F.md5("prompt").alias("digest"))


_KINDS = ("bias", "anonymize", "salary", "career", "match")


@query("io14_prompts_of_all_kinds", " union all ".join(
    f"select doc_id as id, '{k}' as kind, md5({quoted(records_json.prompt_head(k))} || text) as digest from documents" for k in _KINDS))
def _(t):
    out = None
    for kind in _KINDS:
        prompts = records_json.build_prompts(t.documents, kind, F.col("text"), "doc_id").select("id", "kind", F.md5("prompt").alias("digest"))
        out = prompts if out is None else out.unionByName(prompts)
    return out


_BULK_SQL = f"""
    select lang, doc_id, rn <= {rules.BULK_LIMIT} as accepted,
           case when rn > {rules.BULK_LIMIT} then 'Batch exceeds the limit of {rules.BULK_LIMIT} files' end as reason
    from (select *, row_number() over (partition by lang order by doc_id) as rn from documents)"""


def _judged(t):
    return intake.bulk_accept(t.documents.select("lang", "doc_id"), "lang", "doc_id")


@query("io16_bulk_accept", _BULK_SQL)
def _(t):
    return _judged(t).select("lang", "doc_id", "accepted", "reason")


@query("io16_bulk_report", f"""
    select lang, count(*) as total_files, count(*) filter (where accepted) as accepted_files, count(*) filter (where not accepted) as rejected_files
    from ({_BULK_SQL}) group by lang""")
def _(t):
    return intake.bulk_report(_judged(t), "lang")


@query("io16_bulk_rejections", f"select lang, doc_id as file, reason from ({_BULK_SQL}) where not accepted")
def _(t):
    return intake.bulk_rejections(_judged(t), "lang", "doc_id")


@query("io17_external_hand_off", f"""
    select 'cv' || doc_id || case doc_id % 7 when 0 then '.pdf' when 1 then '.docx' when 2 then '.doc' when 3 then '.txt'
           when 4 then '.JPG' when 5 then '.xyz' else '' end as file_name,
           case doc_id % 5 when 0 then 'application/pdf' else 'image/png' end as file_type
    from documents where n_chars <= {SMALL_LIMIT} and doc_id % 5 in (0, 2)""")
def _(t):
    return uploads.external_hand_off(uploads.route_media(_typed(t)))


_RETURNED = f"""select c.doc_id, length(trim(coalesce(raw_text, ''), {_WS})) < 100 as again, raw_text from (select distinct conv_id as doc_id from conversations) c
    left join (select doc_id, string_agg(page_text || chr(10), '' order by page_no) as raw_text from doc_pages_v where page_text <> '' group by 1) p
    on p.doc_id = c.doc_id"""


def _handed_off(t):
    """Scans handed off, one per conversation."""
    name = F.concat(F.col("conv_id").cast("string"), F.lit(".pdf"))
    return t.conversations.select("conv_id").distinct().select(
        F.col("conv_id").alias("id"), F.concat(F.lit("/up/"), name).alias("path"), name.alias("file_name"), F.lit(rules.MEDIA_PDF).alias("file_type"),
        F.lit(uploads.ROUTE_EXTERNAL).alias("route"), F.lit(rules.PROCESSING).alias("processing_status"),
        F.lit(None).cast("timestamp").alias("processed_at"), F.lit(None).cast("string").alias("raw_text"))


def _returned(t):
    """The scans with the turns of their conversation as pages."""
    return batch.return_plan(_handed_off(t), t.doc_pages_v(), AS_OF)


@query("io17_returned_pages", f"""
    select doc_id as id, case when again then 'processing' else 'ai_processing' end as status, case when not again then md5(raw_text) end as digest
    from ({_RETURNED})""")
def _(t):
    return _returned(t).records.select("id", F.col("processing_status").alias("status"), F.md5("raw_text").alias("digest"))


@query("io17_second_hand_off", f"select doc_id as id, doc_id || '.pdf' as file_name from ({_RETURNED}) where again and raw_text is not null")
def _(t):
    return _returned(t).ocr.select("id", "file_name")


# Every third scan comes back with the first letters of its pages only, so it is handed off again.
_SHORT = f"""select c.doc_id, length(trim(coalesce(raw_text, ''), {_WS})) < 100 as again, raw_text from (select distinct conv_id as doc_id from conversations) c
    left join (select doc_id, string_agg(page_text || chr(10), '' order by page_no) as raw_text from (
        select doc_id, page_no, case when doc_id % 3 = 0 then substr(page_text, 1, 4) else page_text end as page_text from doc_pages_v) where page_text <> '' group by 1) p
    on p.doc_id = c.doc_id"""


def _shortened(t):
    shown = F.when(F.col("doc_id") % 3 == 0, F.substring("page_text", 1, 4)).otherwise(F.col("page_text"))
    return batch.return_plan(_handed_off(t), t.doc_pages_v().withColumn("page_text", shown), AS_OF)


@query("io17_short_scans", f"select doc_id as id, doc_id || '.pdf' as file_name from ({_SHORT}) where again and raw_text is not null")
def _(t):
    return _shortened(t).ocr.select("id", "file_name")


@query("io17_second_return", f"""
    select s.doc_id as id, case when not s.again then 'ai_processing' when s.doc_id % 2 = 1 then 'processing' when length(trim(coalesce(w.raw_text, ''), {_WS})) < 100 then 'parse_failed'
           else 'ai_processing' end as status,
           case when not s.again then md5(s.raw_text) when s.doc_id % 2 = 0 then md5(w.raw_text) end as digest
    from ({_SHORT}) s join (select doc_id, string_agg(page_text || chr(10), '' order by page_no) as raw_text from doc_pages_v group by 1) w on w.doc_id = s.doc_id""")
def _(t):
    """Scans of even number come back from the second extractor with their whole pages, taken as they are; the others are still out."""
    first = _shortened(t)
    pages = t.doc_pages_v().join(first.ocr.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").where("doc_id % 2 = 0")
    return batch.return_plan(first.records, pages, AS_OF, seen=True).records.select("id", F.col("processing_status").alias("status"), F.md5("raw_text").alias("digest"))


@query("u5_check_intake", f"""
    with judged as ({_BULK_SQL})
    select case when j.doc_id is null then 'unknown' else 'lost' end as problem, count(*) as n
    from judged j full join labels l on l.doc_id = j.doc_id
    where j.doc_id is null or (not accepted and l.doc_id is null) group by 1""")
def _(t):
    judged = _judged(t)
    accepted = judged.filter("accepted")
    noted = t.labels.select("doc_id").join(accepted.select("doc_id"), "doc_id", "left_anti")
    return intake.check_intake(judged, accepted, noted, "doc_id")
