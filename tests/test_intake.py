import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from talentloom.functions.text import is_uuid
from talentloom.operators import intake
from talentloom.plans import batch
from talentloom.sources import pages, records_json, uploads

AS_OF = "2024-03-01"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*paragraphs):
    body = "".join(
        "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{run}</w:t></w:r>' for run in p.split("|")) + "</w:p>" for p in paragraphs
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


FILES = {
    "good.txt": "Anna Ödman\r\nline two\rline three".encode(),
    "bad.txt": b"\xff\xfe broken",
    "blank.txt": b"  \n ",
    "page.html": b"<p>hello</p>",
    "cv.docx": docx("First para", "", "two|runs"),
    "broken.docx": b"not a zip",
    "old.doc": b"\xd0\xcf\x11\xe0 legacy",
    "scan.pdf": b"%PDF-1.4",
    "photo.PNG": b"\x89PNG",
    "sub/with blank+plus%20.txt": b"deep",
    "noext": b"plain",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("uploads")
    for name, content in FILES.items():
        target = root / name
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(content)
    return str(root)


@pytest.fixture(scope="module")
def records(spark, folder):
    rows = batch.intake_plan(uploads.scan_uploads(spark, folder), AS_OF).collect()
    return {r.file_name: r for r in rows}


def test_scan_names_and_sizes(spark, folder):
    rows = uploads.scan_uploads(spark, folder).select("file_name", "file_size").collect()
    assert {r.file_name: r.file_size for r in rows} == {os.path.basename(n): len(c) for n, c in FILES.items()}


def test_texts(records):
    assert records["good.txt"].raw_text == "Anna Ödman\nline two\nline three"
    assert records["bad.txt"].raw_text == ""
    assert records["page.html"].raw_text == "<p>hello</p>"
    assert records["cv.docx"].raw_text == "First para\n\ntworuns"
    assert records["broken.docx"].raw_text == "" and records["old.doc"].raw_text == ""
    assert records["with blank+plus%20.txt"].raw_text == "deep"


def test_statuses(records):
    status = {n: r.processing_status for n, r in records.items()}
    assert status["good.txt"] == status["blank.txt"] == status["cv.docx"] == status["noext"] == "ai_processing"
    assert status["bad.txt"] == status["broken.docx"] == status["old.doc"] == "parse_failed"
    assert status["scan.pdf"] == status["photo.PNG"] == "processing"
    assert records["scan.pdf"].raw_text is None and records["scan.pdf"].processed_at is None
    assert len(records) == len(FILES)


def test_empty_and_lost_uploads_come_from_the_log(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"text")
    (tmp_path / "empty.txt").write_bytes(b"")
    found = batch.intake_plan(uploads.scan_uploads(spark, str(tmp_path)), AS_OF)
    log = [(f"file:{tmp_path}/{n}", n, s, "text/plain") for n, s in (("a.txt", 4), ("empty.txt", 0), ("lost.txt", 9))]
    log = spark.createDataFrame(log, "path string, file_name string, file_size long, file_type string")
    rows = batch.complete_from_log(found, log, AS_OF).collect()
    assert {r.file_name: r.processing_status for r in rows} == {
        "a.txt": "ai_processing", "empty.txt": "parse_failed", "lost.txt": "save_failed"}


def test_ids_are_stable_uuids(spark, folder, records):
    again = {r.file_name: r.id for r in batch.intake_plan(uploads.scan_uploads(spark, folder), AS_OF).collect()}
    assert again == {n: r.id for n, r in records.items()}
    df = spark.createDataFrame([(r.id, r.stored_name) for r in records.values()], "id string, stored string")
    assert df.filter(~is_uuid(F.col("id"))).count() == 0
    assert records["good.txt"].stored_name == records["good.txt"].id + ".txt" and records["noext"].stored_name == records["noext"].id


def _files_read(df):
    df.collect()
    total = []

    def walk(node):
        if "AdaptiveSparkPlan" in node.nodeName():
            return walk(node.executedPlan())
        if "Scan" in node.nodeName():
            total.append(node.metrics().apply("numFiles").value())
        it = node.children().iterator()
        while it.hasNext():
            walk(it.next())

    walk(df._jdf.queryExecution().executedPlan())
    return sorted(total)


def test_a_route_opens_only_its_own_files(spark, folder):
    admitted = batch.admit(uploads.scan_uploads(spark, folder), AS_OF)
    docx_only = admitted.filter(F.col("accepted") & (F.col("route") == uploads.ROUTE_DOCX))
    assert _files_read(uploads.extract_docx(docx_only)) == [3]


def test_size_gate_bounds(spark):
    limit = 10 * 1024 * 1024
    df = spark.createDataFrame([(limit,), (limit + 1,), (15 * 1024 * 1024,)], "file_size long")
    rows = uploads.size_gate(df).collect()
    assert [r.accepted for r in rows] == [True, False, False]
    assert rows[2].reject_reason == "File size exceeds the 10MB limit. File size: 15.00 MB"


def test_size_gate_is_pushed_to_the_listing(spark, folder, capsys):
    uploads.size_gate(uploads.scan_uploads(spark, folder)).filter("accepted").select("file_name").explain()
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(length,10485760)" in plan and "content" not in plan.split("ReadSchema")[1]


def test_strict_routes(spark):
    df = spark.createDataFrame([("a.pdf", "application/pdf"), ("a.xyz", "text/plain"), ("a", "text/plain"), ("A.JPG", "image/jpeg")],
                               "file_name string, file_type string")
    assert [r.route for r in uploads.route_media(df, strict=True).collect()] == ["external_text", "unsupported", "unsupported", "external_text"]
    assert [r.route for r in uploads.route_media(df).collect()] == ["external_text", "text", "text", "external_text"]


def test_user_extractor(spark):
    df = spark.createDataFrame([("1", bytearray(b"abc"))], "id string, content binary")
    assert uploads.extract_with(df, lambda b: b.decode().upper()).first().raw_text == "ABC"


def test_pages(spark):
    rows = [(1, 2, "b"), (1, 0, "a"), (1, 1, ""), (1, 3, " "), (2, 0, ""), (3, 7, "x"), (3, 2, "w")]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, page_text string")
    got = {r.doc_id: r.raw_text for r in pages.assemble_pages(df).collect()}
    assert got == {1: "a\nb\n \n", 3: "w\nx\n"}
    kept = {r.doc_id: r.raw_text for r in pages.assemble_pages(df, keep_empty=True).collect()}
    assert kept[1] == "a\n\nb\n \n" and kept[2] == "\n"


def test_a_long_document_stays_one_row(spark):
    df = spark.range(501).select(F.lit(1).alias("doc_id"), F.col("id").alias("page_no"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("page_text"))
    (row,) = pages.assemble_pages(df).collect()
    assert row.n_pages == 501 and row.raw_text == "".join(f"p{k}\n" for k in range(501))
    assert not intake.needs_ocr(pages.assemble_pages(df)).first().needs_ocr


def test_ocr_threshold(spark):
    df = spark.createDataFrame([("x" * 100,), ("x" * 99 + "\n\t ",), (None,)], "raw_text string")
    assert [r.needs_ocr for r in intake.needs_ocr(df).collect()] == [False, True, True]


def test_intake_books(spark):
    def ids(*xs):
        return spark.createDataFrame([(x,) for x in xs], "f int")

    out = intake.check_intake(ids(1, 2, 3, 4), ids(1, 2, 5), ids(2), "f").collect()
    assert {(r.problem, r.n) for r in out} == {("lost", 2), ("both", 1), ("unknown", 1)}
    assert intake.check_intake(ids(1, 2), ids(1), ids(2), "f").count() == 0


def test_prompts_hold_the_whole_payload(spark):
    text = "line\n" * 5000
    df = spark.createDataFrame([("1", text)], "id string, t string")
    for kind in records_json.INSTRUCTIONS:
        p = records_json.build_prompts(df, kind, F.col("t")).first().prompt
        assert p.endswith(text) and p.startswith(records_json.INSTRUCTIONS[kind])
    with pytest.raises(ValueError):
        records_json.build_prompts(df, "poem", F.col("t"))


def test_main_part_by_relations_and_no_text_boxes():
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    box = "<w:r><w:pict><w:txbxContent><w:p><w:r><w:t>in a box</w:t></w:r></w:p></w:txbxContent></w:pict><w:t>beside it</w:t></w:r>"
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r><w:hyperlink><w:r><w:t> link</w:t></w:r></w:hyperlink><w:ins><w:r><w:tab/><w:t>two</w:t></w:r></w:ins></w:p><w:p>{box}</w:p></w:body></w:document>"
    rels = ('<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="r0" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/>'
            '<Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="/word/document2.xml"/></Relationships>')

    def made(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as archive:
            for name, text in parts.items():
                archive.writestr(name.replace("__", "/").replace("DOT", "."), text)
        return out.getvalue()

    want = "One link\ttwo\nbeside it"
    assert uploads._docx_text(made(_relsDOTrels="x", word__documentDOTxml=body)) == want
    assert uploads._docx_text(made(**{"_rels/.rels": rels, "word/document2.xml": body, "word/document.xml": body.replace("One", "Old")})) == want
    assert uploads._docx_text(made(**{"_rels/.rels": rels, "word/document.xml": body})) == ""
