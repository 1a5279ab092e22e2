"""Page text, benchmark hits and the pipeline."""

import pytest
from pyspark.sql import functions as F

import oracle
from corpus import documents, frame, near_groups, prose, repeats
from talentloom.llm import decontaminate, html_extract, queries

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_hits_equal_sql(spark):
    con = oracle.duck(FOLDER)
    assert oracle.compare(spark, con, FOLDER, queries.QUERIES["op1_benchmark_decontamination"], queries.ORACLES["op1_benchmark_decontamination"]) is None


def hits(rows, items, size=10):
    """Plain version: per row the words, the words hit, and the items."""
    out = []
    for i, text in rows:
        words = decontaminate.words_of(text)
        marked, found = set(), set()
        for item, t in items:
            for w in decontaminate.windows_of(decontaminate.words_of(t), size) if item is not None else ():
                for k in range(len(words) - len(w) + 1):
                    if tuple(words[k : k + len(w)]) == w:
                        marked |= set(range(k, k + len(w)))
                        found.add(str(item))
        out.append((i, len(words), len(marked), tuple(sorted(found))))
    return out


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_hits_of_awkward_rows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 3000)
    passage = prose(3, 60)
    items = [(1, passage[:200]), (2, "short words"), (2, "short words"), (3, None), (4, ""), (5, "!!!"), (None, "x"), (10, prose(2, 120)), (11, "a b c"), (12, "日本")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [r for r in documents() if r[0] != 5]
    got = decontaminate.contamination(frame(spark, rows), benchmark).collect()
    plain = [(x["id"], x["n_words"], sum(s["high"] - s["low"] for s in x["spans"]), tuple(x["items"])) for x in got]
    key = lambda x: (x[0] or -1, *x[1:])
    if block > 40:
        assert sorted(plain, key=key) == sorted(hits([r[:2] for r in rows], items), key=key)
    digest = decontaminate.hit_digest(decontaminate.contamination(frame(spark, rows), benchmark)).collect()
    assert sorted((x["doc_id"] or -1, x["n_words"], x["n_hit"], x["n_items"]) for x in digest) == sorted(
        (i or -1, n, m, len(f)) for i, n, m, f in hits([r[:2] for r in rows], items))
    left = decontaminate.without_hits(frame(spark, rows), benchmark)
    clean = sorted(i or -1 for i, _, m, _ in hits([r[:2] for r in rows], items) if not m)
    assert sorted(x["doc_id"] or -1 for x in left.collect()) == clean and left.columns == frame(spark).columns


@pytest.mark.parametrize("kind", ["long", "int", "string", "decimal(12,0)", "smallint"])
def test_files_of_equal_content_are_hit_alike(spark, tmp_path, kind):
    items = [(1, prose(3, 60)), (2, prose(8, 12))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, prose(20 + k, 8) + " " + (prose(3, 60) if k % 3 else prose(8, 12)) + " " + prose(50 + k, 4000 if k == 5 else 9)) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).coalesce(1)
    docs.write.parquet(str(tmp_path / "docs"))
    once = spark.read.parquet(str(tmp_path / "docs"))
    want = sorted((int(i), n, m) for i, n, m, _ in hits(rows, items))
    got = decontaminate.hit_digest(decontaminate.contamination(once.union(once).union(once), benchmark)).collect()
    assert sorted((int(x["doc_id"]), x["n_words"], x["n_hit"]) for x in got) == sorted(want * 3) and all(x["contaminated"] for x in got)
    assert decontaminate.without_hits(once.union(once), benchmark).count() == 0


def test_hits_without_rows(spark):
    benchmark = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontaminate.contamination(frame(spark, []), benchmark).count() == 0
    none = decontaminate.contamination(frame(spark), benchmark.where("false")).collect()
    assert len(none) == len(documents()) and all(not x["spans"] for x in none)


def test_proximity_is_any_order_within_reach(spark):
    benchmark = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "blue x green y red"), (2, "red " + "z " * 9 + "green blue"), (3, "red green blue"), (4, "red green")], "doc_id long, text string")
    got = {x["id"]: (x["items"], x["near_items"]) for x in decontaminate.contamination(docs, benchmark, near=4).collect()}
    assert got == {1: ([], ["1"]), 2: ([], []), 3: (["1"], ["1"]), 4: ([], [])}


PAGES = [
    ("<body><header>Top</header><nav><ul><li>Menu</li></ul></nav><article class=post><h1>A &amp; B</h1><p>one<br>two<p>three <i>x</i>y</p>"
     "<div class='ad box'>buy</div><section id=comments><p>me too</p></section><script>if(a<b)'</p>'</script></article><footer>end</footer>",
     "A & B\none two\nthree xy"),
    ("<main><p>kept</p><aside>no</aside><form><p>no</p></form><ul><li>1<li>2</ul></main><p>outside</p>", "kept\n1\n2"),
    ("<div class='with-sidebar'><article><p>in</p></article></div>", "in"),
    ("plain <b>text</b> &lt;x&gt; &eacute;&#33; <!-- <p>no</p> -->\n  end <!-- open", "plain text <x> é! end"),
    ("<p>a</p><p hidden>b</p><p>c</p><noscript><p>d</p></noscript><title>t</title>", "a\nc"),
    ("<p title='a>b'>x</p><p class=\"cookie-notice\">y</p><table><tr><td>1<td>2<tr><td>3</table>", "x\n1\n2\n3"),
    ("<p>a<p", "a<p"), ("", ""), (None, ""), ("<article></article>", ""), ("<b>" * 3000 + "deep", "deep"),
]


def test_text_of_pages(spark):
    rows = [(k, f"https://h{k}.example/x", page, 1, "c") for k, (page, _) in enumerate(PAGES)] + [(None, None, "<p>z", 1, "c")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row long, host string")
    got = {x["page_id"]: (x["text"], x["n_chars"]) for x in html_extract.main_text(df).collect()}
    assert got == {k: (text, len(text)) for k, (_, text) in enumerate(PAGES)} | {None: ("z", 1)}
    assert html_extract.main_text(df).count() == len(rows)
    assert html_extract.main_text(df.where("false")).count() == 0


def test_templates_of_a_site_go(spark):
    pages = [(k, f"http://Site.example:80/{k}", f"<div><div>Welcome to the site</div><div><p>{prose(k, 12)}</p><p>Shared line</p></div><p>All rights</p></div>") for k in range(12)]
    pages += [(100 + k, "http://other.example/", "<div><div>Welcome to the site</div><p>same</p></div>") for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html_extract.main_text(df).collect()}
    assert all(got[k] == prose(k, 12) for k in range(12))
    assert all(got[100 + k] == "Welcome to the site\nsame" for k in range(12))  # copies of one page are no template


def test_articles_keep_what_they_share(spark):
    pages = [(k, "http://a.example/", f"<article><h1>T</h1><p>Shared passage</p><p>{prose(k, 9)}</p><div><p>Read our letter</p></div></article>") for k in range(12)]
    got = {x["page_id"]: x["text"] for x in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"T\nShared passage\n{prose(k, 9)}" for k in range(12))


def test_near_copies_keep_a_wrapped_body(spark):
    body = f"<div class=body><p>{prose(1, 80)}</p><ul><li>{prose(2, 9)}</li></ul></div>"
    pages = [(k, "http://a.example/", f"<article><h1>Title {k}</h1>{body}</article>") for k in range(40)]
    pages += [(100 + k, "http://b.example/", f"<h1>Title {k}</h1>{body}") for k in range(40)]  # no article
    pages += [(200 + k, "http://c.example/", f"<article><p>{prose(20 + k, 40)}</p>{'<ul><li>One list</li></ul>' if k < 9 else ''}</article>") for k in range(40)]
    pages += [(300 + k, "http://d.example/", f"<div>Buy our things</div><div><p>{prose(20 + k, 40)}</p></div>") for k in range(4)]  # a small host
    got = {x["page_id"]: x["text"] for x in html_extract.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[h + k] == f"Title {k}\n{prose(1, 80)}\n{prose(2, 9)}" for h in (0, 100) for k in range(40))
    assert all(got[200 + k] == prose(20 + k, 40) + ("\nOne list" if k < 9 else "") for k in range(40))
    assert all(got[300 + k] == prose(20 + k, 40) for k in range(4))


def test_pipeline_stages_equal_plain_versions(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None]
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    folder = tmp_path / "sf"
    docs.write.parquet(str(folder / "documents.parquet"))
    items = [(1, prose(7, 30))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["identify_language", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece_round_trip"]
    now = spark.read.parquet(str(folder / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(x) for x in now.collect()]
        out = stage(spark, now, str(folder))
        after = [tuple(x) for x in out.collect()]
        if name != "sentencepiece_round_trip":
            assert out.dtypes == docs.dtypes
        if name == "identify_language":
            assert sorted(before) == sorted(r for r in [*after, *[b for b in before if b[0] in (1, 2, 3, 14)]]) if None not in {b[1] for b in before} else len(after) == len(before) - 4
        if name == "minhash_near_dedup":
            _, root = near_groups([(b[0], b[1]) for b in before], 5)
            least = {}
            for k, b in enumerate(before):
                least[root[k]] = min(least.get(root[k], b[0]), b[0])
            assert sorted(a[0] for a in after) == sorted(least.values())
        if name == "suffix_array_dedup":
            want = {b[0]: n - gone for b, (n, gone, _, _) in zip(before, repeats([b[1] for b in before]))}
            assert all(0 <= want[a[0]] - len(a[1].encode()) <= 8 and a[4] == len(a[1]) for a in after) and len(after) == len(before)
        if name == "benchmark_decontamination":
            assert sorted(a[0] for a in after) == sorted(i for i, _, n, _ in hits([b[:2] for b in before], items) if not n)
        if name == "sentencepiece_round_trip":
            assert len(after) == len(before) and all(a[3] for a in after)
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
    assert corpus_pipeline.run(spark, str(folder)).count() == now.count()


def test_pipeline_of_no_documents(spark, tmp_path):
    frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_steps_of_templates_go_before_pages_are_dealt_out(spark, monkeypatch):
    """Min-hashes travelled with every subtree, and subtrees lay on disk while the pages were read again."""
    from pathlib import Path

    from talentloom.llm.common import shared_folder

    steps, real = [], html_extract.stored
    monkeypatch.setattr(html_extract, "stored", lambda df: steps.append(real(df)) or steps[-1])
    folder = Path(shared_folder(spark).removeprefix("file:"))
    pages = [(i, "http://a.org/x", f"<body><nav>all of it</nav><div>site one</div><p>{prose(i, 40)}</p></body>") for i in range(9)]
    before = {x.name for x in folder.glob("talentloom-*")}
    out = html_extract.main_text(spark.createDataFrame([*pages, pages[0]], "page_id long, url string, html string"))
    assert len({x.name for x in folder.glob("talentloom-*")} - before) == 1
    assert ["like" in x.columns for x in steps] == [True, False, False]
    got = {x["page_id"]: x["text"] for x in out.collect()}
    assert got == {i: " ".join(prose(i, 40).split()) for i, *_ in pages}
