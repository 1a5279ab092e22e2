"""Résumés in forms without rules: what each line is, and all entries read from them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talentloom.operators import extraction, line_states

AS_OF = "2024-02-01"
TEXTS = {
    "bars": """Priya Raman
22 Mill Road, Leeds, LS1 4AP, UK | priya.raman@post.example.org | +44 113 496 0000

Ledger work, audits, and payroll.

EXPERIENCE
Senior Accountant | Acme Corp | Jan 2019 - Present
- Cut closing time by 20%
- Ledger work for nine entities, with
  monthly reports to the board
Accountant | Birch & Co, York | 2015 - 2018
- Kept the books

EDUCATION
BSc Accounting, University of Leeds, 2012
A-levels, York College, 2009

SKILLS
Excel, SQL, SAP
Xero; Sage; Power BI

CERTIFICATIONS
ACCA, Association of Chartered Certified Accountants, 2016
Certified Payroll Specialist (2018)
""",
    "plain": """TOMAS HERRERA
Madrid, Spain
tomas@post.example.org
(555) 210-4433

Careful backend developer who likes small services and clear logs.

Software Developer
Cobalt Systems, Madrid, Spain
Mar 2020 - Present
Owns the billing service.
- Moved invoices to Kafka
- Wrote tests in Python

Junior Developer
Iberia Software GmbH, Sevilla, Spain
2017 - 2020
- Fixed bugs in Java

Master of Science in Computer Science
University of Madrid, Madrid, Spain
2015 - 2017

Bachelor of Science in Mathematics
University of Sevilla, Sevilla, Spain
2011 - 2015

Python, Java, Kafka, PostgreSQL

Certified Kubernetes Administrator
Issued: 2021
""",
    "firm first": """Lena Brandt
lena@post.example.org | 030 1234567
Profile
Nurse with ten years on surgical wards.

Employment History

Charité Hospital, Berlin, Germany
Head Nurse
2018 - Present
• Leads a team of 14
• Plans the rota

St. Anna Clinic, Potsdam, Germany
Ward Nurse
April 2012 - December 2017
• Cared for patients after surgery

Education
Akademie der Gesundheit, Berlin, Germany
Diploma in Nursing
2009 - 2012

Skills
• Patient care
• Wound care
• Triage

Languages
German (native), English (B2)
""",
    "dates first": """Omar Said
Lyon, France | omar@post.example.org

Work Experience
2019 – Present
Warehouse Manager, Rhône Logistics, Lyon
Runs two sites with ninety people.

2014 – 2019
Shift Supervisor, Nord Stores, Lille
Planned shifts and stock.

Education
2010 – 2013
Licence in Logistics, Université Lyon 2, Lyon

Key Skills
Planning: rotas, stock, budgets
Tools: SAP, Excel
""",
    "at": """Ann Doe
ann@post.example.org

Experience

Data Analyst at Northwind Ltd (2020 - 2023)
Built reports for sales.
Research Assistant at Example University (2018 - 2020)

Education

PhD in Statistics — Example University, 2018

Technical Skills

R, Python, Stata
""",
}
ROLES = {
    "bars": [("Senior Accountant", "Acme Corp", None, "Jan 2019", "Present", None, ["Cut closing time by 20%", "Ledger work for nine entities, with monthly reports to the board"]),
             ("Accountant", "Birch & Co", "York", "2015", "2018", None, ["Kept the books"])],
    "plain": [("Software Developer", "Cobalt Systems", "Madrid, Spain", "Mar 2020", "Present", "Owns the billing service.", ["Moved invoices to Kafka", "Wrote tests in Python"]),
              ("Junior Developer", "Iberia Software GmbH", "Sevilla, Spain", "2017", "2020", None, ["Fixed bugs in Java"])],
    "firm first": [("Head Nurse", "Charité Hospital", "Berlin, Germany", "2018", "Present", None, ["Leads a team of 14", "Plans the rota"]),
                   ("Ward Nurse", "St. Anna Clinic", "Potsdam, Germany", "April 2012", "December 2017", None, ["Cared for patients after surgery"])],
    "dates first": [("Warehouse Manager", "Rhône Logistics", "Lyon", "2019", "Present", "Runs two sites with ninety people.", []),
                    ("Shift Supervisor", "Nord Stores", "Lille", "2014", "2019", "Planned shifts and stock.", [])],
    "at": [("Data Analyst", "Northwind Ltd", None, "2020", "2023", "Built reports for sales.", []), ("Research Assistant", "Example University", None, "2018", "2020", None, [])],
}
DEGREES = {
    "bars": [("BSc", "Accounting", "University of Leeds", None, "2012"), ("A-levels", None, "York College", None, "2009")],
    "plain": [("Master of Science", "Computer Science", "University of Madrid", "Madrid, Spain", "2017"),
              ("Bachelor of Science", "Mathematics", "University of Sevilla", "Sevilla, Spain", "2015")],
    "firm first": [("Diploma", "Nursing", "Akademie der Gesundheit", "Berlin, Germany", "2012")],
    "dates first": [("Licence", "Logistics", "Université Lyon 2", "Lyon", "2013")],
    "at": [("PhD", "Statistics", "Example University", None, "2018")],
}
SKILLS = {
    "bars": [("SKILLS", ["Excel", "SQL", "SAP", "Xero", "Sage", "Power BI"])], "plain": [("Skills", ["Python", "Java", "Kafka", "PostgreSQL"])],
    "firm first": [("Skills", ["Patient care", "Wound care", "Triage"])], "dates first": [("Planning", ["rotas", "stock", "budgets"]), ("Tools", ["SAP", "Excel"])],
    "at": [("Technical Skills", ["R", "Python", "Stata"])],
}
CERTIFICATES = {
    "bars": [("ACCA", "Association of Chartered Certified Accountants", "2016"), ("Certified Payroll Specialist", None, "2018")],
    "plain": [("Certified Kubernetes Administrator", None, "2021")], "firm first": [], "dates first": [], "at": [],
}
NAMES = {"bars": "Priya Raman", "plain": "TOMAS HERRERA", "firm first": "Lena Brandt", "dates first": "Omar Said", "at": "Ann Doe"}
PLACES = {"bars": ("22 Mill Road", "Leeds", "LS1 4AP", "UK"), "plain": (None, "Madrid", None, "Spain"), "firm first": None, "dates first": (None, "Lyon", None, "France"), "at": None}
SUMMARIES = {"bars": "Ledger work, audits, and payroll.", "plain": "Careful backend developer who likes small services and clear logs.",
             "firm first": "Nurse with ten years on surgical wards.", "dates first": None, "at": None}


@pytest.fixture(scope="module")
def docs(spark):
    windows = [(f"{k} crlf", t.replace("\n", "\r\n")) for k, t in TEXTS.items()]
    df = spark.createDataFrame([*TEXTS.items(), *windows], "id string, raw_text string")
    return {r.id: r.structured_data for r in extraction.structure_resumes(df, AS_OF).select("id", "structured_data").collect()}


@pytest.mark.parametrize("form", [f + end for f in TEXTS for end in ("", " crlf")])
def test_all_entries(docs, form):
    doc, form = docs[form], form.removesuffix(" crlf")
    assert [(e.title, e.company, e.location, e.start_date, e.end_date, e.description, e.achievements) for e in doc.experience] == ROLES[form]
    assert [(e.degree, e.field, e.institution, e.location, e.graduation_date) for e in doc.education] == DEGREES[form]
    assert [(t.category, t["items"]) for t in doc.skills.technical] == SKILLS[form]
    assert [(c.name, c.issuer, c.issueDate) for c in doc.certifications] == CERTIFICATES[form]
    assert doc.personalInfo.name.full == NAMES[form] and doc.summary.text == SUMMARIES[form]
    a = doc.personalInfo.contact.address
    assert (a and (a.street, a.city, a.zipCode, a.country)) == PLACES[form]
    assert [x.language for x in doc.skills.languages] == (["German", "English"] if form == "firm first" else [])


def test_awkward_texts(spark):
    texts = [None, "", " \n\t\n", "---", "---\n---\n---", "x" * 200_000, "\n".join(["Experience"] * 50), "a\x00b", "日本\n\n経験\n" * 40, "\n".join(f"- line {k}" for k in range(20_000)),
             "Ann Doe\n" + "Clerk, Acme Ltd, 2010 - 2012\n" * 3000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "id int, raw_text string, lines int")
    out = {r.id: r.structured_data for r in extraction.structure_resumes(df, AS_OF).collect()}
    assert len(out) == len(texts) and out[0].personalInfo.name is None and out[3].experience == []
    assert len(out[10].experience) == 3000 and {e.company for e in out[10].experience} == {"Acme Ltd"}
    assert extraction.structure_resumes(df.where("false"), AS_OF).count() == 0


def plain_chain(evidence):
    """Every state and step, one line after the other."""
    best = [(line_states._START[s] + evidence[0, s], [s]) for s in range(len(line_states.STATES))]
    for row in evidence[1:]:
        best = [max(((score + line_states._STEPS[path[-1], s] + row[s], [*path, s]) for score, path in best), key=lambda x: x[0]) for s in range(len(line_states.STATES))]
    return max(best, key=lambda x: x[0])


def test_chains_are_the_best_ones():
    r = np.random.default_rng(1)
    sizes = np.array([9, 7, 7, 3, 1, 1])
    evidence = r.normal(0, 4, (sizes.sum(), len(line_states.STATES))).astype(np.float32)
    got = line_states._chains(evidence, sizes)
    at = 0
    for n in sizes:
        score, path = plain_chain(evidence[at : at + n])
        mine = got[at : at + n]
        assert mine.tolist() == path
        at += n


def test_a_text_is_read_alike_in_any_batch():
    r = random.Random(3)
    bits = [[r.choice([1, 2, *[1 << r.randrange(2, 26) for _ in range(6)]]) for _ in range(r.randrange(0, 30))] for _ in range(60)]
    lengths = np.array([len(b) for b in bits])
    whole = line_states.chain_of(np.array(sum(bits, []), np.int64), lengths)
    at = 0
    for b in bits:
        alone = line_states.chain_of(np.array(b, np.int64), np.array([len(b)]))
        for x, y in zip(whole, alone):
            assert x[at : at + len(b)].tolist() == y.tolist()
        at += len(b)


def plain_bits(line):
    """The evidence of a line with every pattern searched in every line."""
    ls = line_states
    held = {name: line.rlike(pattern) for name, pattern in ls.PATTERNS.items()}
    words = F.split(F.regexp_replace(F.lower(line), "[.'’]", ""), r"[^\p{L}]+")
    held |= {name: F.arrays_overlap(words, F.array(*[F.lit(x) for x in names])) for name, names in ls.WORDS.items()}
    held["degree_word"] = held["degree_word"] | F.get(words, F.lit(0)).isin(*ls.rules.SHORT_DEGREES)
    n = F.size(F.split(line, " "))
    stops = line.rlike(r"\p{L}{2}[.!?]$") & ~line.rlike(r"(?:Inc|Ltd|Corp|Co|LLC|Jr|Sr)\.$")
    held |= {"sentence": (n >= 12) | ((n >= 3) & stops) | ((n >= 5) & line.rlike("[.!?]$")), "short": n <= 6}
    dated = line.rlike(r"(?:19|20)\d\d|^\(")
    held |= {"span": dated & line.rlike(ls.SPAN), "only_dates": dated & line.rlike(ls.ONLY_DATES), "year": dated & line.rlike(r"(?:^|\D)(?:19|20)\d\d(?:\D|$)")}
    links = line.contains("http") | line.contains("www.") | line.contains("linkedin.com") | line.contains("github.com")
    held["contact"] = line.rlike(ls.rules.EMAIL_PATTERN) | links | (line.rlike(r"\d\d.*\d\d") & line.rlike(ls.rules.PHONE_PATTERN))
    bits = sum((F.when(h, F.lit(1 << ls._BITS[name])).otherwise(F.lit(0)).cast("long") for name, h in held.items()), F.lit(0).cast("long"))
    return F.when(line == "", F.lit(1)).when(line.rlike(ls.RULE), F.lit(2)).otherwise(bits).cast("long")


def test_guarded_evidence_is_that_of_all_patterns(spark):
    r = random.Random(1)
    atoms = [*" \t\x0b\f\x85 .,;:|•·-–—!?()@+'’*", "  ", "   ", " at ", "at", "to", " until ", "2019", "19", "20", "1987-05", "Jan ", "present", "Senior", "BSc", "B.A.", "ba",
             "Inc.", "Ltd.", "Experience", "work history", "EDUCATION", "Skills:", "école", "ÉCOLE", "İ", "ß", "certified", "acca", "manager", "x", "Yz", "555 210-4433", "http",
             "a@b.example.org", "GPA: 3.5", "university of", "---", "B"]
    lines = ["".join(r.choice(atoms) for _ in range(r.randrange(9))).strip(" \t\x0b\f") for _ in range(4000)]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").repartition(8)
    got = rows.select("line", F.transform(F.array("line"), line_states.line_bits)[0].alias("got"), plain_bits(F.col("line")).alias("want"))
    assert [(x.line, x.got, x.want) for x in got.where("got <> want").collect()] == []


def test_texts_of_one_row_group_are_dealt_out(spark, tmp_path):
    from talentloom.plans.views import Tables

    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(0, 0, "N")], "n_nationkey int, n_regionkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "C", 0, "TRADE", 1.0)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(400).selectExpr("id as o_orderkey", "1L as o_custkey", "'O' as o_orderstatus", "10D as o_totalprice", "timestamp '2020-01-01' as o_orderdate", "'1-URGENT' as o_orderpriority")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for texts in (Tables(spark, str(tmp_path)).resume_texts_v(), Tables(spark, str(tmp_path)).resume_layouts_v()):
            per_task = [x["count"] for x in texts.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(per_task) == 400 and len(per_task) == 8 and max(per_task) < 100
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_evidence_of_a_batch_is_that_of_each_line(spark):
    r = random.Random(2)
    atoms = [*" \t\x0b\f\x85  .,;:|•·-–—!?()@+'’*=_ſK", "  ", "   ", " at ", "at", "to", " until ", "2019", "19", "20", "1987-05", "2001-02-03", "Jan ", "3/", "present", "Senior",
             "BSc", "B.A.", "ba", "Inc.", "Ltd.", "Experience", "work history", "EDUCATION", "sKills", "Skills:", "skillſ", "école", "ÉCOLE", "İnc", "ß", "certified", "acca",
             "manager", "x", "Yz", "555 210-4433", "http", "a@b.example.org", "GPA: 3.5", "university of", "---", "===", "B", "😀", "Ünal", "NW1 4AB", "Excel, SQL, x", "a" * 40, "Work. "]
    lines = ["".join(r.choice(atoms) for _ in range(r.randrange(10))).strip(" \t\x0b\f") for _ in range(8000)]
    want = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string").repartition(8).select("k", plain_bits(F.col("line")).alias("want")).collect()
    got = line_states.bits_of(pa.array(lines, pa.string()))
    assert [(lines[x.k], x.want, int(got[x.k])) for x in want if x.want != got[x.k]] == []
    assert len(line_states.bits_of(pa.array([], pa.string()))) == 0 and line_states.bits_of(pa.array(["", "---", ""])).tolist() == [1, 2, 1]


def test_lines_of_null_blank_and_odd_texts(spark):
    texts = [None, "", "\r\n", " A \r B\n\x0bC\t\r\n", "x�y"]
    rows = line_states.read_lines(spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, raw_text string")).collect()
    assert {x.k: [y.line for y in x.lines] for x in rows} == {0: [""], 1: [""], 2: ["", ""], 3: ["A", "B", "C", ""], 4: ["x�y"]}
    broken = line_states.read_lines(spark.sql("select cast(unhex('41FF420A43') as string) as raw_text")).select("lines.line").first()[0]
    assert broken == ["A�B", "C"]


def test_texts_cost_no_expression_for_each_line(spark):
    """The evidence was a tree of some hundred nested column expressions, worked out line by line; it is one function over batches."""
    rows = line_states.read_lines(spark.createDataFrame([("a",)], "raw_text string"))
    assert "rlike" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
