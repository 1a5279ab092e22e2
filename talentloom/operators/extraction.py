"""Raw text → nested record.

The lines of a text are told apart by ``line_states``: its form needs no rules, no
usual headings and no blank lines. Fields of an entry are read from its lines with
column expressions: title, employer and dates on lines of their own, or on one line
parted by bars, dashes, commas or "at".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from talentloom import rules, schemas
from talentloom.functions.dates import duration_text, parse_loose_date, whole_months
from talentloom.functions.text import email_in, linkedin_in, phone_in, strip_ws, website_in, word_frame
from talentloom.functions.values import career_level, let
from talentloom.operators import line_states as ls
from talentloom.operators.text_analysis import best_industry, distinct_words, industry_fit_of

_STATE = r"^[A-Z]{2}(\s+[0-9]{5}(-[0-9]{4})?)?$"
_DATE_SPAN = r"^\(?\s*([^()]+?)\s*(?:[–—]|\s-+\s|\s(?:to|until)\s|(?<=\d{4})-+(?=\d{4}|\p{L}))\s*([^()]+?)\s*\)?$"
_ZIP = r"(?:^|\s)([A-Z0-9-]*[0-9][A-Z0-9 -]*)$"
_HEADER = "header"
_EDGES = r"^[\s,;|•·–—-]+|[\s,;|•·–—(-]+$"
#: A span, searched only from characters that one can begin with, and a date at the end of a line.
_WITHIN = r"(?=[(\s\dADFJMNOSW])" + ls.SPAN
_LAST = rf"(?=[\dADFJMNOSW])({ls.DATE})\)?$"


def with_lines(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """The frame with its ``lines``, read once."""
    return df if "lines" in df.columns else ls.read_lines(df, text)


def split_sections(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``lines`` and ``sections``: map from lower-case heading to body; bodies under the same heading are joined.

    What stands above the first heading is the ``header``.
    """
    def read(lines: Column) -> Column:
        def body(heading: Column) -> Column:
            held = F.filter(lines, lambda x: (x["heading"] == heading) & ~ls.in_states(x, *ls.HEADINGS) & ~x["line"].rlike(ls.RULE))
            return strip_ws(F.array_join(F.transform(held, lambda x: x["line"]), "\n"))

        heads = F.filter(lines, lambda x: ls.in_states(x, *ls.HEADINGS))
        named = F.transform(heads, lambda x: F.struct(
            F.lower(F.regexp_replace(x["line"], r"\s*:$", "")).alias("section"), body(x["heading"]).alias("body")))
        return F.concat(F.array(F.struct(F.lit(_HEADER).alias("section"), body(F.lit(-1)).alias("body"))), named)

    pairs = with_lines(df, text).withColumn("_pairs", let(F.col("lines"), read))
    names = F.array_distinct(F.transform("_pairs", lambda p: p.section))
    bodies = F.transform(names, lambda n: F.array_join(
        F.transform(F.filter("_pairs", lambda p: p.section == n), lambda p: p.body), "\n\n"
    ))
    return pairs.withColumn("sections", F.map_from_arrays(names, bodies)).drop("_pairs")


def _or_null(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def _has_year(line: Column) -> Column:
    """Whether a line may hold a date; others are not searched for one."""
    return line.contains("19") | line.contains("20")


def _part(parts: Column, n: int) -> Column:
    return F.get(parts, F.lit(n))


def _place(line: Column) -> tuple[Column, Column]:
    """("company", "city, ST") of a line ``company, city, ST``."""
    return (
        _or_null(strip_ws(F.regexp_extract(line, r"^([^,]*)", 1))),
        _or_null(strip_ws(F.regexp_extract(line, r"^[^,]*,(.*)$", 1))),
    )


def _undated(line: Column) -> Column:
    """A line without its span or closing year, and without the separators left at its ends."""
    def bare(x: Column) -> Column:
        return F.when(_has_year(x), F.regexp_replace(F.regexp_replace(x, _WITHIN, ""), rf"[\s,;|(–—-]+{ls.DATE}\)?$", "")).otherwise(x)

    return _or_null(F.regexp_replace(let(line, bare), _EDGES, ""))


def _span(dates: Column, line: Column, *names: str) -> Column:
    """(start, end) texts of a line of dates, or else of a span within a line; a single date is the end. ``names`` asks for one of them alone."""
    def of(start: Column, end: Column) -> Column:
        return F.struct(*[c.alias(k) for k, c in (("start", start), ("end", end)) if k in (names or ("start", "end"))])

    def read(d: Column) -> Column:
        start = _or_null(F.regexp_extract(d, _DATE_SPAN, 1))
        return of(start, F.coalesce(_or_null(F.regexp_extract(d, _DATE_SPAN, 2)), _or_null(F.regexp_extract(d, r"^\(?\s*([^()]+?)\s*\)?$", 1))))

    def inside(x: Column) -> Column:
        start = _or_null(F.regexp_extract(x, _WITHIN, 1))
        none = F.lit(None).cast("string")
        return F.when(_has_year(x), of(start, F.coalesce(_or_null(F.regexp_extract(x, _WITHIN, 2)), _or_null(F.regexp_extract(x, _LAST, 1))))).otherwise(of(none, none))

    return let(dates, lambda d: F.when(d.isNotNull(), read(d)).otherwise(let(line, inside)))


def _split_parts(line: Column) -> Column:
    """The parts of an undated line: by bars, dashes, wide gaps; else by "at"; else by commas."""
    bars = F.split(line, ls.SEPARATOR)
    at = F.split(line, r"\s+(?:at|@)\s+", 2)
    return let(bars, lambda b: F.when(F.size(b) > 1, b).otherwise(let(at, lambda a: F.when(F.size(a) > 1, a).otherwise(F.split(line, r"\s*,\s*")))))


def _named(given: Column) -> Column:
    """(title, company, location) from the role line and the employer line of an entry; one of them may hold all three."""
    def one_line(line: Column) -> Column:
        def read(parts: Column) -> Column:
            first, second = _part(parts, 0), _part(parts, 1)
            turned = ls.has_word(second, rules.TITLE_WORDS) & ~ls.has_word(first, rules.TITLE_WORDS)
            rest = F.array_join(F.filter(F.slice(parts, 3, F.greatest(F.size(parts), F.lit(1))), lambda p: p != ""), ", ")

            def told(n: Column) -> Column:
                inner, place = _place(n["company"])
                return F.struct(n["title"].alias("title"), inner.alias("company"), F.coalesce(_or_null(rest), place).alias("location"))

            ordered = let(turned, lambda t: F.struct(F.when(t, second).otherwise(first).alias("title"), F.when(t, first).otherwise(second).alias("company")))
            return let(ordered, told)

        return F.when(line.isNotNull(), let(_split_parts(line), read))

    def two_lines(role: Column, employer: Column) -> Column:
        def read(parts: Column) -> Column:
            company, place = _place(_part(parts, 0))
            rest = _or_null(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), ", "))
            return F.struct(role.alias("title"), company.alias("company"), F.coalesce(rest, place).alias("location"))

        return let(F.split(employer, ls.SEPARATOR), read)

    def choose(g: Column) -> Column:
        return F.when(g["role"].isNotNull() & g["employer"].isNotNull(), two_lines(g["role"], g["employer"])).otherwise(
            one_line(F.coalesce(g["role"], g["employer"])))

    return let(given, choose)


def _address(place: Column) -> Column:
    """``street, city[, state zip], country``, ``city, country``, or without a country ``[street,] city, ST[ zip]``."""
    def read(parts: Column) -> Column:
        n, end = F.size(parts), F.element_at(parts, -1)
        home = (n >= 2) & end.rlike(_STATE) & ~end.isin("UK", "US")
        region = F.when(home, end).when(n >= 4, F.get(parts, F.lit(2)))
        return F.struct(
            F.when(n >= 3, F.get(parts, F.lit(0))).alias("street"),
            F.when(n >= 3, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))).alias("city"),
            _or_null(F.trim(F.regexp_replace(region, _ZIP, ""))).alias("state"),
            _or_null(F.regexp_extract(region, _ZIP, 1)).alias("zipCode"),
            F.when(~home, end).alias("country"),
        )

    return F.when(place.isNotNull(), let(F.transform(F.split(place, ","), strip_ws), read))


def extract_contact(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``personalInfo``: name and address from their lines, e-mail, phone and links from the whole text."""
    def named(full: Column) -> Column:
        words = F.split(full, r"\s+")
        name = F.struct(
            F.get(words, F.lit(0)).alias("first"), F.when(F.size(words) > 1, F.element_at(words, -1)).alias("last"),
            full.alias("full"),
        )
        return F.when(full.isNotNull(), name)

    lines, whole = F.col("lines"), F.col(text)
    pieces = F.flatten(F.transform(ls.lines_in(lines, "contact"), lambda line: F.transform(F.split(line, r"[|•·]"), strip_ws)))
    place = F.get(F.filter(pieces, lambda p: p.contains(",") & ~p.contains("@") & ~p.rlike("(?i)https?:|www")), F.lit(0))
    contact = F.struct(
        email_in(whole).alias("email"), phone_in(whole).alias("phone"), let(place, _address).alias("address"),
        linkedin_in(whole).alias("linkedin"), website_in(whole).alias("website"),
    )
    name = let(ls.first_in(lines, "name"), named)
    return with_lines(df, text).withColumn("personalInfo", F.struct(name.alias("name"), contact.alias("contact")))


def extract_experience(df: DataFrame, as_of: str, skills: Column | None = None, text: str = "raw_text") -> DataFrame:
    """Add ``experience``: title, company, location, dates, what is said in sentences and what in bullets.

    Entries without title or company are left out. ``skills`` are the technical
    items of the record; those named in an entry become its technologies.
    """
    known = skills if skills is not None else F.array().cast("array<string>")
    framed = F.transform(known, lambda k: F.struct(k.alias("skill"), word_frame(k).alias("frame")))
    listed = with_lines(df, text).withColumn("_known", framed)

    def gather(lines: Column) -> Column:
        def heads(h: Column) -> Column:
            given = F.struct(_undated(h["role"]).alias("role"), _undated(h["employer"]).alias("employer"))
            return F.struct(given.alias("given"), _span(ls.first_in(lines, "work_dates"), F.concat_ws(" ", h["role"], h["employer"])).alias("span"))

        words = word_frame(F.array_join(F.transform(lines, lambda x: x["line"]), " "))
        found = let(F.struct(ls.first_in(lines, "role").alias("role"), ls.first_in(lines, "employer").alias("employer")), heads)
        return F.struct(
            found.alias("heads"), ls.lines_in(lines, "duty").alias("plain"), ls.whole_bullets(lines).alias("bullets"),
            F.when(F.size("_known") > 0, words).alias("words"),  # else nothing is looked for in them
        )

    def read(p: Column) -> Column:
        return F.struct(_named(p["heads"]["given"]).alias("n"), p["heads"]["span"].alias("span"), *[p[k].alias(k) for k in ("plain", "bullets", "words")])

    def role(r: Column) -> Column:
        start, end = r["span"]["start"], r["span"]["end"]
        return F.struct(
            r["n"]["title"].alias("title"), r["n"]["company"].alias("company"), r["n"]["location"].alias("location"),
            start.alias("start_date"), end.alias("end_date"),
            F.coalesce(F.lower(end).isin("present", "current", "now", "today", "ongoing"), F.lit(False)).alias("current"),
            duration_text(parse_loose_date(start, as_of), parse_loose_date(end, as_of)).alias("duration"),
            _or_null(F.array_join(r["plain"], " ")).alias("description"),
            r["bullets"].alias("achievements"),
            F.transform(F.filter("_known", lambda k: r["words"].contains(k["frame"])), lambda k: k["skill"]).alias("technologies"),
        )

    found = F.transform(F.transform(ls.entries_of(F.col("lines"), "work"), gather), read)
    complete = F.filter(found, lambda r: r["n"]["title"].isNotNull() & r["n"]["company"].isNotNull())
    return listed.withColumn("experience", F.transform(complete, role)).drop("_known")


_SHORT_DEGREE = r"^((?:B|M)\.?(?:Sc|A|S|Eng|Tech|BA|Ed)\.?|MBA|Ph\.?D\.?|Dipl?\.?)(?:\s*\((?:Hons|Honours)\))?\s+(?!in\b|of\b)(.+)$"


def extract_education(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``education``: degree and field, institution and place, date of graduation, grade, notes as honors.

    Entries without degree or institution are left out.
    """
    def gather(lines: Column) -> Column:
        def heads(h: Column) -> Column:
            return F.struct(
                _undated(h["degree"]).alias("degree"), _undated(h["school"]).alias("school"),
                _span(ls.first_in(lines, "school_dates"), F.concat_ws(" ", h["school"], h["degree"]), "end")["end"].alias("end"),
                ls.whole_bullets(lines).alias("notes"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"),
            )

        return let(F.struct(ls.first_in(lines, "degree").alias("degree"), ls.first_in(lines, "school").alias("school")), heads)

    def named(g: Column) -> Column:
        """(degree, institution, location)."""
        def one_line(line: Column) -> Column:
            def read(parts: Column) -> Column:
                flat = F.flatten(F.transform(parts, lambda p: F.split(p, r"\s*,\s*")))

                def first(held: Column) -> Column:
                    return _part(held, 0)["part"]

                def pick(told: Column) -> Column:
                    def beside(degree: Column) -> Column:
                        def all_three(school: Column) -> Column:
                            rest = F.filter(told, lambda x: (x["part"] != degree) & (x["part"] != school) & (x["part"] != ""))
                            place = _or_null(F.array_join(F.transform(rest, lambda x: x["part"]), ", "))
                            return F.struct(degree.alias("degree"), school.alias("institution"), place.alias("location"))

                        school = F.coalesce(first(F.filter(told, lambda x: x["school"] & (x["part"] != degree))), first(F.filter(told, lambda x: x["part"] != degree)))
                        return let(school, all_three)

                    return let(F.coalesce(first(F.filter(told, lambda x: x["degree"])), first(F.filter(told, lambda x: ~x["school"]))), beside)

                marked = F.transform(flat, lambda p: F.struct(
                    p.alias("part"), ls.has_word(p, rules.SCHOOL_WORDS).alias("school"), ls.has_word(p, rules.DEGREE_MARKS).alias("degree")))
                return let(marked, pick)

            return F.when(line.isNotNull(), let(F.split(line, ls.SEPARATOR), read))

        institution, location = _place(g["school"])
        both = F.struct(g["degree"].alias("degree"), institution.alias("institution"), location.alias("location"))
        return F.when(g["degree"].isNotNull() & g["school"].isNotNull(), both).otherwise(one_line(F.coalesce(g["degree"], g["school"])))

    def degree(p: Column) -> Column:
        head = p["n"]["degree"]
        return F.struct(
            F.coalesce(_or_null(F.regexp_extract(head, r"^(.*?)\s+in\s+", 1)), _or_null(F.regexp_extract(head, _SHORT_DEGREE, 1)), head).alias("degree"),
            F.coalesce(_or_null(F.regexp_extract(head, r"^.*?\s+in\s+(.*)$", 1)), _or_null(F.regexp_extract(head, _SHORT_DEGREE, 2))).alias("field"),
            p["n"]["institution"].alias("institution"), p["n"]["location"].alias("location"), p["end"].alias("graduation_date"),
            F.regexp_extract(p["text"], r"GPA:?\s*([0-9]\.[0-9]+)", 1).try_cast("double").alias("gpa"), p["notes"].alias("honors"),
        )

    entries = F.transform(ls.entries_of(F.col("lines"), "school"), gather)
    found = F.transform(entries, lambda g: F.struct(named(g).alias("n"), *[g[k].alias(k) for k in ("end", "notes", "text")]))
    complete = F.filter(found, lambda p: p["n"]["degree"].isNotNull() & p["n"]["institution"].isNotNull())
    return with_lines(df, text).withColumn("education", F.transform(complete, degree))


def _skill_items(listed: Column) -> Column:
    """``a, b (c, d); e`` → a, b, c, d, e: separators in parentheses do not part items, head and inner items both count."""
    outer = F.split(listed, r"[,;|•·](?![^()]*\))")
    both = F.flatten(F.transform(outer, lambda item: F.concat(
        F.array(F.regexp_replace(item, r"\(.*\)", "")), F.split(F.regexp_extract(item, r"\((.*)\)", 1), ",")
    )))
    return F.array_distinct(F.filter(F.transform(both, strip_ws), lambda s: s != ""))


def extract_skills(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``skills``: lines ``Category: a, b (c, d)`` by their category, lists without one by the heading they stand under.

    Soft skills and spoken languages are told by the category.
    """
    def groups(lines: Column) -> Column:
        def kind(g: Column) -> Column:
            low = F.lower(g["category"])
            words = F.split(F.lower(g["listed"]), r"[^\p{L}]+")
            tongues = F.arrays_overlap(words, F.array(*[F.lit(x) for x in rules.SPOKEN_LANGUAGES]))  # else languages of programming
            spoken = (low == "spoken languages") | ((low == "languages") & tongues)
            return F.when(low.isin("soft skills", "soft"), "soft").when(spoken, "spoken").otherwise("technical")

        def one(x: Column) -> Column:
            def read(line: Column) -> Column:
                labelled = line.rlike(r"^[^:]{2,40}:\s*\S")
                above = F.regexp_replace(F.get(lines, x["heading"])["line"], r"\s*:$", "")
                return F.struct(
                    F.when(labelled, strip_ws(F.regexp_extract(line, r"^([^:]+):", 1))).otherwise(F.coalesce(F.when(x["heading"] >= 0, above), F.lit("Skills"))).alias("category"),
                    F.when(labelled, F.regexp_extract(line, r"^[^:]+:(.*)$", 1)).otherwise(line).alias("listed"), labelled.alias("labelled"),
                )

            return let(F.regexp_replace(x["line"], ls.BULLET, ""), read)

        def merged(found: Column) -> Column:
            """Labelled lines as they are, the others of one heading in one group."""
            loose = F.filter(found, lambda g: ~g["labelled"])
            names = F.array_distinct(F.transform(loose, lambda g: g["category"]))
            joined = F.transform(names, lambda n: F.struct(n.alias("category"), F.array_join(
                F.transform(F.filter(loose, lambda g: g["category"] == n), lambda g: g["listed"]), ", ").alias("listed"), F.lit(False).alias("labelled")))
            return F.concat(F.filter(found, lambda g: g["labelled"]), joined)

        held = F.filter(lines, lambda x: ls.in_states(x, "skills"))
        found = let(F.transform(held, one), merged)
        return F.transform(found, lambda g: F.struct(g["category"].alias("category"), g["listed"].alias("listed"), kind(g).alias("kind")))

    listed = with_lines(df, text).withColumn("_groups", let(F.col("lines"), groups))

    def of(name: str) -> Column:
        return F.filter("_groups", lambda g: g["kind"] == name)

    spoken = F.flatten(F.transform(of("spoken"), lambda g: F.split(g["listed"], ",")))
    languages = F.transform(F.filter(spoken, lambda s: strip_ws(s) != ""), lambda s: F.struct(
        strip_ws(F.regexp_replace(s, r"\(.*\)", "")).alias("language"),
        _or_null(strip_ws(F.regexp_extract(s, r"\((.*)\)", 1))).alias("proficiency"),
    ))
    technical = F.transform(of("technical"), lambda g: F.struct(
        g["category"].alias("category"), _skill_items(g["listed"]).alias("items")
    ))
    soft = F.array_distinct(F.flatten(F.transform(of("soft"), lambda g: _skill_items(g["listed"]))))
    skills = F.struct(technical.alias("technical"), soft.alias("soft"), languages.alias("languages"))
    return listed.withColumn("skills", skills).drop("_groups")


def extract_certs(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``certifications``: name / issuer / "(Issued: …)", or all on one line parted by bars, dashes or commas."""
    def gather(lines: Column) -> Column:
        notes = F.filter(ls.lines_in(lines, "cert_note"), lambda x: ~x.startswith("(") & ~ls.has_word(x, rules.ISSUE_WORDS) & ~x.rlike(ls.ONLY_DATES))
        return let(F.regexp_replace(ls.first_in(lines, "cert"), ls.BULLET, ""), lambda line: F.struct(
            line.alias("line"), F.split(_undated(line), rf"{ls.SEPARATOR}|\s*,\s*").alias("parts"), F.regexp_replace(_part(notes, 0), ls.BULLET, "").alias("issuer"),
            F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"), F.array_join(ls.lines_in(lines, "cert_note"), "\n").alias("notes")))

    def cert(p: Column) -> Column:
        alone = p["issuer"].isNull() & (F.size(p["parts"]) > 1)
        issued = _or_null(F.regexp_extract(p["text"], r"(?:\(|^|\n|\s)Issued:?\s*([^(),\n]+?)\s*(?:[,)\n]|$)", 1))
        return F.struct(
            F.when(alone, _part(p["parts"], 0)).otherwise(F.when(p["issuer"].isNull(), _undated(p["line"])).otherwise(p["line"])).alias("name"),
            F.when(alone, F.array_join(F.slice(p["parts"], 2, F.size(p["parts"])), ", ")).otherwise(p["issuer"]).alias("issuer"),
            F.coalesce(issued, _or_null(F.regexp_extract(p["line"], _LAST, 1)), _or_null(F.regexp_extract(p["notes"], rf"(?m)^\(?({ls.DATE})\)?$", 1))).alias("issueDate"),
            _or_null(F.regexp_extract(p["text"], r"Expires:?\s*([^(),\n]+?)\s*(?:[,)\n]|$)", 1)).alias("expiryDate"),
            _or_null(F.regexp_extract(p["text"], r"(?:Credential )?ID:\s*([^(),\s]+)", 1)).alias("credentialId"),
        )

    entries = F.transform(ls.entries_of(F.col("lines"), "cert"), gather)
    found = F.filter(entries, lambda p: p["line"].isNotNull())
    return with_lines(df, text).withColumn("certifications", F.transform(found, cert))


def years_at_work(experience: Column, as_of: str) -> Column:
    """Years covered by the dated roles of a record, overlaps counted once."""
    spans = F.filter(
        F.transform(experience, lambda e: F.struct(
            parse_loose_date(e.start_date, as_of).alias("s"), parse_loose_date(e.end_date, as_of).alias("e")
        )),
        lambda x: x.s.isNotNull() & x.e.isNotNull() & (x.s <= x.e),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("months"), F.lit(None).cast("date").alias("until"))

    def add(acc: Column, span: Column) -> Column:
        return F.struct(
            (acc["months"] + F.greatest(whole_months(F.greatest(span["s"], acc["until"]), span["e"]), F.lit(0))).cast("bigint").alias("months"),
            F.greatest(acc["until"], span["e"]).alias("until"),
        )

    return F.round(F.aggregate(F.array_sort(spans), start, add)["months"] / 12, 2)


def structure_resumes(df: DataFrame, as_of: str, text: str = "raw_text") -> DataFrame:
    """Add ``structured_data`` read from raw text, ``industry_fit`` and the distinct ``words`` of the text.

    Projections and one Arrow function, no shuffle. A column named ``lines`` of the frame is worked out anew and not kept.
    """
    kept = [c for c in df.columns if c != "lines"]
    out = extract_skills(extract_contact(with_lines(df.drop("lines"), text), text), text)
    items = F.flatten(F.transform(F.col("skills.technical"), lambda t: t["items"]))
    out = extract_experience(out, as_of, items, text)
    out = extract_certs(extract_education(out, text), text)
    years = years_at_work(F.col("experience"), as_of)
    level = career_level(F.get("experience", F.lit(0))["title"], F.col("_years"))
    out = out.withColumn("_years", years).withColumn("words", distinct_words(F.col(text)))
    out = out.withColumn("_fit", industry_fit_of(F.col("words")))
    summary = F.struct(
        _or_null(F.array_join(ls.lines_in(F.col("lines"), "summary"), " ")).alias("text"), level.alias("careerLevel"),
        best_industry(F.col("_fit")).alias("industryFocus"), F.col("_years").alias("yearsOfExperience"),
    )
    parts = {"summary": summary} | {k: F.col(k) for k in ("personalInfo", "experience", "education", "skills", "certifications")}
    doc = F.struct(*[parts[f.name].cast(f.dataType).alias(f.name) for f in schemas.DOC.fields])  # cast by field: a query that asks for some reads those
    return out.withColumn("structured_data", doc).select(*kept, "structured_data", F.col("_fit").alias("industry_fit"), "words")
