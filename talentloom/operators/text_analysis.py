"""Terms, language, bias wording and personal data in whole texts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from talentloom import rules, schemas
from talentloom.functions.text import email_in, first_line, linkedin_in, phone_in, redact_text, tokens, website_in
from talentloom.functions.values import let


def tag_terms(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, category, n_terms): distinct lexicon terms found in each text, per category.

    Only distinct words of a text are exploded, so frequent words cost one row
    per document; the lexicon (term, category) is an equi join on the word.
    (The outer form of explode spares Spark's extra filter, which would cut every
    text into words a second time; the join drops texts without words.)
    """
    words = docs.select(id_col, F.explode_outer(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return (
        words.join(lexicon.select("term", "category").distinct(), "term", "inner")
        .groupBy(id_col, "category")
        .agg(F.count("*").alias("n_terms"))
    )


def industry_fit(tagged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, industry_fit map): terms of an industry against the best industry, 0..1 with two digits.

    The map holds at most one entry per lexicon category.
    """
    entries = F.array_sort(F.collect_list(F.struct("category", "n_terms")))
    grouped = tagged.groupBy(id_col).agg(F.max("n_terms").alias("_top"), entries.alias("_entries"))
    scaled = F.transform("_entries", lambda e: F.struct(e.category, F.round(e.n_terms / F.col("_top"), 2)))
    return grouped.select(id_col, F.map_from_entries(scaled).alias("industry_fit"))


def distinct_words(text: Column) -> Column:
    """Distinct lower-case words of a text; underscores count as letters."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), rules.WORD_SPLIT))


def _among(words: Column, lists: dict) -> Column:
    """The few words of a text that stand in any of some lists, in one pass."""
    return F.filter(words, lambda w: w.isin(*sorted({t for terms in lists.values() for t in terms})))


def industry_fit_of(words: Column) -> Column:
    """The same map with the built-in industry terms, from the distinct words of a text."""
    names = sorted(rules.INDUSTRY_TERMS)
    hits = let(_among(words, rules.INDUSTRY_TERMS), lambda held: F.array(*[
        F.size(F.array_intersect(held, F.array(*[F.lit(t) for t in rules.INDUSTRY_TERMS[n]]))) for n in names
    ]))

    def scale(hits: Column) -> Column:
        top = F.array_max(hits)
        shares = F.transform(hits, lambda h: F.round(h / top, 2))
        found = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), shares), lambda _, v: v > 0)
        return F.when(top > 0, found).otherwise(F.create_map().cast("map<string,double>"))

    return let(hits, scale)


def best_industry(fit: Column) -> Column:
    """Industry with the highest fit, the first by name on a tie."""
    ranked = F.array_sort(F.transform(F.map_entries(fit), lambda e: F.struct((-e.value).alias("v"), e.key.alias("k"))))
    return F.get(ranked, F.lit(0))["k"]


def detect_language(docs: DataFrame, text: str = "text", stopwords: dict[str, list[str]] = rules.STOP_WORDS, words: Column | None = None) -> DataFrame:
    """Add ``language`` and ``stop_words``: the language with most distinct stop words in the text.

    The first by name wins a tie; null when no stop word occurs. ``words`` are the distinct words of the text, when the caller has cut it already.
    """
    if words is None:
        cut = tokens(F.col(text))
    else:  # an underscore is a letter there
        parted = F.when(F.exists(words, lambda w: w.contains("_")), F.flatten(F.transform(words, lambda w: F.split(w, "_")))).otherwise(words)
        cut = F.when(F.col(text).isNotNull(), F.filter(parted, lambda w: w != ""))
    words = F.array_distinct(_among(cut, stopwords))
    langs = sorted(stopwords)
    scored = docs.withColumn("_words", words).withColumn("_n", F.array(*[
        F.size(F.array_intersect("_words", F.array(*[F.lit(w) for w in stopwords[lang]]))) for lang in langs
    ]))
    top = F.array_max("_n")
    names = F.array(*[F.lit(lang) for lang in langs])
    language = F.when(top > 0, F.element_at(names, F.array_position("_n", top).cast("int")))
    return scored.withColumn("language", language).withColumn("stop_words", top).drop("_words", "_n")


def bias_hits(text: Column, words: Column) -> Column:
    """Struct of the distinct biased words and phrases per category, from a text and its distinct words."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def read(held: Column) -> Column:
        def stands(phrase: str) -> Column:
            """Whether a phrase stands in the text: all its words do, and side by side."""
            return functools.reduce(lambda a, b: a & b, [F.array_contains(held, w) for w in phrase.split(" ")]) & low.rlike(rules.whole_words(phrase))

        parts = []
        for category, terms in rules.BIAS_WORDS.items():
            single = F.array(*[F.lit(t) for t in terms if " " not in t])
            phrases = [F.when(stands(t), t) for t in terms if " " in t]
            found = F.filter(F.array(*phrases), lambda p: p.isNotNull()) if phrases else F.array().cast("array<string>")
            parts.append(F.concat(F.array_intersect(held, single), found).alias(category))
        return F.struct(*parts)

    return let(_among(words, {c: " ".join(terms).split(" ") for c, terms in rules.BIAS_WORDS.items()}), read)


def _as_findings(category: str, hits: Column) -> Column:
    return F.transform(hits, lambda hit: F.struct(
        F.lit(category).alias("category"), hit.alias("finding"),
        F.lit(rules.BIAS_SUGGESTION[category]).alias("suggestion"),
    ))


def bias_report(
    df: DataFrame,
    as_of: str,
    text: str = "raw_text",
    education: Column | None = None,
    language: Column | None = None,
    words: Column | None = None,
) -> DataFrame:
    """Add ``biasReport``: biased words by category, and graduation years of long ago.

    ``education`` is the list of degrees of the record. ``language`` limits the
    word lists to English texts. ``words`` are the distinct words of the text,
    when the caller has cut it already.
    """
    cut = df.withColumn("_words", distinct_words(F.col(text)) if words is None else words)
    hits = bias_hits(F.col(text), F.col("_words"))
    if language is not None:
        hits = F.when(language.eqNullSafe("en"), hits)
    none = F.array().cast("array<string>")
    parts = [_as_findings(c, F.coalesce(F.col("_hits")[c], none)) for c in rules.BIAS_WORDS]
    if education is not None:
        last = int(as_of[:4]) - rules.OLD_GRADUATION_YEARS
        years = F.transform(
            F.coalesce(education, F.array().cast(schemas.arr(schemas.DEGREE))),
            lambda e: F.regexp_extract(F.coalesce(e.graduation_date, F.lit("")), r"([0-9]{4})", 1),
        )
        old = F.filter(years, lambda y: (y != "") & (y.try_cast("int") <= last))
        parts.append(_as_findings("Age", F.array_distinct(old)))
    findings = F.concat(*parts)
    return cut.withColumn("_hits", hits).withColumn("_findings", findings).withColumn(
        "biasReport", F.struct((F.size("_findings") > 0).alias("biasDetected"), F.col("_findings").alias("findings"))
    ).drop("_findings", "_hits", "_words")


def bias_summary(reports: DataFrame, id_col: str = "id") -> DataFrame:
    """Findings per category over the corpus: records concerned, findings, distinct wordings.

    The first finding of a category in a record is marked inside the row, so that
    records can be counted without gathering them. Equal wordings are counted
    before they meet by category.
    """
    found = F.col("biasReport.findings")
    names = F.transform(found, lambda f: f["category"])
    marked = F.transform(found, lambda f, i: F.struct(
        f["category"].alias("category"), f["finding"].alias("finding"),
        (F.array_position("_names", f["category"]) == i + 1).cast("int").alias("first"),
    ))
    rows = (
        reports.select(id_col, "biasReport").withColumn("_names", names)
        .select(F.explode_outer(marked).alias("f")).filter(F.col("f").isNotNull()).select("f.*")
    )
    wordings = rows.groupBy("category", "finding").agg(F.count("*").alias("_n"), F.sum("first").alias("_records"))
    return wordings.groupBy("category").agg(
        F.sum("_records").alias("records"), F.sum("_n").alias("findings"), F.count("*").alias("wordings")
    )


def contact_fields(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add full_name, first_name, last_name, email, phone, linkedin, website found in a text."""
    body = F.col(text)
    words = F.split("full_name", r"\s+")
    return (
        df.withColumn("full_name", first_line(body))
        .withColumn("first_name", F.get(words, F.lit(0)))
        .withColumn("last_name", F.when(F.size(words) > 1, F.element_at(words, -1)))
        .withColumn("email", email_in(body))
        .withColumn("phone", phone_in(body))
        .withColumn("linkedin", linkedin_in(body))
        .withColumn("website", website_in(body))
    )


def redact(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``redacted``: the whole text without e-mail addresses, phone numbers and profile links."""
    return df.withColumn("redacted", redact_text(F.col(text)))
