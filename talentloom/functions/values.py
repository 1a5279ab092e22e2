"""Column → Column functions on numbers, arrays, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talentloom import rules


def lenient_int(text: Column) -> Column:
    """Read ``5``, ``"5"`` and ``3.0`` as int; ``3.7`` and words give null."""
    number = text.try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("int"))


def as_array(text: Column) -> Column:
    """A JSON leaf that is a string or a list of strings → list of strings."""
    listed = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))
    return F.coalesce(listed, F.when(text.isNotNull(), F.array(text)))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def literal_strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def recommendation(score: Column) -> Column:
    """Six labels from weak to excellent."""
    first, *rest = rules.RECOMMENDATIONS
    out = F.when(score < first[0], first[1])
    for bound, label in rest:
        out = out.when(score < bound, label)
    return out.when(score.isNotNull(), rules.BEST_RECOMMENDATION)


def career_level(title: Column, years: Column) -> Column:
    """c-level, executive, senior, junior, entry or mid-level from a title and years at work."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z]+", " "), F.lit(" "))
    given = F.struct(words.alias("t"), F.coalesce(years, F.lit(0.0)).alias("y"))
    return let(given, lambda g: (
        F.when(g["t"].rlike(" (chief|cto|ceo|cfo|coo) "), "c-level")
        .when(g["t"].rlike(" (director|vp|head) "), "executive")
        .when(g["t"].rlike(" (senior|lead|principal) ") | (g["y"] >= 8), "senior")
        .when(g["t"].rlike(" junior "), "junior")
        .when(g["y"] < 1, "entry")
        .when(g["y"] < 3, "junior")
        .otherwise("mid-level")
    ))


def degree_rank(text: Column) -> Column:
    """Highest degree named in a text by whole words or usual short forms: 0 none, 1 associate … 4 doctor."""
    given = F.lower(F.coalesce(text, F.lit("")))
    return let(given, lambda t: F.greatest(F.lit(0), *[
        F.when(t.rlike(rf"(?:^|[^\p{{L}}\p{{N}}.])(?:{words})(?:$|[^\p{{L}}\p{{N}}])"), F.lit(rank)) for rank, words in rules.DEGREE_WORDS.items()
    ]))


def currency_of(country: Column) -> Column:
    """Currency of a country; the default when unknown, absent or redacted."""
    table = F.create_map(*[F.lit(x) for pair in rules.CURRENCIES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(country))), F.lit(rules.DEFAULT_CURRENCY))


def money_range(low: Column, high: Column) -> Column:
    """``$140,000 - $180,000``."""
    return F.concat(F.lit("$"), F.format_number(low, 0), F.lit(" - $"), F.format_number(high, 0))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Inside lambdas Spark shares no common subexpressions; a column used in many
    places would be computed in every one of them. ``element_at`` knows the type of
    its result once; ``get`` would work it out through the whole body for every row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
