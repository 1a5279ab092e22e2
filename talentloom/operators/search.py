"""Search over candidate profiles: criteria, relevance, sort, pages, facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SORT_COLUMNS = {"relevance": "relevance", "date": "seen_on", "experience": "years", "salary": "salary"}
MAX_PAGE = 100
MAX_DEPTH = 10_000
DEFAULT_PAGE = 20


def criteria_columns(
    skills: list[str] | None = None,
    years_min: float | None = None,
    years_max: float | None = None,
    education_level: list[str] | None = None,
    education_field: str | None = None,
    city: str | None = None,
    state: str | None = None,
    country: str | None = None,
    job_title: str | None = None,
    career_level: str | None = None,
    salary_min: float | None = None,
    salary_max: float | None = None,
) -> dict[str, Column]:
    """One condition per given criterion, over the columns of a profile."""
    out: dict[str, Column] = {}

    def equals(name: str, column: str, value: str | None) -> None:
        if value is not None:
            out[name] = F.lower(column) == value.lower()

    if skills:
        wanted = F.array(*[F.lit(s.lower().strip()) for s in skills])
        out["skills"] = F.forall(wanted, lambda s: F.array_contains("skills", s))
    if years_min is not None:
        out["years_min"] = F.col("years") >= years_min
    if years_max is not None:
        out["years_max"] = F.col("years") <= years_max
    if education_level:
        out["education_level"] = F.lower("education_level").isin([e.lower() for e in education_level])
    if education_field is not None:
        out["education_field"] = F.lower("education_field").contains(education_field.lower())
    equals("city", "city", city)
    equals("state", "state", state)
    equals("country", "country", country)
    if job_title is not None:
        out["job_title"] = F.lower("job_title").contains(job_title.lower())
    equals("career_level", "career_level", career_level)
    if salary_min is not None:
        out["salary_min"] = F.col("salary") >= salary_min
    if salary_max is not None:
        out["salary_max"] = F.col("salary") <= salary_max
    return out


def search(df: DataFrame, **criteria) -> DataFrame:
    """Profiles which meet every given criterion; plain filters, so they reach the scan."""
    for condition in criteria_columns(**criteria).values():
        df = df.filter(condition)
    return df


def relevance(df: DataFrame, **criteria) -> DataFrame:
    """Add ``relevance`` (criteria met / given, 0..1) and ``matched_criteria`` (map of those met)."""
    given = criteria_columns(**criteria)
    if not given:
        return df.withColumn("relevance", F.lit(1.0)).withColumn("matched_criteria", F.create_map().cast("map<string,boolean>"))
    met = [F.coalesce(c, F.lit(False)) for c in given.values()]
    flags = F.map_from_arrays(F.array(*[F.lit(n) for n in given]), F.array(*met))
    total = met[0].cast("int")
    for m in met[1:]:
        total = total + m.cast("int")
    return df.withColumn("relevance", F.round(total / len(met), 4)).withColumn(
        "matched_criteria", F.map_filter(flags, lambda _, v: v)
    )


def sort_columns(field: str = "relevance", order: str = "desc", id_col: str = "resume_id") -> list[Column]:
    """Sort keys; rows without the value come last, the id settles ties."""
    if field not in SORT_COLUMNS:
        raise ValueError(f"sort field must be one of {sorted(SORT_COLUMNS)}")
    if order not in ("asc", "desc"):
        raise ValueError("sort order must be asc or desc")
    column = F.col(SORT_COLUMNS[field])
    return [column.desc_nulls_last() if order == "desc" else column.asc_nulls_last(), F.asc(id_col)]


def sort_results(df: DataFrame, field: str = "relevance", order: str = "desc", id_col: str = "resume_id") -> DataFrame:
    return df.orderBy(*sort_columns(field, order, id_col))


def page(df: DataFrame, keys: list[Column], number: int = 1, limit: int = DEFAULT_PAGE) -> DataFrame:
    """One page of the sorted rows; every task keeps only the rows up to the end of the page, so deep pages are refused (see ``page_after``)."""
    if number < 1 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"page must be at least 1, limit from 1 to {MAX_PAGE}")
    if number * limit > MAX_DEPTH:
        raise ValueError(f"a page may end at row {MAX_DEPTH} at most; page_after goes on from there")
    return df.orderBy(*keys).offset((number - 1) * limit).limit(limit)


def page_after(df: DataFrame, key: str, id_col: str, after: tuple, limit: int = DEFAULT_PAGE) -> DataFrame:
    """The page behind the row (value, id) in descending order of ``key``: deep pages cost the same as the first.

    Rows without a value come last, as in ``sort_results``: behind a row with a
    value they all follow, behind one without only those with a higher id.
    """
    value, last_id = after
    beyond = F.col(id_col) > F.lit(last_id)
    if value is None:
        behind = F.col(key).isNull() & beyond
    else:
        behind = (F.col(key) < F.lit(value)) | F.col(key).isNull() | ((F.col(key) == F.lit(value)) & beyond)
    return df.filter(behind).orderBy(F.col(key).desc_nulls_last(), F.asc(id_col)).limit(limit)


def page_info(df: DataFrame, number: int = 1, limit: int = DEFAULT_PAGE) -> DataFrame:
    """(page, limit, total, total_pages) of a result."""
    return df.agg(F.count("*").alias("total")).select(
        F.lit(number).alias("page"), F.lit(limit).alias("limit"), "total",
        F.ceil(F.col("total") / limit).cast("bigint").alias("total_pages"),
    )


def facets(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n) for several fields in one pass over the rows."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields
    ])).alias("p")
    return (
        df.select(pairs).filter(F.col("p.value").isNotNull())
        .groupBy(F.col("p.field").alias("field"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))
    )
