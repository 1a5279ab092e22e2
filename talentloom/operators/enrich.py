"""Enrichment of records: anonymous copy, scores, employment, salary, career."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from talentloom import rules, schemas
from talentloom.functions.dates import whole_months
from talentloom.functions.values import currency_of
from talentloom.operators.ordered import exact_quantiles, next_in_order


def _redacted(old: Column, dtype) -> Column:
    if hasattr(dtype, "fields"):
        inner = F.struct(*[_redacted(old[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(old.isNotNull(), inner)
    return F.when(old.isNotNull(), F.lit(rules.REDACTED))


def anonymize(df: DataFrame, doc: str = "structured_data") -> DataFrame:
    """Add ``anonymizedData``: the record with every leaf of name and contact redacted; absent leaves stay absent."""
    info = F.col(doc)["personalInfo"]
    hidden = F.when(info.isNotNull(), _redacted(info, schemas.PERSONAL_INFO))
    return df.withColumn("anonymizedData", F.when(F.col(doc).isNotNull(), F.col(doc).withField("personalInfo", hidden)))


def _has_text(value: Column) -> Column:
    return F.coalesce(F.length(F.trim(value)) > 0, F.lit(False))


def _has_rows(rows: Column) -> Column:
    return F.coalesce(F.size(rows) > 0, F.lit(False))


def score_blocks(blocks: dict[str, Column]) -> tuple[Column, Column]:
    """(completenessScore, suggestions) from one presence flag per block."""
    points = [F.when(blocks[name], weight).otherwise(0) for name, weight, _ in rules.COMPLETENESS_WEIGHTS]
    total = points[0]
    for p in points[1:]:
        total = total + p
    hints = F.array(*[F.when(~blocks[name], hint) for name, _, hint in rules.COMPLETENESS_WEIGHTS])
    return total.cast("int"), F.filter(hints, lambda h: h.isNotNull())


def quality_score(completeness: Column, figures: Column, roles: Column, summary_chars: Column) -> Column:
    """0..100 from completeness, achievements with a percentage, two or more roles, a summary of fair length."""
    return (
        F.floor(completeness * 6 / 10).cast("int")
        + F.when(figures, 20).otherwise(0)
        + F.when(roles >= 2, 10).otherwise(0)
        + F.when(summary_chars.between(100, 1500), 10).otherwise(0)
    ).cast("int")


def quality_scores(df: DataFrame, doc: str = "structured_data") -> DataFrame:
    """Add completenessScore, qualityScore and suggestions."""
    d = F.col(doc)
    contact = d["personalInfo"]["contact"]
    blocks = {
        "full_name": _has_text(d["personalInfo"]["name"]["full"]),
        "email": _has_text(contact["email"]),
        "phone": _has_text(contact["phone"]),
        "address": contact["address"].isNotNull(),
        "summary": _has_text(d["summary"]["text"]),
        "experience": _has_rows(d["experience"]),
        "education": _has_rows(d["education"]),
        "skills": _has_rows(d["skills"]["technical"]),
        "certifications": _has_rows(d["certifications"]),
    }
    completeness, suggestions = score_blocks(blocks)
    figures = F.coalesce(
        F.exists(d["experience"], lambda e: F.coalesce(
            F.exists(e["achievements"], lambda a: a.rlike("[0-9]+%")), F.lit(False))),
        F.lit(False),
    )
    roles = F.coalesce(F.size(d["experience"]), F.lit(0))
    chars = F.coalesce(F.length(d["summary"]["text"]), F.lit(0))
    return (
        df.withColumn("completenessScore", completeness)
        .withColumn("qualityScore", quality_score(F.col("completenessScore"), figures, roles, chars))
        .withColumn("suggestions", suggestions)
    )


def skill_groups(resume_skills: DataFrame, nested: bool = False) -> DataFrame:
    """Technical skills per category: (resume_id, category, items), or one nested list per résumé.

    Lists hold distinct skills, so their length is bounded by the skill vocabulary.
    """
    groups = (
        resume_skills.groupBy("resume_id", "category")
        .agg(F.array_sort(F.collect_set("skill")).alias("items"))
    )
    if not nested:
        return groups
    return groups.groupBy("resume_id").agg(F.array_sort(F.collect_list(F.struct("category", "items"))).alias("technical"))


def merge_employment(experience: DataFrame, as_of: str) -> DataFrame:
    """Merge overlapping roles: (resume_id, start_date, end_date, n_roles, gap_days to the stretch before).

    Roles that start on the same day always overlap, so they are folded first,
    before the shuffle. The window then sees at most one row per calendar day of
    a résumé, however many roles it has.
    """
    days = (
        experience.filter(F.col("start_date").isNotNull())
        .withColumn("end_date", F.coalesce("end_date", F.lit(as_of).cast("date")))
        .filter(F.col("start_date") <= F.col("end_date"))
        .groupBy("resume_id", "start_date")
        .agg(F.max("end_date").alias("end_date"), F.count("*").alias("n_roles"))
    )
    by_start = Window.partitionBy("resume_id").orderBy("start_date")
    until = F.max("end_date").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    flagged = days.withColumn("_until", until).withColumn(
        "_new", F.when(F.col("_until").isNull() | (F.col("start_date") > F.col("_until")), 1).otherwise(0)
    )
    island = F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    merged = (
        flagged.withColumn("_island", island)
        .groupBy("resume_id", "_island")
        .agg(
            F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"),
            F.sum("n_roles").alias("n_roles"), F.min("_until").alias("_until"),
        )
    )
    return merged.select(
        "resume_id", "start_date", "end_date", "n_roles",
        F.datediff("start_date", F.when(F.col("_until") < F.col("start_date"), F.col("_until"))).alias("gap_days"),
    )


def years_of_experience(experience: DataFrame, as_of: str) -> DataFrame:
    """(resume_id, months, years): overlapping roles count once."""
    months = F.sum(whole_months(F.col("start_date"), F.col("end_date"))).cast("bigint")
    return (
        merge_employment(experience, as_of).groupBy("resume_id").agg(months.alias("months"))
        .withColumn("years", F.round(F.col("months") / 12, 2))
    )


def employment_gaps(experience: DataFrame, as_of: str, min_days: int = 1) -> DataFrame:
    """Stretches without work between merged employments."""
    return merge_employment(experience, as_of).filter(F.col("gap_days") >= min_days).select(
        "resume_id", F.date_sub("start_date", F.col("gap_days")).alias("gap_start"),
        F.col("start_date").alias("gap_end"), "gap_days",
    )


def salary_comparables(market: DataFrame, keys: list[str]) -> DataFrame:
    """p25, p75 and count of the salaries per group, exact."""
    return exact_quantiles(market, keys, "salary", {"p25": 0.25, "p75": 0.75})


_LEVELS = (("level", "industry", "country"), ("level", "industry"), ("level",), ())


def _group_name(columns: tuple[str, ...]) -> Column:
    """One text key for a group at any level, so that all levels share one shuffle."""
    parts = [F.concat(F.lit(f"{c}="), F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[/=]", "_")) for c in columns]
    return F.concat_ws("/", F.lit(str(len(columns))), *parts)


def estimate_salary(resumes: DataFrame, market: DataFrame, min_rows: int = rules.COMPARABLES_MIN_ROWS) -> DataFrame:
    """p25..p75 of comparable careers per résumé, from the narrowest group with enough rows.

    Levels: (level, industry, country) → (level, industry) → (level) → all.
    Market rows are counted per group and salary before any shuffle. The choice of
    level is made once per distinct combination and then joined to the résumés.
    """
    counted = market.groupBy("level", "industry", "country", "salary").agg(F.count("*").alias("_n"))
    levels = F.array(*[F.struct(F.lit(i).alias("depth"), _group_name(c).alias("group")) for i, c in enumerate(_LEVELS)])
    spread = counted.select("salary", "_n", F.explode(levels).alias("l")).select("salary", "_n", F.col("l.group").alias("group"))
    stats = exact_quantiles(spread, ["group"], "salary", {"p25": 0.25, "p75": 0.75}, weight="_n")
    combos = resumes.select("level", "industry", "country").distinct()
    best = (
        combos.withColumn("l", F.explode(levels))
        .select("level", "industry", "country", "l.depth", "l.group")
        .join(stats.filter(F.col("n_rows") >= min_rows), "group", "inner")
        .groupBy("level", "industry", "country")
        .agg(F.min_by(F.struct("depth", "p25", "p75", "n_rows"), "depth").alias("best"))
        .select(F.col("level").alias("_l"), F.col("industry").alias("_i"), F.col("country").alias("_c"), "best")
    )
    same = (
        F.col("level").eqNullSafe(F.col("_l")) & F.col("industry").eqNullSafe(F.col("_i"))
        & F.col("country").eqNullSafe(F.col("_c"))
    )
    return (
        resumes.select("resume_id", "level", "industry", "country").join(best, same, "left")
        .select(
            "resume_id",
            F.round("best.p25", 0).cast("int").alias("min"), F.round("best.p75", 0).cast("int").alias("max"),
            currency_of(F.col("country")).alias("currency"),
            F.coalesce("best.depth", F.lit(-1)).alias("fallback_level"),
            F.coalesce("best.n_rows", F.lit(0)).alias("comparables"),
            F.concat(F.lit("Based on "), F.coalesce("best.n_rows", F.lit(0)).cast("string"), F.lit(" comparable careers.")).alias("comments"),
        )
    )


ID_BLOCK = 100_000_000


def next_role(experience: DataFrame) -> DataFrame:
    """Add ``next_title``: the title of the following role of the same person.

    A slice is a start date, and with numeric ids a block of ids, so that it
    stays bounded when very many roles start on one day. The blocks are wide:
    a person with roles on many days should not get too many slices either.
    """
    numeric = isinstance(experience.schema["exp_id"].dataType, T.IntegralType)
    day = F.col("start_date")
    slice_ = F.struct(day, F.floor(F.col("exp_id") / ID_BLOCK).alias("block")) if numeric else day
    return next_in_order(experience, ["resume_id"], slice_, ["start_date", "exp_id"], ["title"])


def role_transitions(experience: DataFrame) -> DataFrame:
    """(title, next_title, n): how often one title follows another."""
    return (
        next_role(experience).filter(F.col("next_title").isNotNull())
        .groupBy("title", "next_title").agg(F.count("*").alias("n"))
    )


def current_role(experience: DataFrame) -> DataFrame:
    """(resume_id, title) of the latest role."""
    return experience.groupBy("resume_id").agg(F.max_by("title", F.struct("start_date", "exp_id")).alias("title"))


def common_role_skills(resume_skills: DataFrame, roles: DataFrame) -> DataFrame:
    """(title, ranked): all skills held by holders of a role, most common first.

    ``roles`` is (resume_id, title). Holders are counted per skill before the
    shuffle; a list has at most as many entries as there are skills.
    """
    counts = (
        resume_skills.select("resume_id", "skill").distinct().join(roles.distinct(), "resume_id", "inner")
        .groupBy("title", "skill").agg(F.count("*").alias("n"))
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "skill")))
    return counts.groupBy("title").agg(F.transform(ranked, lambda r: r["skill"]).alias("ranked"))


def missing_skills(resume_skills: DataFrame, roles: DataFrame, next_roles: DataFrame, k: int = rules.IMPROVEMENT_AREAS) -> DataFrame:
    """(resume_id, title, areas): the first ``k`` skills of a wanted role, most common first, that the person lacks.

    ``roles``: who holds which title; ``next_roles``: (resume_id, title) wanted.
    The first ``k`` lacking ones are among the first ``k`` + own skills of the
    ranked list, so the anti join inside the row looks at no more.
    """
    own = resume_skills.groupBy("resume_id").agg(F.collect_set("skill").alias("_own"))
    held = F.coalesce("_own", F.array().cast("array<string>"))
    return (
        next_roles.join(common_role_skills(resume_skills, roles), "title", "inner").join(own, "resume_id", "left")
        .select(
            "resume_id", "title",
            F.slice(F.array_except(F.slice("ranked", F.lit(1), F.size(held) + k), held), 1, k).alias("areas"),
        )
    )


def suggest_career(experience: DataFrame, resume_skills: DataFrame, roles: int = rules.NEXT_ROLES,
                   areas: int = rules.IMPROVEMENT_AREAS) -> DataFrame:
    """(resume_id, title, next_roles, improvement_areas): usual next titles and the skills lacking for the first of them."""
    current = current_role(experience)
    rank = F.row_number().over(Window.partitionBy("title").orderBy(F.desc("n"), F.asc("next_title")))
    usual = (
        role_transitions(experience).filter(F.col("title") != F.col("next_title"))
        .withColumn("rank", rank).filter(F.col("rank") <= roles)
        .groupBy("title").agg(F.array_sort(F.collect_list(F.struct("rank", "next_title"))).alias("_ranked"))
        .select("title", F.transform("_ranked", lambda r: r["next_title"]).alias("next_roles"))
    )
    path = current.join(usual, "title", "left")
    wanted = path.filter(F.size("next_roles") > 0).select("resume_id", F.get("next_roles", F.lit(0)).alias("title"))
    lacking = missing_skills(resume_skills, current, wanted, areas).select("resume_id", F.col("areas").alias("improvement_areas"))
    none = F.array().cast("array<string>")
    return path.join(lacking, "resume_id", "left").select(
        "resume_id", "title", F.coalesce("next_roles", none).alias("next_roles"),
        F.coalesce("improvement_areas", none).alias("improvement_areas"),
    )
