"""Market analytics over dated skills and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talentloom import rules
from talentloom.functions.dates import in_window, timeframe_bounds
from talentloom.operators.ordered import exact_quantiles, value_positions


def market_total(df: DataFrame, timeframe: str, as_of: str, industry: str | None = None, location: str | None = None) -> DataFrame:
    """totalResumes in the window, for one industry and country when given."""
    _, after, until = timeframe_bounds(timeframe, as_of)
    rows = df.filter(in_window(F.col("seen_on"), after, until))
    if industry is not None:
        rows = rows.filter(F.lower("industry") == industry.lower())
    if location is not None:
        rows = rows.filter(F.lower("country") == location.lower())
    return rows.agg(F.count_distinct("resume_id").alias("total_resumes"))


def holders(skill_dates: DataFrame, timeframe: str, as_of: str) -> DataFrame:
    """(skill, current, previous): distinct résumés per skill in the window and in the equal one before.

    One row per (skill, résumé) is made first with two flags, then counted: two
    distinct counts in one pass, and a skill everybody has is spread over all
    tasks until only its partial sums are left.
    """
    before, after, until = timeframe_bounds(timeframe, as_of)
    day = F.col("seen_on")
    rows = skill_dates.filter(in_window(day, before, until))
    now = in_window(day, after, until)
    flags = rows.groupBy("skill", "resume_id").agg(
        F.max(now.cast("int")).alias("_now"), F.max((~now).cast("int")).alias("_before")
    )
    return flags.groupBy("skill").agg(F.sum("_now").alias("current"), F.sum("_before").alias("previous"))


def top_n(df: DataFrame, key: str, n: int, by: str = "n") -> DataFrame:
    """The ``n`` rows with the highest count, by name on a tie."""
    return df.orderBy(F.desc(by), F.asc(key)).limit(n)


def skill_counts(skill_dates: DataFrame, timeframe: str, as_of: str, exact: bool = True) -> DataFrame:
    """(skill, n): distinct résumés per skill in the window; the sketch variant saves the shuffle of pairs."""
    _, after, until = timeframe_bounds(timeframe, as_of)
    rows = skill_dates.filter(in_window(F.col("seen_on"), after, until))
    count = F.count_distinct("resume_id") if exact else F.approx_count_distinct("resume_id")
    return rows.groupBy("skill").agg(count.alias("n"))


def top_skills(skill_dates: DataFrame, timeframe: str, as_of: str, n: int = 10, exact: bool = True) -> DataFrame:
    """The skills that most résumés name in the window."""
    return top_n(skill_counts(skill_dates, timeframe, as_of, exact), "skill", n)


#: Logarithm of the registers of a distinct-count sketch, and the relative standard error of its counts.
SKETCH_BITS, SKETCH_ERROR = 12, 0.0163


def skill_sketches(skill_dates: DataFrame) -> DataFrame:
    """(skill, seen_on, sketch): one distinct-count sketch of the résumés per skill and day.

    Days are united for any window afterwards, so the pairs are read once and stored; a sketch of few résumés takes some bytes, one of many
    at most 4 KB. Null skills and days go, null résumés are not counted.
    """
    rows = skill_dates.where("skill is not null and seen_on is not null")
    return rows.groupBy("skill", "seen_on").agg(F.hll_sketch_agg(F.col("resume_id").cast("string"), SKETCH_BITS).alias("sketch"))


def sketched_holders(sketches: DataFrame, timeframe: str, as_of: str) -> DataFrame:
    """(skill, current, previous) like ``holders``, from stored sketches: days of a window are united, not added, so a résumé counts once.

    Counts are estimates of relative error ``SKETCH_ERROR``.
    """
    before, after, until = timeframe_bounds(timeframe, as_of)
    rows = sketches.filter(in_window(F.col("seen_on"), before, until))
    now = in_window(F.col("seen_on"), after, until)

    def count(here: Column) -> Column:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.when(here, F.col("sketch")))), F.lit(0).cast("bigint"))

    return rows.groupBy("skill").agg(count(now).alias("current"), count(~now).alias("previous"))


def sketched_top_skills(sketches: DataFrame, timeframe: str, as_of: str, n: int = 10) -> DataFrame:
    """(skill, n): the skills that most résumés name in the window, from stored sketches."""
    counts = sketched_holders(sketches, timeframe, as_of).where("current > 0")
    return top_n(counts.select("skill", F.col("current").alias("n")), "skill", n)


def growth_label(rate: Column, band: float, up: str, down: str) -> Column:
    return F.when(rate >= band, up).when(rate <= -band, down).otherwise("stable")


def skill_trend(skill_dates: DataFrame, timeframe: str, as_of: str) -> DataFrame:
    """(skill, current, previous, growth_rate, trend) against the equal window before.

    A skill without a past is growing and has no rate; without a previous window
    (timeframe ``all``) every skill is stable.
    """
    return _trend(holders(skill_dates, timeframe, as_of), timeframe)


def sketched_skill_trend(sketches: DataFrame, timeframe: str, as_of: str) -> DataFrame:
    """``skill_trend`` from stored sketches."""
    return _trend(sketched_holders(sketches, timeframe, as_of), timeframe)


def skill_report(trend: DataFrame, n: int = 10) -> DataFrame:
    """(rank, skill, count, trend, growth_rate): the ``n`` most named skills of a window in one result, from either kind of trend."""
    top = top_n(trend.where("current > 0"), "skill", n, by="current")
    rank = F.row_number().over(Window.orderBy(F.desc("current"), F.asc("skill")))  # over n rows
    return top.select(rank.alias("rank"), "skill", F.col("current").alias("count"), "trend", "growth_rate")


def _trend(counts: DataFrame, timeframe: str) -> DataFrame:
    rate = F.when(F.col("previous") > 0, F.round((F.col("current") - F.col("previous")) / F.col("previous"), 4))
    label = growth_label(F.col("growth_rate"), rules.SKILL_TREND_BAND, "growing", "declining")
    if rules.TIMEFRAMES[timeframe] is None:
        return counts.withColumn("growth_rate", F.lit(None).cast("double")).withColumn("trend", F.lit("stable"))
    new = (F.col("previous") == 0) & (F.col("current") > 0)
    return counts.withColumn("growth_rate", rate).withColumn("trend", F.when(new, "growing").otherwise(label))


def emerging_skills(skill_dates: DataFrame, timeframe: str, as_of: str, k: int = 10) -> DataFrame:
    """Growing skills of the current window which were not among the previous top ``k``."""
    trend = skill_trend(skill_dates, timeframe, as_of)
    known = top_n(trend.filter(F.col("previous") > 0), "skill", k, by="previous").select("skill")
    growing = trend.filter((F.col("current") > 0) & (F.col("trend") == "growing"))
    return growing.join(known, "skill", "left_anti").select("skill", "current", "previous")


def skill_series(skill_dates: DataFrame, period: str = "month") -> DataFrame:
    """(skill, period, n): distinct résumés per skill and calendar period."""
    when = F.trunc("seen_on", period).alias("period")
    pairs = skill_dates.groupBy("skill", when, "resume_id").agg(F.count("*").alias("_n"))
    return pairs.groupBy("skill", "period").agg(F.count("*").alias("n"))


def series_growth(series: DataFrame) -> DataFrame:
    """Add ``previous`` and ``growth_rate`` to a series; one row per skill and period reaches the window."""
    before = F.lag("n").over(Window.partitionBy("skill").orderBy("period"))
    return series.withColumn("previous", before).withColumn(
        "growth_rate", F.round((F.col("n") - F.col("previous")) / F.col("previous"), 4)
    )


def smooth_counts(series: DataFrame, n: int = 3) -> DataFrame:
    """Add ``smoothed``: mean over the last ``n`` periods of a skill."""
    frame = Window.partitionBy("skill").orderBy("period").rowsBetween(1 - n, 0)
    return series.withColumn("smoothed", F.round(F.avg("n").over(frame), 4))


def _in_both_windows(experience: DataFrame, timeframe: str, as_of: str) -> DataFrame:
    before, after, until = timeframe_bounds(timeframe, as_of)
    day = F.col("start_date")
    rows = experience.filter(in_window(day, before, until))
    return rows.withColumn("_window", F.when(in_window(day, after, until), "current").otherwise("previous"))


def _salary_trend(both: DataFrame) -> DataFrame:
    change = F.round((F.col("current") - F.col("previous")) * 100 / F.col("previous"), 2)
    label = growth_label(F.col("change_percent") / 100, rules.SALARY_TREND_BAND, "increasing", "decreasing")
    return both.withColumn("change_percent", change).withColumn("trend", label)


def salary_trends(experience: DataFrame, timeframe: str, as_of: str) -> DataFrame:
    """(title, current, previous, change_percent, trend): median salary per role against the window before."""
    rows = _in_both_windows(experience, timeframe, as_of).select("title", "_window", "salary")
    medians = exact_quantiles(rows, ["title", "_window"], "salary", {"median": 0.5})
    both = medians.groupBy("title").agg(
        F.max(F.when(F.col("_window") == "current", F.col("median"))).alias("current"),
        F.max(F.when(F.col("_window") == "previous", F.col("median"))).alias("previous"),
    )
    return _salary_trend(both)


def salary_change(experience: DataFrame, timeframe: str, as_of: str) -> DataFrame:
    """(title, current, previous, change_percent, trend): mean salary per role, both windows in one pass.

    Sums are taken in whole cents, so the result does not depend on the order of rows.
    """
    cents = F.round(F.col("salary") * 100, 0).cast("bigint")

    def mean(window: str) -> Column:
        here = F.when(F.col("_window") == window, cents)
        return F.round(F.sum(here) / F.count(here) / 100, 4)

    both = _in_both_windows(experience, timeframe, as_of).groupBy("title").agg(
        mean("current").alias("current"), mean("previous").alias("previous")
    )
    return _salary_trend(both)


def industry_distribution(resumes: DataFrame) -> DataFrame:
    """(industry, n, percent): share of résumés per industry; the total is a scalar subquery."""
    counts = resumes.groupBy("industry").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.round(F.col("n") * 100 / total, 1))


def score_rank(df: DataFrame, by: str, score: str) -> DataFrame:
    """Add ``pct_rank``: percent rank of the score within ``by``.

    Same value as ``percent_rank()``, without sorting a whole group in one task:
    each distinct score gets its position from sliced counts and is joined back.
    """
    places = value_positions(df, [by], score)
    rank = F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(F.lit(0.0))
    return df.join(places.select(by, score, F.round(rank, 4).alias("pct_rank")), [by, score], "left")
