"""Column → Column functions on dates and time frames."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, functions as F

from talentloom import rules
from talentloom.functions.values import let


def parse_ts(text: Column, as_of: str) -> Column:
    """ISO time stamp (``Z`` and offsets accepted); a bad string gives ``as_of``."""
    return F.coalesce(F.try_to_timestamp(text), F.lit(as_of).cast("timestamp"))


def parse_loose_date(text: Column, as_of: str) -> Column:
    """``2021-03-01``, ``March 2021``, ``Mar 2021``, ``03/2021``, ``2021``, ``Present`` → date; else null.

    The shape of the text picks the one format to try.
    """
    def read(t: Column) -> Column:
        def as_date(fmt: str) -> Column:
            return F.try_to_timestamp(t, F.lit(fmt)).cast("date")

        return (
            F.when(t.rlike(r"^\d{4}$"), as_date("yyyy"))
            .when(F.lower(t).isin("present", "current", "now"), F.lit(as_of).cast("date"))
            .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), as_date("yyyy-MM-dd"))
            .when(t.rlike(r"^\d{4}-\d{2}$"), as_date("yyyy-MM"))
            .when(t.rlike(r"^[A-Za-z]{3} \d{4}$"), as_date("MMM yyyy"))
            .when(t.rlike(r"^[A-Za-z]{4,} \d{4}$"), as_date("MMMM yyyy"))
            .when(t.rlike(r"^\d{2}/\d{4}$"), as_date("MM/yyyy"))
        )

    return let(F.trim(text), read)


def whole_months(start: Column, end: Column) -> Column:
    """Full calendar months between two dates, by year and month only."""
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def duration_text(start: Column, end: Column) -> Column:
    """``4 years 6 months``; null when a bound is missing or the order is wrong."""
    def unit(n: Column, name: str) -> Column:
        return F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(name)).otherwise(F.lit(name + "s"))))

    def words(months: Column) -> Column:
        years, rest = F.floor(months / 12).cast("int"), (months % 12).cast("int")
        text = F.concat_ws(" ", unit(years, "year"), unit(rest, "month"))
        return F.when(months == 0, F.lit("0 months")).when(months > 0, text)

    return let(let(F.struct(start.alias("s"), end.alias("e")), lambda v: whole_months(v["s"], v["e"])), words)


def timeframe_bounds(timeframe: str, as_of: str) -> tuple[str | None, str | None, str]:
    """(start of previous window, start of current window, end) as ISO dates.

    Windows are half open, ``(start, end]``. ``all`` has neither start. The
    bounds are literals, so they reach the Parquet scan as pushed filters.
    """
    if timeframe not in rules.TIMEFRAMES:
        raise ValueError(f"timeframe must be one of {sorted(rules.TIMEFRAMES)}")
    days = rules.TIMEFRAMES[timeframe]
    if days is None:
        return None, None, as_of
    end = date.fromisoformat(as_of)
    return (end - timedelta(days=2 * days)).isoformat(), (end - timedelta(days=days)).isoformat(), as_of


def in_window(day: Column, after: str | None, until: str) -> Column:
    cond = day <= F.lit(until).cast("date")
    return cond if after is None else cond & (day > F.lit(after).cast("date"))
