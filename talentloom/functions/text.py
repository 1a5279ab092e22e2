"""Column → Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talentloom import rules
from talentloom.functions.values import let



def strip_ws(text: Column) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.trim(text, F.lit(rules.WHITESPACE))


def strip_fence(text: Column) -> Column:
    """Drop a Markdown fence around a model answer.

    Strips white space, then the character *set* "`json" on the left and
    back-ticks on the right (a set, so a leading ``n`` or ``o`` goes too).
    """
    return F.rtrim(F.ltrim(strip_ws(text), F.lit("`json")), F.lit("`"))


def norm_skill(skill: Column) -> Column:
    """Lower case, trimmed, inner white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(skill, r"\s+", " ")))


def norm_skills(skills: Column) -> Column:
    """Normalised distinct skills of an array; null stays an empty list."""
    cleaned = F.transform(F.coalesce(skills, F.array().cast("array<string>")), norm_skill)
    return F.array_distinct(F.filter(cleaned, lambda s: s.isNotNull() & (s != "")))


def tokens(text: Column) -> Column:
    """Lower-case letter/digit runs of a text, without empty ones."""
    return F.filter(F.split(F.lower(text), rules.TOKEN_SPLIT), lambda t: t != "")


def word_frame(text: Column) -> Column:
    """Text as blank-separated words with a blank on both ends, for whole-word ``contains``."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}+#]+", " ")), F.lit(" "))


def _guarded_replace(text: Column, needles: tuple[str, ...], pattern: str) -> Column:
    """Replace by a pattern, but scan only texts which hold one of the strings every hit must contain."""
    present = text.contains(needles[0])
    for needle in needles[1:]:
        present = present | text.contains(needle)
    return F.when(present, F.regexp_replace(text, pattern, rules.REDACTED)).otherwise(text)


def redact_text(text: Column) -> Column:
    """Replace e-mail addresses, profile links and phone numbers."""
    no_mail = let(text, lambda t: _guarded_replace(t, ("@",), rules.EMAIL_PATTERN))
    no_links = let(no_mail, lambda t: _guarded_replace(t, ("linkedin.com", "github.com"), rules.PROFILE_PATTERN))
    return F.regexp_replace(no_links, rules.PHONE_PATTERN, rules.REDACTED)


def extract_first(text: Column, pattern: str, needle: str | None = None) -> Column:
    """First hit of a pattern, null when there is none.

    ``needle`` is a string every hit contains: texts without it are not scanned.
    """
    hit = let(F.regexp_extract(text, f"({pattern})", 1), lambda h: F.when(h != "", h))
    return hit if needle is None else F.when(text.contains(needle), hit)


def email_in(text: Column) -> Column:
    """The first address; the first hit begins where a run of its characters begins, so only those places are tried."""
    return extract_first(text, r"(?<![A-Za-z0-9._%+-])" + rules.EMAIL_PATTERN, "@")


def phone_in(text: Column) -> Column:
    return extract_first(text, rules.PHONE_PATTERN)


def linkedin_in(text: Column) -> Column:
    return extract_first(text, rules.LINKEDIN_PATTERN, "linkedin.com")


def website_in(text: Column) -> Column:
    """First web address that is not a LinkedIn profile."""
    rest = F.regexp_replace(text, rules.LINKEDIN_PATTERN, "")
    return F.when(text.contains("http"), extract_first(rest, rules.WEBSITE_PATTERN))


def first_line(text: Column) -> Column:
    """First line which is not blank, trimmed."""
    lines = F.filter(F.split(text, "\n"), lambda line: strip_ws(line) != "")
    return strip_ws(F.get(lines, F.lit(0)))


def file_suffix(name: Column) -> Column:
    """Last suffix with its dot ('' when none): ``a.tar.gz`` → ``.gz``, ``.profile`` → ''."""
    return F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]+)$", 1)


def is_uuid(value: Column) -> Column:
    return F.coalesce(value.rlike(rules.UUID_PATTERN), F.lit(False))
