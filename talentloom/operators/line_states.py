"""What every line of a résumé is, read from the lines around it.

A text is a chain of lines and each line is in a state: name, contact, one of six kinds of heading, or a part of a section (role, employer, dates, bullet
… degree, school … skills … certificate). A line shows evidence for states: dates, bullets, separators, usual words of titles, firms, schools and
degrees, its place in the text. States follow each other more or less readily. The chain of states of most evidence and readiest steps is found by dynamic
programming over the lines, so a line without evidence of its own is read by its neighbours, and a text needs no rules, no usual headings, and no blank
lines for its entries to be told apart.

An Arrow function takes batches of texts. Evidence is one number of bits per line, gathered for all lines of a batch at once, one pattern after the other
(``line_bits`` is the same evidence of one line as a column expression); the chain is found for all texts of a batch one line further at a time.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, ByteType, IntegerType, StringType, StructField, StructType

from talentloom import rules
from talentloom.functions.values import let

HEADINGS = ("head_summary", "head_work", "head_school", "head_skill", "head_cert", "head_other")
BODIES = {
    "summary": ("summary",),
    "work": ("role", "employer", "work_dates", "bullet", "more", "duty"),
    "school": ("degree", "school", "school_dates", "school_note"),
    "skill": ("skills",),
    "cert": ("cert", "cert_note"),
    "other": ("other",),
}
STATES = ("name", "contact", *HEADINGS, *[s for body in BODIES.values() for s in body])
NUMBER = {s: k for k, s in enumerate(STATES)}
#: States that begin an entry; the second of a kind within one head begins another.
HEADS = ("role", "employer", "work_dates", "degree", "school", "school_dates", "cert")
#: State numbers of lines that take no part: blank ones and rules.
ASIDE = -1

# ---- evidence of a line -----------------------------------------------------------------------------------------------------------------------------
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Za-z]{0,6}|Spring|Summer|Autumn|Fall|Winter"
DATE = rf"(?:(?:19|20)\d\d-(?:0[1-9]|1[0-2])(?:-\d\d)?(?!\d)|(?:(?:{_MONTH})\.?,? |\d{{1,2}}/)?(?:19|20)\d\d)"
LATER = rf"(?:{DATE}|[Pp]resent|PRESENT|[Cc]urrent|[Nn]ow|[Tt]oday|[Oo]ngoing)"
SPAN = rf"\(?\s*({DATE})\s*(?:[-–—]+|\bto\b|\buntil\b)\s*({LATER})\s*\)?"
RULE = r"^(?:-{3,}|={3,}|_{3,})$"
BULLET = r"^[-•*–‣▪·]\s+"
ONLY_DATES = rf"^{SPAN}$|^\(?\s*{DATE}\s*\)?$|^\([^()]*[–-][^()]*\)$"
SEPARATOR = r"\s*[|•·]\s*|\s+[–—-]+\s+|\t+|\s{3,}"


def _heading(kind: str) -> str:
    return rf"(?i)^(?:{'|'.join(rules.HEADINGS[kind])})\s*:?$"


#: Evidence by pattern; case counts except in headings.
PATTERNS = {
    "bullet": BULLET,
    **{f"is_{h}": _heading(h.removeprefix("head_")) for h in HEADINGS},
    "caps": r"^[A-Z][A-Z&/]+(?: [A-Z&/]+){0,3}\s*:?$",
    "place": r",\s*\p{Lu}[\p{L} .'-]*(?:\s[A-Z0-9-]*\d[A-Z0-9 -]*)?$",
    "list": r"^(?!.*[.!?]$)[^,;|•:]{1,40}(?:[,;|•]\s*[^,;|•:]{1,40}){2,}$",
    "label": r"^(?:[-•*–‣▪·]\s+)?[^:]{2,40}:\s*\S",
    "parts": rf"\S(?:{SEPARATOR}|\s(?:at|@)\s)\S",
    "lower": r"^\p{Ll}",
}
#: Evidence by usual words, in lower case, without points and apostrophes.
WORDS = {"title_word": rules.TITLE_WORDS, "firm_word": rules.FIRM_WORDS, "degree_word": rules.DEGREE_MARKS, "school_word": rules.SCHOOL_WORDS,
         "cert_word": rules.CERTIFICATE_WORDS, "issued": rules.ISSUE_WORDS, "note": rules.NOTE_WORDS}
_OTHERS = ("span", "only_dates", "year", "contact", "sentence", "short")
_BITS = {name: k for k, name in enumerate(("blank", "rule", *PATTERNS, *WORDS, *_OTHERS))}
#: Evidence by place, worked out beside the bits: any line at all, first line, one of the first five, behind a blank line, between rules, not between rules where others are.
_PLACES = ("any", "first", "top", "gap", "ruled", "unruled")
_FEATURES = (*list(_BITS)[2:], *_PLACES)

#: How much each evidence speaks for a state.
EVIDENCE = {
    "name": "first 7 top 1 short 1 contact -5 bullet -6 sentence -4 span -4 only_dates -6 list -3 label -2 ruled -8",
    "contact": "contact 6 top 2 place 1.5 first -2 bullet -4 sentence -4 title_word -2 span -4 degree_word -3 school_word -2 firm_word -1 list -1",
    "summary": "sentence 3 bullet -2 short -2 span -2 contact -2 only_dates -5 list -1.5 label -1.5 lower 1",
    "role": "title_word 4 short 1 span 1.5 parts 1.5 gap 1.5 bullet -5 sentence -4 only_dates -7 degree_word -3 school_word -2 contact -4 label -3 lower -3 first -1 cert_word -1",
    "employer": "firm_word 4 place 2 short 0.5 span 0.8 title_word -4 bullet -5 sentence -4 only_dates -7 degree_word -3 school_word -1 contact -4 label -3 lower -3 issued -3",
    "work_dates": "only_dates 8 span 1 gap -1 bullet -5 sentence -4 title_word -3 firm_word -2 list -2 short -2",
    "bullet": "any -4 bullet 8 sentence 1 label -0.5 only_dates -6 gap -1",
    "more": "lower 3 gap -5 bullet -8 span -3 only_dates -8 label -1 title_word -1 contact -3",
    "duty": "sentence 3 bullet -4 only_dates -6 span -2 short -1.5 title_word -0.5 contact -2",
    "degree": "any -0.5 list -1.5 degree_word 5 gap 1 short 0.5 year 0.5 parts 0.5 bullet -3 sentence -3 only_dates -7 firm_word -1 contact -4 label -2 school_word 0.5",
    "school": "school_word 4 place 1 short 0.5 bullet -3 sentence -3 only_dates -7 degree_word -1.5 title_word -1 contact -4 label -2",
    "school_dates": "only_dates 7 gap -1 bullet -5 sentence -4 short -2",
    "school_note": "note 3 bullet 2.5 label 0.5 sentence 0.5 gap -1 only_dates -6 degree_word -1",
    "skills": "list 4 label 2 bullet 1 short 1 sentence -3 span -4 only_dates -6 contact -3 title_word -0.5 year -2",
    "cert": "any -1 cert_word 4 gap 2.5 short 0.5 year 1.5 list -3 label -2 sentence -2 only_dates -6 issued -1.5 contact -3",
    "cert_note": "issued 5 only_dates 3 gap -2.5 short 0.5 sentence -1 cert_word -1.5",
    "other": "sentence 0.5",
    **{h: f"any -4 is_{h} 12 caps 0.5 short 0.5 gap 1 ruled 10 unruled -9 bullet -6 sentence -5 list -3 only_dates -8 span -6 contact -6 first -3 year -4 place -4 title_word -2 parts -2 lower -2 "
       + " ".join(f"is_{o} -6" for o in HEADINGS if o != h) for h in HEADINGS},
}
EVIDENCE["head_other"] += " ruled -1 caps 1.5 firm_word -2 school_word -2"
for _head in HEADINGS[:-1]:
    EVIDENCE[_head] += " ruled 0.5"

#: Cost of a step inside a section; a step that is not named costs OTHER_STEP.
STEPS = {
    "role": "employer 0 work_dates 0 bullet 1 duty 1.5 role 2.5",
    "employer": "role 0.5 work_dates 0 bullet 0.5 duty 1 employer 3.5",
    "work_dates": "role 1 employer 1 bullet 0 duty 0.3",
    "bullet": "bullet 0 more 0.5 duty 1 role 0.5 employer 1 work_dates 2.5",
    "more": "more 0 bullet 0 duty 1 role 0.5 employer 1 work_dates 2.5",
    "duty": "duty 0.2 bullet 0 role 1 employer 1.8 work_dates 2.5 more 1",
    "degree": "school 0 school_dates 0.3 school_note 1 degree 1",
    "school": "degree 0.5 school_dates 0 school_note 0.5 school 3",
    "school_dates": "school_note 0.2 degree 0.3 school 0.7",
    "school_note": "school_note 0.2 degree 0.5 school 1 school_dates 2",
    "cert": "cert_note 0 cert 0.3",
    "cert_note": "cert_note 0.5 cert 0.3",
    "summary": "summary 0", "skills": "skills 0", "other": "other 0",
}
FIRST_OF = {"summary": "summary 0", "work": "role 0 employer 1 work_dates 2 bullet 3.5 duty 3", "school": "degree 0 school 0.7 school_dates 1.5", "skill": "skills 0",
            "cert": "cert 0", "other": "other 0"}
OTHER_STEP, NEVER = 4.0, 60.0
#: Cost of a step into another section without a heading: to a line that a section begins with, and to any other.
NEXT_SECTION, OTHER_SECTION = 4.0, 8.0
_FIRST = ("summary", "role", "employer", "work_dates", "degree", "school", "skills", "cert")


def _pairs(text: str) -> list[tuple[str, float]]:
    words = text.split()
    return [(a, float(b)) for a, b in zip(words[::2], words[1::2])]


def _model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(evidence by state, steps from state to state, start)."""
    weights = np.zeros((len(_FEATURES), len(STATES)), np.float32)
    for state, text in EVIDENCE.items():
        for name, value in _pairs(text):
            weights[_FEATURES.index(name), NUMBER[state]] += value
    section = {s: k for k, body in BODIES.items() for s in body}
    steps = np.full((len(STATES), len(STATES)), -OTHER_STEP, np.float32)
    for a in STATES:
        for b in STATES:
            if b == "name":
                cost = NEVER
            elif b == "contact":
                cost = {"name": 0.0, "contact": 0.5}.get(a, 7.0)
            elif b in HEADINGS:
                cost = 3.0 if a in HEADINGS else 0.5
            elif a in HEADINGS:
                cost = dict(_pairs(FIRST_OF[section[b]])).get(b, 5.0) if a == f"head_{section[b]}" else OTHER_SECTION + 4
            elif a in ("name", "contact"):
                cost = 1.5 if b == "summary" else 3.0 if b in _FIRST else OTHER_SECTION
            elif section[a] == section[b]:
                cost = dict(_pairs(STEPS[a])).get(b, OTHER_STEP)
            else:
                cost = NEXT_SECTION if b in _FIRST else OTHER_SECTION
            if b == "more" and a not in ("bullet", "more", "duty"):
                cost = NEVER
            steps[NUMBER[a], NUMBER[b]] = -cost
    start = np.full(len(STATES), -6.0, np.float32)
    start[NUMBER["name"]], start[[NUMBER[h] for h in HEADINGS]] = 0, -1
    start[NUMBER["more"]] = -NEVER
    return weights, steps, start


_WEIGHTS, _STEPS, _START = _model()
_STEPS_TO = np.ascontiguousarray(_STEPS.T)
_HEAD_BIT = np.array([1 << HEADS.index(s) if s in HEADS else 0 for s in STATES])
_SECTION_BITS = np.array([sum(1 << HEADS.index(h) for h in HEADS if any(h in body and s in body for body in BODIES.values())) for s in STATES])
_IS_HEADING = np.array([s in HEADINGS for s in STATES])


def word_list(text: Column) -> Column:
    """Words of a text in lower case, without points and apostrophes.

    What parts words becomes one blank first: a pattern of ``split`` would be compiled anew for every text.
    """
    return F.split(F.regexp_replace(F.translate(F.lower(text), ".'’", ""), r"[^\p{L}]+", " "), " ")


def has_word(text: Column, names: tuple[str, ...]) -> Column:
    return F.exists(word_list(text), lambda w: w.isin(*names))


#: Strings one of which every hit of a pattern holds: other lines are not searched by it.
NEEDLES = {
    "place": (",",), "list": (",", ";", "|", "•"), "label": (":",),
    "parts": ("|", "•", "·", "-", "–", "—", "\t", "@", "at", "   ", "\x0b", "\f", "\r", "\n"),
    "span": ("-", "–", "—", "to", "until"),
}
_ANY_HEADING = rf"(?i)^(?:{'|'.join(x for h in HEADINGS for x in rules.HEADINGS[h.removeprefix('head_')])})\s*:?$"
_ANY_WORD = tuple(dict.fromkeys(w for names in WORDS.values() for w in names))


def _holds_one(line: Column, needles: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [line.contains(x) for x in needles])


def line_bits(line: Column) -> Column:
    """The evidence of a trimmed line as one number."""
    none = F.lit(0).cast("long")

    def bit(name: str, holds: Column) -> Column:
        return F.when(holds, F.lit(1 << _BITS[name]).cast("long")).otherwise(none)

    def both(a: Column, b: Column) -> Column:
        return a.bitwiseOR(b)

    def found(name: str, pattern: str) -> Column:
        hit = line.rlike(pattern)
        return bit(name, _holds_one(line, NEEDLES[name]) & hit if name in NEEDLES else hit)

    def of_words(words: Column) -> Column:
        # one pass leaves the few words that are in any list
        shown = let(F.filter(words, lambda w: w.isin(*_ANY_WORD)), lambda held: F.when(F.size(held) > 0, functools.reduce(
            both, [bit(name, F.exists(held, lambda w: w.isin(*names))) for name, names in WORDS.items()])).otherwise(none))
        opens = bit("degree_word", F.get(words, F.lit(0)).isin(*rules.SHORT_DEGREES))
        return shown.bitwiseOR(opens)

    def of_length(n: Column) -> Column:
        ends = _holds_one(line, (".", "!", "?")) & line.rlike("[.!?]$")
        stops = line.rlike(r"\p{L}{2}[.!?]$") & ~line.rlike(r"(?:Inc|Ltd|Corp|Co|LLC|Jr|Sr)\.$")
        return bit("sentence", (n >= 12) | (ends & (((n >= 3) & stops) | (n >= 5)))).bitwiseOR(bit("short", n <= 6))

    headings = [f"is_{h}" for h in HEADINGS]
    titled = functools.reduce(both, [bit(name, line.rlike(PATTERNS[name])) for name in headings])
    dated = functools.reduce(both, [found("span", SPAN), bit("only_dates", line.rlike(ONLY_DATES)), bit("year", line.rlike(r"(?:^|\D)(?:19|20)\d\d(?:\D|$)"))])
    reach = (line.contains("@") & line.rlike(rules.EMAIL_PATTERN)) | line.contains("http") | line.contains("www.") | line.contains("linkedin.com") | line.contains("github.com") | (
        line.rlike(r"\d\d.*\d\d") & line.rlike(rules.PHONE_PATTERN))
    shown = functools.reduce(both, [
        *[found(name, pattern) for name, pattern in PATTERNS.items() if name not in headings], F.when(line.rlike(_ANY_HEADING), titled).otherwise(none),
        let(word_list(line), of_words), let(F.size(F.split(line, " ")), of_length), bit("contact", reach),
        F.when((line.contains("19") | line.contains("20") | line.startswith("(")) & line.rlike(r"(?:19|20)\d\d|^\("), dated).otherwise(none)])
    return F.when(line == "", F.lit(1).cast("long")).when(line.rlike(RULE), F.lit(2).cast("long")).otherwise(shown)


def _re2(pattern: str) -> str:
    """A pattern of Java for trimmed lines in the syntax of RE2.

    White space is of six kinds, the end of a line may be followed by one line end of Unicode, a point stands for none of these. ``(?!\\d)`` goes: where the
    evidence has it, what follows is no digit anyway, or a year alone is found as well. Case is left to the caller.
    """
    return (pattern.removeprefix("(?i)").replace(r"\s", r"[ \t\n\x0B\f\r]").replace(r"\S", r"[^ \t\n\x0B\f\r]").replace(r"(?!\d)", "").replace(".*", r"[^\x{85}\x{2028}\x{2029}]*")
            .replace("$", r"[\x{85}\x{2028}\x{2029}]?\z"))


def _words_of(names: tuple[str, ...]) -> str:
    return rf"(?:^|[^\p{{L}}])(?:{'|'.join(names)})(?:[^\p{{L}}]|\z)"


def _hits(lines: pa.Array, pattern: str, among: np.ndarray | None = None) -> np.ndarray:
    """Which lines hold a hit of an RE2 pattern; only those in ``among`` are searched."""
    if among is None:
        return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    out = np.zeros(len(lines), bool)
    places = np.flatnonzero(among)
    if len(places):
        out[places] = pc.match_substring_regex(lines.take(pa.array(places)), pattern).to_numpy(zero_copy_only=False)
    return out


def _hold(lines: pa.Array, *needles: str) -> np.ndarray:
    return _hits(lines, "|".join(re.escape(x) for x in needles))


def bits_of(lines: pa.Array) -> np.ndarray:
    """The evidence of trimmed lines, one number each: ``line_bits`` for all lines of a batch, one pattern after the other."""
    out = np.ones(len(lines), np.int64)
    solid = np.flatnonzero(pc.binary_length(lines).to_numpy(zero_copy_only=False) > 0)
    if not len(solid):
        return out
    lines = lines.take(pa.array(solid))
    ruled = _hits(lines, _re2(RULE), pc.starts_with(lines, "-").to_numpy(zero_copy_only=False) | pc.starts_with(lines, "=").to_numpy(zero_copy_only=False)
                  | pc.starts_with(lines, "_").to_numpy(zero_copy_only=False))
    out[solid[ruled]] = 2
    solid, lines = solid[~ruled], lines.filter(pa.array(~ruled))
    bits = np.zeros(len(solid), np.int64)

    def add(name: str, holds: np.ndarray) -> None:
        np.bitwise_or(bits, 1 << _BITS[name], out=bits, where=holds)

    ended = _hits(lines, _re2("[.!?]$"))
    for name, pattern in PATTERNS.items():
        if name.startswith("is_"):
            continue
        among = _hold(lines, *NEEDLES[name]) if name in NEEDLES else None
        if name == "list":
            pattern, among = pattern.replace("(?!.*[.!?]$)", ""), among & ~_hits(lines, _re2("^.*[.!?]$"), ended)
        add(name, _hits(lines, _re2(pattern), among))
    small = pc.ascii_lower(lines)
    titled = _hits(small, _re2(_ANY_HEADING))
    for heading in HEADINGS:
        add(f"is_{heading}", _hits(small, _re2(PATTERNS[f"is_{heading}"]), titled))

    # in lower case this capital is two characters, an i and a combining point, which ends the word
    low = pc.utf8_lower(pc.replace_substring(lines, "İ", "i\u0307"))
    for mark in ".'’":
        low = pc.replace_substring(low, mark, "")
    held = _hits(low, _words_of(_ANY_WORD))
    for name, names in WORDS.items():
        add(name, _hits(low, _words_of(names), held))
    add("degree_word", _hits(low, rf"^(?:{'|'.join(rules.SHORT_DEGREES)})(?:[^\p{{L}}]|\z)"))

    n = pc.count_substring(lines, " ").to_numpy(zero_copy_only=False) + 1
    stops = _hits(lines, _re2(r"\p{L}{2}[.!?]$"), ended & (n >= 3)) & ~_hits(lines, _re2(r"(?:Inc|Ltd|Corp|Co|LLC|Jr|Sr)\.$"), ended & (n >= 3))
    add("sentence", (n >= 12) | stops | (ended & (n >= 5)))
    add("short", n <= 6)
    dated = _hits(lines, r"(?:19|20)\d\d|^\(")
    add("span", _hits(lines, _re2(SPAN), dated & _hold(lines, *NEEDLES["span"])))
    add("only_dates", _hits(lines, _re2(ONLY_DATES), dated))
    add("year", _hits(lines, r"(?:^|\D)(?:19|20)\d\d(?:\D|\z)", dated))
    add("contact", _hits(lines, rules.EMAIL_PATTERN, _hold(lines, "@")) | _hold(lines, "http", "www.", "linkedin.com", "github.com")
        | _hits(lines, rules.PHONE_PATTERN, _hits(lines, _re2(r"\d\d.*\d\d"))))
    out[solid] = bits
    return out


# ---- the chain ---------------------------------------------------------------------------------------------------------------------------------------

def _shown(bits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the lines that take part, their evidence), from the bits of all lines and the mark of the first line of each text."""
    text = np.cumsum(first)
    solid = np.flatnonzero(bits & 1 == 0)  # rules included
    rule = bits[solid] & 2 > 0
    same = np.concatenate([[False], text[solid[1:]] == text[solid[:-1]]]) if len(solid) else np.zeros(0, bool)
    before = np.concatenate([[False], rule[:-1]])[: len(solid)] & same
    after = np.concatenate([rule[1:], [False]])[: len(solid)] & np.concatenate([same[1:], [False]])[: len(solid)]
    lines = solid[~rule]
    ruled = (before & after)[~rule]
    fresh = np.concatenate([[True], text[lines[1:]] != text[lines[:-1]]])[: len(lines)]
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(lines)), 0)) if len(lines) else lines
    gap = fresh | np.concatenate([[True], lines[1:] - lines[:-1] > 1])[: len(lines)]
    has_rules = np.zeros(int(text[-1]) + 1 if len(text) else 1, bool)
    has_rules[text[lines[ruled]]] = True
    places = np.stack([np.ones(len(lines), bool), fresh, np.arange(len(lines)) - start < 5, gap, ruled, has_rules[text[lines]] & ~ruled], axis=1)
    held = (bits[lines, None] >> np.arange(2, len(_BITS))[None, :]) & 1
    return lines, np.concatenate([held, places], axis=1).astype(np.float32)


def _chains(evidence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best state of each line; ``sizes`` are the lines of each text, longest text first."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(len(evidence), np.int64)
    if not len(evidence):
        return out
    steps = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts with more lines than that
    score = _START + evidence[starts[: alive[0]]]
    back = [None]
    for t in range(1, steps):
        n = alive[t]
        ways = score[:n, None, :] + _STEPS_TO
        best = ways.argmax(axis=2)
        back.append(best.astype(np.int8))
        score[:n] = np.take_along_axis(ways, best[:, :, None], 2)[:, :, 0] + evidence[starts[:n] + t]
    now = score.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        out[starts[:n] + t] = now[:n]
        if t:
            now[:n] = back[t][np.arange(n), now[:n]]
    return out


def _entries(states: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of the entry of each line: a head begins one, unless it goes on with a head that has no line of its kind yet."""
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(len(states), np.int64)
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), "left")
    seen, open_, entry = (np.zeros(len(sizes), np.int64) for _ in range(3))
    for t in range(steps):
        n = alive[t]
        state = states[starts[:n] + t]
        bit = _HEAD_BIT[state]
        begins = (bit > 0) & ((open_[:n] == 0) | (seen[:n] & bit > 0) | (seen[:n] & ~_SECTION_BITS[state] > 0))
        seen[:n] = np.where(begins, bit, seen[:n] | bit)
        open_[:n] = bit > 0
        entry[:n] += begins
        out[starts[:n] + t] = entry[:n]
    return out


#: Lines whose chains are found at once; memory is some hundred bytes a line and state, and what one step reads should stay in a core's cache.
_LINES_AT_ONCE = 10_000


def chain_of(bits: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(state, entry, heading, piece) of every line of texts of so many lines each.

    Heading and piece are places of lines in their text: of the heading that a line stands under, -1 if none, and of the line that it goes on with.
    """
    state, entry, heading = np.full(len(bits), ASIDE, np.int8), np.zeros(len(bits), np.int32), np.full(len(bits), -1, np.int32)
    piece = np.arange(len(bits), dtype=np.int32)
    first = np.zeros(len(bits), np.int64)
    base = np.cumsum(lengths) - lengths
    first[base[lengths > 0]] = 1
    lines, evidence = _shown(bits, first)
    text = (np.cumsum(first) - 1)[lines]
    owner = np.flatnonzero(lengths > 0)[text] if len(lines) else text
    sizes = np.bincount(owner, minlength=len(lengths))
    order = np.argsort(-sizes, kind="stable")
    from_ = (np.cumsum(sizes) - sizes)[order]
    at = 0
    while at < len(order) and sizes[order[at]] > 0:
        step = max(1, _LINES_AT_ONCE // int(sizes[order[at]]))
        some = slice(at, at + step)
        count = sizes[order[some]]
        count = count[count > 0]
        take = np.concatenate([np.arange(a, a + n) for a, n in zip(from_[some], count)])
        found = _chains(evidence[take] @ _WEIGHTS, count)
        state[lines[take]], entry[lines[take]] = found, _entries(found, count)
        at += step
    # the last heading and the last line that is no continuation, by running maxima that begin anew with each text
    row_start = np.repeat(base, lengths)
    places = np.arange(len(bits))
    is_head = (state >= 0) & _IS_HEADING[state]
    running = np.maximum.accumulate(np.where(is_head, 2 * places + 1, np.where(places == row_start, 2 * places, 0))) if len(bits) else places
    heading = np.where(running % 2 == 1, running // 2 - row_start, -1).astype(np.int32)
    own = (state >= 0) & (state != NUMBER["more"])
    held = np.maximum.accumulate(np.where(own | (places == row_start), places, 0)) if len(bits) else places
    piece = (np.where(state == NUMBER["more"], held, places) - row_start).astype(np.int32)
    return state, entry, heading, piece


_LINES = ArrayType(StructType([StructField("line", StringType()), StructField("state", ByteType()), *[StructField(n, IntegerType()) for n in ("entry", "heading", "piece")]]))


def _read(texts: pa.Array) -> pa.Array:
    whole = pc.replace_substring(pc.replace_substring(texts, "\r\n", "\n"), "\r", "\n")
    split = pc.split_pattern(whole, "\n")
    lengths = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pc.ascii_trim(split.flatten(), characters=rules.WHITESPACE)
    found = chain_of(bits_of(lines), lengths)
    fields = pa.StructArray.from_arrays([lines, *[pa.array(a) for a in found]], names=["line", "state", "entry", "heading", "piece"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), fields)


def read_lines(df: DataFrame, text: str = "raw_text", to: str = "lines") -> DataFrame:
    """Add an array of (line, state, entry, heading, piece), one for each line of a text, trimmed; a null text has one empty line.

    ``state`` is a number into ``STATES`` or ``ASIDE``; ``entry`` grows by one with every entry; ``heading`` is the place of the heading above, -1 if there
    is none; ``piece`` is the line's own place, or that of the bullet it goes on with.
    """
    # The draw (always below one) keeps the planner from inlining the text: an Arrow function over nested lambdas, or inside one, cannot be planned.
    whole = F.make_valid_utf8(F.coalesce(F.col(text), F.lit("")))
    given = df.withColumn("_whole", F.when(F.floor(F.rand(0)) == 0, whole))
    return given.withColumn(to, arrow_udf(_read, _LINES).asNondeterministic()(F.col("_whole"))).drop("_whole")


def in_states(line: Column, *names: str) -> Column:
    """Whether a line is in one of the states."""
    return line["state"].isin(*[NUMBER[n] for n in names])


def lines_in(lines: Column, *names: str) -> Column:
    """The texts of the lines in some states, in order."""
    return F.transform(F.filter(lines, lambda x: in_states(x, *names)), lambda x: x["line"])


def first_in(lines: Column, *names: str) -> Column:
    return F.get(lines_in(lines, *names), F.lit(0))


def entries_of(lines: Column, section: str) -> Column:
    """The entries of a section: arrays of their lines."""
    def grouped(held: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(held, lambda x: x["entry"])), lambda n: F.filter(held, lambda x: x["entry"] == n))

    return let(F.filter(lines, lambda x: in_states(x, *BODIES[section])), grouped)


def whole_bullets(lines: Column) -> Column:
    """Bullets without their mark, continued lines joined to them."""
    def joined(held: Column) -> Column:
        starts = F.filter(held, lambda x: in_states(x, "bullet", "school_note"))
        return F.transform(starts, lambda b: F.regexp_replace(
            F.array_join(F.transform(F.filter(held, lambda x: x["piece"] == b["piece"]), lambda x: x["line"]), " "), BULLET, ""))

    return let(lines, joined)
