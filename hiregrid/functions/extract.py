"""Candidate fields as Catalyst expressions over one text column.

Every field is one or two regular expressions over the whole text: no line
arrays, no Python, no shuffle. Patterns that could rescan a long run of
characters from each of its positions carry a look-behind on that class, and
loops over words or lines are possessive, so that time is linear in the text
and Java's matcher does not recurse once per word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hiregrid.functions.dialect import (
    BREAK,
    DIGIT,
    INLINE_SPACE,
    LINE_END,
    NOT_BREAK,
    SPACE,
    WORD,
    any_case,
    first_match,
    or_null,
    strip,
    to_int,
    whole_word,
)

# Field order, degree names in matching order, header words,
# profile address, and the limits on location lines and skill length.
FIELDS = (
    "name",
    "email",
    "phone",
    "linkedin_url",
    "current_location",
    "years_of_experience",
    "education_level",
    "last_position_title",
    "skills",
)
DEGREES = (
    r"Ph\.?D\.?",
    r"Doctorate",
    r"M\.?S\.?",
    r"MSc",
    r"MBA",
    r"B\.?S\.?",
    r"BA",
    r"BSc",
    r"M\.?A\.?",
    r"Master of Science",
    r"Master of Arts",
    r"Bachelor of Science",
    r"Bachelor of Arts",
)
EXPERIENCE_HEADERS = ("Experience", "Work History")  # "Professional Experience" contains the first
SKILLS_HEADERS = ("Skills",)
PROFILE_PATH = "linkedin.com/in/"
PROFILE = r"https?://(?:www\.)?linkedin\.com/in/[A-Za-z0-9\-_]+"
LOCATION_LINES = 10
SKILL_LENGTH_LIMIT = 40

# What counts as an address, a telephone number, a span of years and a profile link.
_ADDRESS = rf"[{WORD}.+-]"
_EMAIL = rf"(?<!{_ADDRESS}){_ADDRESS}++@[{WORD}-]+\.[{WORD}.-]+"

_SEPARATOR = rf"[-.{SPACE}]?"
_PHONE = (
    rf"(?=[+({DIGIT}])"  # all a match can begin with
    rf"(?:\+?1{_SEPARATOR})?"
    rf"(?:\(?[{DIGIT}]{{3}}\)?{_SEPARATOR})?"
    rf"[{DIGIT}]{{3}}{_SEPARATOR}[{DIGIT}]{{4}}"
)

_PROFILE_LINK = rf"""(?iu)href=["']({PROFILE})["']"""

# A word that starts with an upper-case letter or with no letter at all.
_NAME_WORD = rf"(?:\p{{Lu}}|[^\p{{L}}{SPACE}])[^{SPACE}]*+"
_WORDS_LINE = rf"[{INLINE_SPACE}]*+({_NAME_WORD}(?:[{INLINE_SPACE}]++{_NAME_WORD})++)[{INLINE_SPACE}]*+(?=[{BREAK}]|\z)"
_REST_OF_LINE = rf"[{NOT_BREAK}]*+"
# From the start, pass over the lines that do not qualify.
_NAME_LINE = rf"\A(?:(?!{_WORDS_LINE}){_REST_OF_LINE}[{BREAK}])*+{_WORDS_LINE}"
_NAME_GROUP = 2  # the first group belongs to the look-ahead

_YEARS = rf"(?iu)([{DIGIT}]{{1,2}})\+?[{SPACE}]+years? (?:of )?experience"
_EDUCATION = any_case("|".join(DEGREES), "PDMBpdmb")

_EXPERIENCE = whole_word(EXPERIENCE_HEADERS, "EWew")
# The captured line may be empty, so that the first header always settles the match.
_TITLE = rf"{_EXPERIENCE}{_REST_OF_LINE}[{SPACE}]*+([{NOT_BREAK}]*+)"

_TOP_LINES = rf"\A(?:{_REST_OF_LINE}{LINE_END}){{0,{LOCATION_LINES - 1}}}+{_REST_OF_LINE}"
_LOCATION = rf"(?<![A-Za-z])[A-Za-z]++,[{INLINE_SPACE}]*+[A-Z]{{2}}"

_BLANK_AHEAD = rf"[{INLINE_SPACE}]*+(?:[{BREAK}]|\z)"
_EXPERIENCE_AHEAD = rf"[{NOT_BREAK}]*?{_EXPERIENCE}"
_SKILLS_BLOCK = (
    rf"{whole_word(SKILLS_HEADERS, 'Ss\u017f')}{_REST_OF_LINE}"
    rf"((?:{LINE_END}(?!{_BLANK_AHEAD})(?!{_EXPERIENCE_AHEAD}){_REST_OF_LINE})*+)"
)


def email(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.lower(first_match(text, _EMAIL)))


def phone(text: Column) -> Column:
    return first_match(text, _PHONE)


def linkedin_url(text: Column) -> Column:
    """A plain address first, in exact case, else one in an href attribute in any case."""
    plain = F.when(F.contains(text, F.lit(PROFILE_PATH)), first_match(text, PROFILE))
    linked = F.when(F.contains(text, F.lit("=")), first_match(text, _PROFILE_LINK, 1))
    return F.coalesce(plain, linked)


def name(text: Column) -> Column:
    """First line of two or more words, each starting upper-case or with no letter."""
    return first_match(text, _NAME_LINE, _NAME_GROUP)


def years_of_experience(text: Column) -> Column:
    return to_int(first_match(text, _YEARS, 1))


def education_level(text: Column) -> Column:
    """Leftmost degree name; inside words too, so 'Urban' gives 'ba'."""
    return first_match(text, _EDUCATION)


def last_position_title(text: Column) -> Column:
    """The first non-blank line after the first experience header."""
    return or_null(strip(F.regexp_extract(text, _TITLE, 1)))


def current_location(text: Column) -> Column:
    return first_match(F.regexp_extract(text, _TOP_LINES, 0), _LOCATION)


def skills(text: Column) -> Column:
    """Listed skills under the first skills header, in order, without repeats."""
    block = F.regexp_extract(text, _SKILLS_BLOCK, 1)
    parts = F.transform(F.split(block, rf"[,;{BREAK}]"), strip)
    kept = F.filter(parts, lambda p: (p != "") & (F.length(p) < SKILL_LENGTH_LIMIT))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


RULES = {
    "name": name,
    "email": email,
    "phone": phone,
    "linkedin_url": linkedin_url,
    "current_location": current_location,
    "years_of_experience": years_of_experience,
    "education_level": education_level,
    "last_position_title": last_position_title,
    "skills": skills,
}


def detail_columns(text: Column) -> list[Column]:
    """All nine fields, in field order."""
    return [RULES[field](text).alias(field) for field in FIELDS]


def missing_fields() -> Column:
    """Names of the fields a details row lacks; '' counts as present."""
    lacking = [F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS if f != "skills"]
    no_skills = F.col("skills").isNull() | (F.size("skills") == 0)
    return F.array_compact(F.array(*lacking, F.when(no_skills, F.lit("skills"))))
