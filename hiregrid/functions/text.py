"""Text helpers: sections, keywords, identity columns, term frequencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.functions.dialect import WORD, strip

# The section order of a résumé text and the keyword separators.
RESUME_SECTIONS = ("experience", "projects", "skills", "summary", "education", "certifications", "other")
KEYWORD_SEPARATORS = r"[,\n;|/.\-]+"


def normalize_section(col: Column, dtype: T.DataType) -> Column:
    """One string per section: list items joined by a blank, null as ''."""
    if isinstance(dtype, T.ArrayType):
        empty = F.lit("") if isinstance(dtype.elementType, T.StringType) else F.lit(0).cast(dtype.elementType)
        items = F.filter(col, lambda x: x.isNotNull() & (x != empty))
        return F.coalesce(F.array_join(items.cast("array<string>"), " "), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))


def full_resume_text(schema: T.StructType) -> Column:
    """All sections the schema has, in fixed order, joined by a blank and stripped."""
    fields = {f.name: f.dataType for f in schema.fields}
    sections = [normalize_section(F.col(s), fields[s]) if s in fields else F.lit("") for s in RESUME_SECTIONS]
    return strip(F.concat_ws(" ", *sections))


def keywords(text: Column) -> Column:
    """Lower-cased pieces between separators, repeats kept; [] for null."""
    pieces = F.transform(F.split(text, KEYWORD_SEPARATORS, -1), lambda p: F.lower(strip(p)))
    return F.coalesce(F.filter(pieces, lambda p: p != ""), F.array().cast("array<string>"))


def keyword_set(text: Column) -> Column:
    return F.array_distinct(keywords(text))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def display_name(name: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), email)


def sorted_tokens(text: Column) -> Column:
    """Lower-cased word tokens in sorted order."""
    return F.sort_array(F.array_remove(F.split(F.lower(text), rf"[^{WORD}]+", -1), ""))


def run_starts(tokens: Column) -> Column:
    """0-based positions at which a new token begins in a sorted array."""
    changed = F.transform(
        tokens, lambda token, i: F.when((i == 0) | (token != F.get(tokens, i - 1)), i)
    )
    return F.array_compact(changed)


def run_lengths(starts: Column, total: Column) -> Column:
    """Length of each run as double, given its start positions."""
    return F.transform(
        starts, lambda start, i: (F.coalesce(F.get(starts, i + 1), total) - start).cast("double")
    )
