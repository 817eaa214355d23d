"""Prompt text columns for models called outside this package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys a response must have. The wording around them is free.
FIELD_HINTS = (
    ("name", "full name"),
    ("email", "e-mail address"),
    ("phone", "telephone number"),
    ("linkedin_url", "LinkedIn profile address"),
    ("current_location", "city and state"),
    ("years_of_experience", "whole number of years"),
    ("education_level", "highest degree"),
    ("last_position_title", "latest job title"),
    ("skills", "list of at most 10 skills"),
)
MISSING_INTRO = "Read the resume and answer with one JSON object holding exactly these keys: "
MISSING_RULE = "Use null for an unknown value and [] for unknown skills."
ANALYSIS_INTRO = "Pick the one best category for the job description from: "
ANALYSIS_RULE = 'Answer with one JSON object with the keys "category", "qualifications" and "requirements".'
SCORE_INTRO = "Rate from 0 (none) to 10 (full) how well the resume fits each part of the job."
SCORE_RULE = (
    'Answer with one JSON object with the numbers "category_score", "requirements_score", '
    '"qualifications_score" and "final_score", and a short "reason".'
)


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def missing_fields_prompt(missing: Column, text: Column) -> Column:
    """Asks for the ``missing`` fields; null when there are none."""
    hints = F.concat_ws("; ", *[
        F.when(F.array_contains(missing, key), F.lit(f"{key}: {hint}")) for key, hint in FIELD_HINTS
    ])
    asked = F.concat(F.lit(MISSING_INTRO), F.to_json(missing))
    return F.when(F.size(missing) > 0, _lines(asked, hints, MISSING_RULE, "Resume:", text))


def analysis_prompt(category_options: Column, jd_text: Column) -> Column:
    return _lines(F.concat(F.lit(ANALYSIS_INTRO), category_options), ANALYSIS_RULE, "Job description:", jd_text)


def score_prompt(category: Column, requirements: Column, qualifications: Column, resume_text: Column) -> Column:
    return _lines(
        SCORE_INTRO, "Category:", category, "Requirements:", requirements,
        "Qualifications:", qualifications, "Resume:", resume_text, SCORE_RULE,
    )
