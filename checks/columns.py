"""Integer columns that can be null, by query.

Both sides give them as double: data frames of the two engines hold a nullable
integer in different types, but a nullable double in the same one.
"""

_YEARS = ("years_of_experience",)

NULLABLE_INTEGERS = {
    "score_wide": ("candidate_id",),
    "jd_lookup": ("jd_chars",),
    "candidate_lookup": ("candidate_id",),
    "resolve_candidate": ("candidate_id",),
    "extract_yoe": _YEARS,
    "candidate_details": _YEARS,
    "fill_missing": _YEARS,
    "model_hook": _YEARS,
    "candidate_upsert": ("candidate_year",),
    "recommend_candidates": ("candidate_year",),
    "stream_ingest": ("candidate_year",),
    "score_upsert": ("candidate_id",),
    "score_merge": ("candidate_id",),
    "recommend": ("candidate_id",),
    "stream_recommend": ("candidate_id",),
    "category_columns": ("category1_id", "category2_id"),
}
