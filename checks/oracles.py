"""For each registered query, the SQL that states its result over the same tables.

Written from the rules, not from the Spark expressions: lines are list elements
here, JSON is read member by member, top-k is a full join and sort.
"""

from __future__ import annotations

from checks import fixtures as fx
from checks.columns import NULLABLE_INTEGERS

SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"\p{L}\p{N}_"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def blank(x: str) -> str:
    return f"({strip(x)} = '')"


def match(x: str, pattern: str, group: int = 0, options: str = "") -> str:
    pattern = pattern.replace("'", "''")
    return f"nullif(regexp_extract({x}, '{pattern}', {group}, '{options}'), '')"


def has_word(x: str, words: str) -> str:
    return f"regexp_matches({x}, '(?i)(^|[^{WORD}])({words})([^{WORD}]|$)')"


def after_header(lines: str, words: str) -> str:
    """The lines below the first one holding one of the words, null without such a line."""
    at = f"list_position(list_transform({lines}, lambda l: {has_word('l', words)}), true)"
    return f"CASE WHEN coalesce({at}, 0) > 0 THEN {lines}[{at} + 1:] END"


# The field patterns and header words of the extraction rules.
_PHONE = rf"(\+?1[-.{SPACE}]?)?(\(?\p{{Nd}}{{3}}\)?[-.{SPACE}]?)?\p{{Nd}}{{3}}[-.{SPACE}]?\p{{Nd}}{{4}}"
_PROFILE = r"https?://(www\.)?linkedin\.com/in/[A-Za-z0-9\-_]+"
_DEGREES = (
    r"Ph\.?D\.?|Doctorate|M\.?S\.?|MSc|MBA|B\.?S\.?|BA|BSc|M\.?A\.?"
    r"|Master of Science|Master of Arts|Bachelor of Science|Bachelor of Arts"
)
_WORKED = "Experience|Work History"


def details_ctes(source: str) -> str:
    """CTEs ending in ``details``: the nine fields of ``source``; skills as a list."""
    nonblank = f"list_filter(list_transform(below_work, lambda l: {strip('l')}), lambda l: l <> '')[1]"
    name_line = (
        f"list_filter(list_transform(lines, lambda l: {strip('l')}), lambda l: "
        f"len(string_split_regex(l, '[{SPACE}]+')) >= 2 AND len(list_filter(string_split_regex(l, '[{SPACE}]+'), "
        r"lambda w: regexp_matches(w, '^\p{L}') AND NOT regexp_matches(w, '^\p{Lu}'))) = 0)[1]"
    )
    location = (
        "list_filter(list_transform(lines[1:10], lambda l: "
        f"regexp_extract(l, '[A-Za-z]+,[{SPACE}]*[A-Z]{{2}}', 0)), lambda m: m <> '')[1]"
    )
    stops = f"list_position(list_transform(below_skills, lambda l: {blank('l')} OR {has_word('l', _WORKED)}), true)"
    return rf"""
src AS ({source}),
lined AS (SELECT *, string_split_regex(resume_text, '{BREAK}') AS lines FROM src),
headed AS (SELECT *, {after_header('lines', _WORKED)} AS below_work, {after_header('lines', 'Skills')} AS below_skills FROM lined),
cut AS (SELECT *, CASE WHEN below_skills IS NULL THEN [] WHEN coalesce({stops}, 0) > 0
    THEN below_skills[1:{stops} - 1] ELSE below_skills END AS skill_lines FROM headed),
parts AS (SELECT *, list_filter(list_transform(flatten(list_transform(skill_lines,
    lambda l: string_split_regex(l, '[,;]'))), lambda p: {strip('p')}),
    lambda p: p <> '' AND length(p) < 40) AS all_skills FROM cut),
details AS (SELECT resume_id, folder, resume_path, resume_text,
  {name_line} AS name,
  lower({match('resume_text', rf'[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]+')}) AS email,
  {match('resume_text', _PHONE)} AS phone,
  coalesce({match('resume_text', _PROFILE)}, {match('resume_text', f'''href=["']({_PROFILE})["']''', 1, 'i')}) AS linkedin_url,
  {location} AS current_location,
  TRY_CAST({match('resume_text', rf'(\p{{Nd}}{{1,2}})\+?[{SPACE}]+years? (of )?experience', 1, 'i')} AS INT) AS years_of_experience,
  {match('resume_text', _DEGREES, 0, 'i')} AS education_level,
  {nonblank} AS last_position_title,
  list_filter(all_skills, lambda s, i: list_position(all_skills, s) = i) AS skills
FROM parts)"""


FIELDS = (
    "name email phone linkedin_url current_location years_of_experience education_level last_position_title skills"
).split()
_MISSING = "list_filter([" + ", ".join(
    f"CASE WHEN {f} IS NULL THEN '{f}' END" if f != "skills" else "CASE WHEN len(skills) = 0 THEN 'skills' END"
    for f in FIELDS
) + "], lambda f: f IS NOT NULL)"
_SKILL_TEXT = "array_to_string(skills, '|')"

_CORPUS = "WITH" + details_ctes(fx.CORPUS)
_RESUMES = "WITH" + details_ctes(fx.RESUMES)
_JOBS = f"jobs AS ({fx.JOBS})"
_RESPONSES = f"responses AS ({fx.RESPONSES})"


_JD_LOOKUP = f"""WITH {_JOBS} SELECT e.event_id, e.user_id AS jd_id, j.jd_id IS NOT NULL AS found,
        length(j.jd_text) AS jd_chars, CASE WHEN j.jd_id IS NOT NULL THEN coalesce(category_detected, '') END AS category_detected,
        CASE WHEN j.jd_id IS NOT NULL THEN coalesce(qualifications, '') END AS qualifications,
        CASE WHEN j.jd_id IS NOT NULL THEN coalesce(requirements, '') END AS requirements
        FROM events e LEFT JOIN jobs j ON e.user_id = j.jd_id"""


def keyword_list(x: str) -> str:
    pieces = f"string_split_regex(coalesce({x}, ''), '[,\\n;|/.\\-]+')"
    return f"list_filter(list_transform({pieces}, lambda p: lower({strip('p')})), lambda p: p <> '')"


# --- responses -------------------------------------------------------------


def json_members(kind: str, text: str) -> str:
    """CTEs from response text to ``members``: the last value of every key, as text."""
    return f"""
{_RESPONSES},
found AS (SELECT resume_id, response, {text} AS json FROM responses WHERE kind = '{kind}'),
typed AS (SELECT *, CASE WHEN json_valid(json) THEN json END AS valid,
  coalesce(CASE WHEN json_valid(json) THEN json_type(json) = 'OBJECT' END, false) AS is_object FROM found),
each_member AS (SELECT t.resume_id, e.key, e.id, e.type, e.value FROM (SELECT * FROM typed WHERE is_object) t, json_each(t.json) e),
members AS (SELECT resume_id, key, arg_max({{'v': CASE WHEN type = 'NULL' THEN NULL
  WHEN type = 'VARCHAR' THEN json_extract_string(value, '$') ELSE CAST(value AS VARCHAR) END}}, id).v AS v
  FROM each_member GROUP BY resume_id, key)"""


def member(key: str) -> str:
    return f"max(CASE WHEN key = '{key}' THEN v END)"


def has_member(key: str) -> str:
    return f"coalesce(bool_or(key = '{key}'), false)"


def fenced(x: str) -> str:
    body = strip(x)
    inner = "trim(substr({}, {}), '` ' || chr(10))"
    return (
        f"CASE WHEN starts_with({body}, '```json') THEN {inner.format(body, 8)} "
        f"WHEN starts_with({body}, '```') THEN {inner.format(body, 4)} ELSE {body} END"
    )


def or_object(x: str, pattern: str, default: str) -> str:
    inner = f"regexp_extract({x}, '{pattern}', 0)"
    return f"CASE WHEN json_valid({x}) THEN {x} WHEN json_valid({inner}) THEN {inner} ELSE {default} END"


_FENCED = json_members("details", fenced("response"))
_ANALYSIS = json_members("analysis", or_object(strip("response"), r"(?s)\{.*?\}", "'{}'"))
_SCORES = json_members("score", or_object("response", r"(?s)\{.*\}", "NULL"))

_ANALYSED = f"""
{_ANALYSIS},
analysed AS (SELECT t.resume_id, {has_member('category')} AS has_category, {member('category')} AS category,
  CASE WHEN {has_member('qualifications')} THEN {member('qualifications')} ELSE '' END AS qualifications,
  CASE WHEN {has_member('requirements')} THEN {member('requirements')} ELSE '' END AS requirements
  FROM typed t LEFT JOIN members m ON t.resume_id = m.resume_id GROUP BY t.resume_id)"""

_SCORE_NAMES = ("category_score", "requirements_score", "qualifications_score", "final_score")
_SCORED = f"""
{_SCORES},
raw_scores AS (SELECT t.resume_id, any_value(t.valid) AS valid, bool_or(t.is_object) AS is_object,
  {", ".join(f"{member(s)} AS raw_{s}" for s in _SCORE_NAMES)}, {member('reason')} AS reason
  FROM typed t LEFT JOIN members m ON t.resume_id = m.resume_id GROUP BY t.resume_id),
score_fields AS (SELECT resume_id, {", ".join(f"TRY_CAST(raw_{s} AS DOUBLE) AS {s}" for s in _SCORE_NAMES)}, reason,
  CASE WHEN valid IS NULL THEN 'no JSON in response' WHEN NOT is_object THEN 'response is not an object'
  WHEN {" OR ".join(f"(raw_{s} IS NOT NULL AND TRY_CAST(raw_{s} AS DOUBLE) IS NULL)" for s in _SCORE_NAMES)}
  THEN 'score is not a number' END AS error FROM raw_scores)"""

_ELEMENTS = f"""
{_RESPONSES},
elements AS (SELECT r.resume_id, json_extract_string(e.value, '$.category') AS category_name,
  CAST(json_extract(e.value, '$.score') AS DOUBLE) AS score, CAST(json_extract(e.value, '$.weight') AS DOUBLE) AS weight,
  json_extract_string(e.value, '$.justification') AS justification
  FROM (SELECT * FROM responses WHERE kind = 'category_array') r, json_each(r.response) e)"""

# --- scoring ---------------------------------------------------------------

_SCANNED = "ends_with(resume_path, '.pdf') AND NOT starts_with(regexp_extract(resume_path, '[^/]*$', 0), '.')"


def _section(kw: str) -> str:
    hits = f"len(list_filter({kw}, lambda w: list_contains(offered, w)))"
    return f"CASE WHEN len({kw}) = 0 THEN 0.0 ELSE round(CAST(10 AS DOUBLE) * {hits} / len({kw}), 2) END"


def _paired(asked: str, by: str) -> str:
    """CTEs ending in ``result``: the pairs of ``asked(jd_id, folder)``, scored and ranked within ``by``."""
    return f"""
{_JOBS},
asked AS (SELECT jd_id, folder, list_distinct({keyword_list('category_detected')}) AS kc,
  list_distinct({keyword_list('requirements')}) AS kr, list_distinct({keyword_list('qualifications')}) AS kq FROM {asked}),
offering AS (SELECT *, list_distinct({keyword_list("array_to_string(skills, chr(10))")}) AS offered FROM details WHERE {_SCANNED}),
sections AS (SELECT jd_id, folder, resume_id, resume_path, name, email, {_section('kc')} AS category_score, {_section('kr')} AS requirements_score,
  {_section('kq')} AS qualifications_score,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(kc || kr || kq, lambda w: list_contains(offered, w)))), ', '), '') AS reason
  FROM asked JOIN offering USING (folder)),
scored AS (SELECT *, round((category_score + requirements_score + qualifications_score) / 3, 2) AS final_score FROM sections),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY coalesce(final_score, 0) DESC, resume_path) AS rank FROM scored),
result AS (SELECT *, email AS candidate_email, coalesce(nullif(name, ''), email) AS candidate_name,
  regexp_extract(resume_path, '[^/]*$', 0) AS resume_filename FROM ranked)"""


_PAIRED = _paired("jobs", "jd_id")
_ACCEPTED = f"(SELECT DISTINCT jd_id, folder FROM ({fx.REQUESTS}) WHERE jd_id IS NOT NULL AND folder <> '')"
_REQUESTED = _paired(f"{_ACCEPTED} q JOIN (SELECT * EXCLUDE (folder) FROM jobs) j USING (jd_id)", "jd_id, folder")
_RESULT_COLUMNS = (
    "jd_id, rank, candidate_email, candidate_name, resume_path, resume_filename, "
    "category_score, requirements_score, qualifications_score, final_score, reason"
)

# --- upserts ---------------------------------------------------------------


def upserted_ctes(source: str, order: str = "resume_path") -> str:
    """CTEs ending in ``upserted``: the candidate table after the rows of ``source``, applied in ``order``."""
    return f"""
before AS ({fx.CANDIDATES}),
latest AS (SELECT *, min({order}) OVER (PARTITION BY email) AS seq,
  row_number() OVER (PARTITION BY email ORDER BY {order} DESC) AS n
  FROM (SELECT * FROM {source} WHERE email IS NOT NULL AND {strip('email')} <> '')),
incoming AS (SELECT * FROM latest WHERE n = 1),
created AS (SELECT i.*, (SELECT max(candidate_id) FROM before) + row_number() OVER (ORDER BY seq) AS candidate_id
  FROM incoming i WHERE email NOT IN (SELECT candidate_email FROM before)),
upserted AS (
  SELECT b.candidate_id, b.candidate_email,
    CASE WHEN i.email IS NULL THEN b.candidate_name ELSE i.name END AS candidate_name,
    CASE WHEN i.email IS NULL THEN b.candidate_phone ELSE i.phone END AS candidate_phone,
    CASE WHEN i.email IS NULL THEN b.candidate_location ELSE i.current_location END AS candidate_location,
    CASE WHEN i.email IS NULL THEN b.candidate_year ELSE i.years_of_experience END AS candidate_year,
    CASE WHEN i.email IS NULL THEN b.candidate_job ELSE i.last_position_title END AS candidate_job,
    CASE WHEN i.email IS NULL THEN b.candidate_resume ELSE i.resume_path END AS candidate_resume,
    CAST(NULL AS VARCHAR) AS candidate_company, '2020-01-01' AS created_on,
    CASE WHEN i.email IS NULL THEN '2020-01-01' ELSE '2024-06-01' END AS updated_on
  FROM before b LEFT JOIN incoming i ON b.candidate_email = i.email
  UNION ALL
  SELECT candidate_id, email, name, phone, current_location, years_of_experience, last_position_title, resume_path,
    NULL, '2024-06-01', '2024-06-01' FROM created)"""


_RECOMMENDED = f"""{_RESUMES}, {_REQUESTED},
applied AS (SELECT o.*, {{'a': r.jd_id, 'b': r.folder, 'c': r.rank}} AS place FROM ranked r JOIN offering o USING (resume_path)),
{upserted_ctes('applied', 'place')},
recommended AS (SELECT r.*, u.candidate_id FROM result r LEFT JOIN upserted u ON r.email = u.candidate_email)"""

_SCORE_TABLE = f"""scores_before AS ({fx.SCORES}),
score_batch AS (SELECT *, row_number() OVER (PARTITION BY jd_id, candidate_id ORDER BY folder DESC, rank DESC) AS n FROM recommended),
kept AS (SELECT s.* FROM scores_before s WHERE candidate_id IS NULL OR NOT EXISTS
  (SELECT 1 FROM score_batch b WHERE b.jd_id = s.jd_id AND b.candidate_id = s.candidate_id))"""
_SCORE_COLUMNS = (
    "jd_id, candidate_id, category_score, qualifications_score, requirements_score, final_score, reason"
)

# --- vectors ---------------------------------------------------------------

_CENTROIDS = """
elements AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM elements GROUP BY label, i),
norms AS (SELECT label, sqrt(sum(x * x)) AS n FROM means GROUP BY label),
centres AS (SELECT m.label, m.i, m.x / n.n AS x FROM means m JOIN norms n USING (label)),
unit AS (SELECT e.vec_id, e.i, e.x / n.n AS x FROM elements e
  JOIN (SELECT vec_id, sqrt(sum(x * x)) AS n FROM elements GROUP BY vec_id) n USING (vec_id)),
dots AS (SELECT c.label, u.vec_id, round(sum(c.x * u.x), 6) AS score FROM centres c JOIN unit u USING (i) GROUP BY c.label, u.vec_id)"""


def _terms(name: str, table: str, key: str) -> str:
    return f"""
{name}_tokens AS (SELECT {key}, unnest(string_split_regex(lower(text), '[^{WORD}]+')) AS token FROM {table}),
{name}_tf AS (SELECT {key}, token, CAST(count(*) AS DOUBLE) AS tf FROM {name}_tokens WHERE token <> '' GROUP BY {key}, token),
{name}_terms AS (SELECT {key}, token, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {key})) AS w FROM {name}_tf)"""


_INT = "CAST({} AS BIGINT)"
_MISSING_JSON = "CAST(to_json(missing) AS VARCHAR)"
_HINTS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN list_contains(missing, '{key}') THEN '{key}: {hint}' END" for key, hint in (
        ("name", "full name"), ("email", "e-mail address"), ("phone", "telephone number"),
        ("linkedin_url", "LinkedIn profile address"), ("current_location", "city and state"),
        ("years_of_experience", "whole number of years"), ("education_level", "highest degree"),
        ("last_position_title", "latest job title"), ("skills", "list of at most 10 skills"))
) + "], lambda h: h IS NOT NULL), '; ')"
_NL = " || chr(10) || "
_OPTIONS = f"(SELECT string_agg(name, ', ' ORDER BY category_id) FROM ({fx.CATEGORIES}))"
_UPLOADS = f"""uploads AS (SELECT resume_id, CASE WHEN resume_id % 29 = 28 THEN NULL ELSE resume_path END AS path,
  resume_text AS jd_text FROM ({fx.RESUMES}))"""
_GATED = f"""{_UPLOADS},
gated AS (SELECT *, CASE WHEN path IS NULL THEN 'No job description PDF provided'
  WHEN NOT ends_with(lower(path), '.pdf') THEN 'Only PDF files are accepted for job description'
  WHEN {blank('jd_text')} THEN 'Job description PDF parsing returned no text' END AS reject_reason FROM uploads)"""


def _filled(field: str) -> str:
    offered = f"CASE WHEN v_{field} NOT IN ('', '[]') THEN v_{field} END"
    if field == "skills":
        return f"""CASE WHEN len(skills) > 0 OR {offered} IS NULL THEN {_SKILL_TEXT}
          WHEN json_valid(v_skills) AND json_type(v_skills) = 'ARRAY'
          THEN array_to_string(from_json(v_skills, '["VARCHAR"]'), '|') ELSE '' END AS skills"""
    if field == "years_of_experience":
        return f"coalesce({field}, TRY_CAST({offered} AS INT)) AS {field}"
    return f"coalesce({field}, {offered}) AS {field}"


def _fill(source: str, with_members: str) -> str:
    pivot = ", ".join(f"{member(f)} AS v_{f}" for f in FIELDS)
    return f"""{source}, {with_members},
answers AS (SELECT t.resume_id, any_value(t.valid) AS valid, {pivot}
  FROM typed t LEFT JOIN members m ON t.resume_id = m.resume_id GROUP BY t.resume_id)
SELECT d.resume_id, {", ".join(_filled(f) for f in FIELDS)},
  (len({_MISSING}) > 0 AND a.resume_id IS NOT NULL AND a.valid IS NULL) AS fill_error
FROM details d LEFT JOIN answers a ON d.resume_id = a.resume_id"""




def _score_prompts(columns: str, jobs: str, folder: str) -> str:
    return f"""{_RESUMES}, {_JOBS} SELECT {columns},
        'Rate from 0 (none) to 10 (full) how well the resume fits each part of the job.'{_NL}'Category:'{_NL}coalesce(category_detected, '')
        {_NL}'Requirements:'{_NL}coalesce(requirements, ''){_NL}'Qualifications:'{_NL}coalesce(qualifications, ''){_NL}'Resume:'{_NL}
        {strip('array_to_string(skills, chr(32))')}{_NL}'Answer with one JSON object with the numbers "category_score", "requirements_score", "qualifications_score" and "final_score", and a short "reason".' AS prompt
        FROM {jobs} JOIN details d ON {folder} = d.folder WHERE {_SCANNED}"""


_SCORE_PROMPTS = _score_prompts("jd_id, resume_id", "jobs j", "j.folder")
_REQUEST_PROMPTS = _score_prompts(
    "jd_id, q.folder, resume_path", f"{_ACCEPTED} q JOIN (SELECT * EXCLUDE (folder) FROM jobs) j USING (jd_id)", "q.folder")

_HOOK_MEMBERS = f"""
found AS (SELECT resume_id, CASE WHEN length(resume_text) % 4 = 3 THEN '' ELSE '{{"current_location":"'
  || CAST(length(resume_text) AS VARCHAR) || ' chars","skills":["asked"],"name":""}}' END AS json FROM details WHERE len({_MISSING}) > 0),
typed AS (SELECT *, CASE WHEN json_valid(json) THEN json END AS valid,
  coalesce(CASE WHEN json_valid(json) THEN json_type(json) = 'OBJECT' END, false) AS is_object FROM found),
members AS (SELECT resume_id, unnest(['current_location', 'skills', 'name']) AS key,
  unnest([json_extract_string(json, '$.current_location'), CAST(json_extract(json, '$.skills') AS VARCHAR),
  json_extract_string(json, '$.name')]) AS v FROM typed WHERE is_object)"""

ORACLES: dict[str, str] = {
    # sources, sinks, file selection
    "scan_folder": f"SELECT resume_id, folder, resume_path FROM ({fx.CORPUS}) WHERE {_SCANNED}",
    "scan_recursive": f"SELECT resume_id, resume_path FROM ({fx.CORPUS}) WHERE ends_with(lower(resume_path), '.pdf')",
    "intake_gate": f"WITH {_GATED} SELECT resume_id, reject_reason FROM gated",
    "assemble_pages": "SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "load_categories": f"SELECT CAST(category_id AS INT) AS category_id, name, type FROM ({fx.CATEGORIES})",
    "jd_rows": f"""WITH {_ANALYSED}, src AS ({fx.RESUMES})
        SELECT s.resume_id, (SELECT max(item_id) FROM benchmark) + row_number() OVER (ORDER BY s.resume_id) AS jd_id, s.resume_text AS jd_text, CASE WHEN has_category THEN coalesce(category, '') ELSE '' END AS category_detected,
          qualifications, requirements FROM analysed a JOIN src s ON a.resume_id = s.resume_id""",
    "audit_rows": f"""WITH {_GATED}
        SELECT resume_id, 'INFO' AS log_type, 'JD_Analysis' AS process, 'JD upload received' AS message FROM gated
        UNION ALL SELECT resume_id, 'ERROR', 'JD_Analysis', reject_reason FROM gated WHERE reject_reason IS NOT NULL""",
    "score_wide": f"""{_RECOMMENDED} SELECT jd_id, folder, candidate_id, candidate_email, candidate_name, category_score, final_score,
        qualifications_score, requirements_score, reason, resume_filename, resume_path FROM recommended""",
    # filters and lookups
    "nonblank_docs": f"SELECT resume_id FROM ({fx.CORPUS}) WHERE NOT {blank('resume_text')}",
    "jd_lookup": _JD_LOOKUP,
    "jd_lookup_stored": _JD_LOOKUP,
    "candidate_lookup": f"""{_CORPUS}, before AS ({fx.CANDIDATES})
        SELECT resume_id, email, candidate_id FROM details LEFT JOIN before ON email = candidate_email""",
    "resolve_candidate": f"""{_RESUMES}, {upserted_ctes('details')}
        SELECT resume_id, CASE WHEN resume_id % 6 = 5 THEN b.candidate_id ELSE u.candidate_id END AS candidate_id
        FROM details d LEFT JOIN upserted u ON d.email = u.candidate_email LEFT JOIN before b ON d.email = b.candidate_email""",
    "category_options": f"SELECT string_agg(name, ', ' ORDER BY category_id) AS category_options FROM ({fx.CATEGORIES})",
    "dead_letter": f"WITH {_SCORED} SELECT resume_id, error FROM score_fields WHERE error IS NOT NULL",
    # field extraction
    **{
        f"extract_{key}": f"{_CORPUS} SELECT resume_id, {field} FROM details"
        for key, field in (
            ("email", "email"), ("phone", "phone"), ("linkedin", "linkedin_url"), ("name", "name"),
            ("yoe", "years_of_experience"), ("education", "education_level"), ("title", "last_position_title"),
            ("location", "current_location"), ("skills", f"{_SKILL_TEXT} AS skills"),
        )
    },
    "missing_fields": f"{_CORPUS} SELECT resume_id, array_to_string({_MISSING}, '|') AS missing_fields FROM details",
    "candidate_details": f"{_CORPUS} SELECT resume_id, {', '.join(FIELDS[:-1])}, {_SKILL_TEXT} AS skills FROM details",
    "fill_missing": _fill(_RESUMES, _FENCED),
    "model_hook": _fill(_CORPUS, _HOOK_MEMBERS),
    # text helpers
    "normalize_section": f"""{_RESUMES} SELECT resume_id, array_to_string(skills, ' ') AS skills_text,
        coalesce(last_position_title, '') AS title_text, coalesce(CAST(years_of_experience AS VARCHAR), '') AS years_text FROM details""",
    "full_resume_text": f"{_CORPUS} SELECT resume_id, {strip('array_to_string(skills, chr(32))')} AS full_text FROM details",
    "extract_keywords": f"""SELECT doc_id, unnest(kw) AS keyword, generate_subscripts(kw, 1) - 1 AS pos
        FROM (SELECT doc_id, {keyword_list('text')} AS kw FROM documents)""",
    "result_identity": f"""{_CORPUS} SELECT resume_id, regexp_extract(resume_path, '[^/]*$', 0) AS resume_filename,
        coalesce(nullif(name, ''), email) AS candidate_name FROM details""",
    "prompt_missing": f"""{_CORPUS}, lacking AS (SELECT *, {_MISSING} AS missing FROM details)
        SELECT resume_id, CASE WHEN len(missing) > 0 THEN 'Read the resume and answer with one JSON object holding exactly these keys: ' || {_MISSING_JSON}{_NL}{_HINTS}{_NL}
        'Use null for an unknown value and [] for unknown skills.'{_NL}'Resume:'{_NL}resume_text END AS prompt
        FROM lacking""",
    "prompt_jd": f"""SELECT doc_id, 'Pick the one best category for the job description from: ' || {_OPTIONS}{_NL}
        'Answer with one JSON object with the keys "category", "qualifications" and "requirements".'{_NL}'Job description:'{_NL}text AS prompt
        FROM documents""",
    "prompt_score": _SCORE_PROMPTS,
    # response parsing
    "parse_fenced": f"""WITH {_FENCED} SELECT t.resume_id, any_value(t.valid) IS NOT NULL AS ok, bool_or(t.is_object) AS is_object,
        {member('name')} AS name, {member('years_of_experience')} AS years FROM typed t
        LEFT JOIN members m ON t.resume_id = m.resume_id GROUP BY t.resume_id""",
    "parse_jd_response": f"""WITH {_ANALYSED} SELECT resume_id, CASE WHEN has_category THEN 1 ELSE 0 END AS n_categories,
        category, qualifications, requirements FROM analysed""",
    "parse_score_response": f"WITH {_SCORED} SELECT * FROM score_fields",
    # scoring, ranking, aggregation
    "jd_resume_pairs": f"""WITH {_JOBS} SELECT jd_id, resume_id FROM jobs j JOIN ({fx.RESUMES}) r ON j.folder = r.folder WHERE {_SCANNED}""",
    "score_keyword": f"""{_RESUMES}, {_PAIRED} SELECT jd_id, resume_id, category_score, requirements_score,
        qualifications_score, final_score, reason FROM scored""",
    "score_from_responses": f"""WITH {_JOBS}, {_SCORED} SELECT jd_id, s.resume_id, {", ".join(_SCORE_NAMES)}, reason
        FROM jobs j JOIN ({fx.RESUMES}) r ON j.folder = r.folder JOIN score_fields s ON s.resume_id = r.resume_id
        WHERE {_SCANNED} AND error IS NULL""",
    "score_model": f"""SELECT jd_id, resume_id, CASE WHEN n % 7 <> 6 THEN CAST(n % 11 AS DOUBLE) END AS final_score,
        CASE WHEN n % 7 <> 6 THEN CAST(n AS VARCHAR) END AS reason, CASE WHEN n % 7 = 6 THEN 'no JSON in response' END AS error
        FROM (SELECT jd_id, resume_id, length(prompt) AS n FROM ({_SCORE_PROMPTS}))""",
    "rank_resumes": f"""{_RESUMES}, {_PAIRED} SELECT jd_id, resume_id, final_score, rank FROM ranked""",
    "result_rows": f"{_RESUMES}, {_PAIRED} SELECT {_RESULT_COLUMNS} FROM result",
    "summary": f"""{_RESUMES}, {_PAIRED}, fit AS (SELECT *, CASE WHEN rank % 2 = 1 THEN reason END AS fit_summary FROM ranked),
        top AS (SELECT * FROM (SELECT jd_id, fit_summary, row_number() OVER (PARTITION BY jd_id ORDER BY rank) AS n
          FROM fit WHERE fit_summary IS NOT NULL) WHERE n <= 3)
        SELECT j.jd_id, (SELECT count(*) FROM fit f WHERE f.jd_id = j.jd_id) AS count,
        coalesce((SELECT string_agg(fit_summary, ' | ' ORDER BY n) FROM top t WHERE t.jd_id = j.jd_id),
          'No resumes scored for this job description.') AS summary FROM jobs j""",
    "category_score_rows": f"WITH {_ELEMENTS} SELECT resume_id, category_name, score, weight, justification FROM elements",
    "weighted_final": f"""WITH {_ELEMENTS} SELECT resume_id, round(sum(score * weight) / nullif(sum(weight), 0), 6) AS final_score
        FROM elements GROUP BY resume_id""",
    # vectors
    "l2_normalize": f"WITH {_CENTROIDS} SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(x, 6) AS x FROM unit",
    "embed_documents": """WITH counted AS (SELECT doc_id, unnest([0, 1, 2]) AS pos, unnest([length(text) - length(replace(text, 'a', '')),
          length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'o', ''))]) AS n FROM documents),
        lengths AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS norm FROM counted)
        SELECT doc_id, CAST(pos AS INT) AS pos, round(n / norm, 6) AS x FROM lengths WHERE norm > 0""",
    "resume_topk": f"""WITH {_CENTROIDS} SELECT label, vec_id, score, rank FROM (SELECT *,
        row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM dots) WHERE rank <= 5""",
    "category_topk": f"""WITH {_CENTROIDS} SELECT vec_id, label, score, rank FROM (SELECT *,
        row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM dots) WHERE rank <= 2""",
    "resume_neighbours": f"""WITH {_CENTROIDS}, whole AS (SELECT vec_id, list(x ORDER BY i) AS v FROM unit GROUP BY vec_id),
        pairs AS (SELECT q.vec_id AS asked_id, c.vec_id, round(list_dot_product(q.v, c.v), 6) AS score FROM whole q CROSS JOIN whole c)
        SELECT asked_id, vec_id, score, rank FROM (SELECT *,
          row_number() OVER (PARTITION BY asked_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10""",
    "category_columns": f"""WITH {_CENTROIDS} SELECT vec_id, max(CASE WHEN rank = 1 THEN label END) AS category1_id,
        max(CASE WHEN rank = 2 THEN label END) AS category2_id FROM (SELECT *,
        row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM dots) GROUP BY vec_id""",
    "term_vectors": f"WITH {_terms('d', 'documents', 'doc_id')} SELECT doc_id, token, round(w, 6) AS weight FROM d_terms",
    "text_topk": f"""WITH {_terms('d', 'documents', 'doc_id')}, {_terms('q', 'benchmark', 'item_id')},
        sums AS (SELECT item_id, doc_id, sum(q.w * d.w) AS s FROM q_terms q JOIN d_terms d USING (token) GROUP BY item_id, doc_id),
        scored AS (SELECT b.item_id, t.doc_id, round(coalesce(s.s, 0), 6) AS score FROM benchmark b CROSS JOIN documents t
          LEFT JOIN sums s ON s.item_id = b.item_id AND s.doc_id = t.doc_id)
        SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
          FROM scored) WHERE rank <= 5""",
    "recommend_by_similarity_filled": f"""{_RESUMES}, {_CENTROIDS} SELECT label, d.resume_path, t.score, t.rank,
        CASE WHEN d.email IS NOT NULL OR length(resume_text) % 3 = 0 THEN d.email
          ELSE 'chars' || length(resume_text) || '@example.org' END AS email,
        d.email IS NULL AND length(resume_text) % 3 = 0 AS fill_error
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM dots) t
        JOIN details d ON t.vec_id = d.resume_id WHERE t.rank <= 20""",
    "recommend_by_similarity": f"""{_RESUMES}, {_CENTROIDS} SELECT label, d.email, d.resume_path, t.score, t.rank
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM dots) t
        JOIN details d ON t.vec_id = d.resume_id WHERE t.rank <= 5""",
    # upserts and pipelines
    "candidate_upsert": f"{_CORPUS}, {upserted_ctes('details')} SELECT * FROM upserted",
    "stream_ingest": f"{_RESUMES}, {upserted_ctes('details')} SELECT * FROM upserted",
    "category_get_or_create": f"""WITH known AS ({fx.CATEGORIES}), incoming AS ({fx.INCOMING_CATEGORIES}),
        fresh AS (SELECT name, min(type) AS type FROM incoming WHERE name NOT IN (SELECT name FROM known) GROUP BY name)
        SELECT category_id, name, type FROM known UNION ALL
        SELECT (SELECT max(category_id) FROM known) + row_number() OVER (ORDER BY name), name, type FROM fresh""",
    "category_ids": f"""WITH known AS ({fx.CATEGORIES}), incoming AS ({fx.INCOMING_CATEGORIES}),
        fresh AS (SELECT DISTINCT name FROM incoming WHERE name NOT IN (SELECT name FROM known)),
        numbered AS (SELECT category_id, name FROM known UNION ALL
          SELECT (SELECT max(category_id) FROM known) + row_number() OVER (ORDER BY name), name FROM fresh)
        SELECT i.name, n.category_id FROM incoming i JOIN numbered n ON n.name = i.name""",
    "score_upsert": f"""{_RECOMMENDED}, {_SCORE_TABLE}
        SELECT {_SCORE_COLUMNS} FROM kept UNION ALL
        SELECT {_SCORE_COLUMNS} FROM score_batch WHERE n = 1 OR candidate_id IS NULL""",
    "recommend_audit": f"""WITH {_JOBS}, requests AS ({fx.REQUESTS}), accepted AS {_ACCEPTED}
        SELECT CAST(jd_id AS VARCHAR) AS jd_id, folder, 'INFO' AS log_type, 'Score_Recommendation' AS process,
          'Completed embedding recommendation for jd_id=' || CAST(jd_id AS VARCHAR) AS message
        FROM accepted WHERE jd_id IN (SELECT jd_id FROM jobs)
        UNION ALL SELECT CAST(jd_id AS VARCHAR), folder, 'ERROR', 'Score_Recommendation',
          'Job description ' || CAST(jd_id AS VARCHAR) || ' not found' FROM accepted WHERE jd_id NOT IN (SELECT jd_id FROM jobs)
        UNION ALL SELECT CAST(jd_id AS VARCHAR), folder, 'ERROR', 'Score_Recommendation',
          CASE WHEN jd_id IS NULL THEN 'Missing jd_id parameter' ELSE 'Missing resume_folder parameter' END
        FROM requests WHERE jd_id IS NULL OR folder IS NULL OR folder = ''""",
    "recommend_summary": f"""{_RESUMES}, {_REQUESTED} SELECT a.jd_id, a.folder, count(resume_path) AS count,
        'No resumes scored for this job description.' AS summary
        FROM asked a LEFT JOIN result r ON a.jd_id = r.jd_id AND a.folder = r.folder GROUP BY a.jd_id, a.folder""",
    "jd_ingest": f"""WITH {_ANALYSED}, {_GATED}
        SELECT g.resume_id, CASE WHEN has_category THEN category ELSE '' END AS categories, qualifications, requirements
        FROM gated g JOIN analysed a ON g.resume_id = a.resume_id
        WHERE reject_reason IS NULL AND NOT (has_category AND category IS NULL)""",
    "recommend": f"{_RECOMMENDED} SELECT folder, {_RESULT_COLUMNS}, candidate_id FROM recommended",
    "recommend_candidates": f"{_RECOMMENDED} SELECT * FROM upserted",
}

_FILE_TEXTS = """SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id"""
_BROKEN = "conv_id % 9 = 4"
_RUNS = "CASE WHEN bool_or({early}) OVER (PARTITION BY {content}) THEN 'first' ELSE 'second' END"

ORACLES |= {
    "model_store": f"""WITH prompts AS ({ORACLES["prompt_missing"]}), texts AS ({fx.CORPUS}),
        asked AS (SELECT p.resume_id, p.prompt, length(t.resume_text) AS n, {_RUNS.format(early="p.resume_id % 10 <> 9", content="p.prompt")} AS run
          FROM prompts p JOIN texts t ON p.resume_id = t.resume_id),
        answered AS (SELECT *, CASE WHEN prompt IS NULL THEN NULL WHEN n % 4 = 3 THEN ''
          ELSE '{{"current_location":"' || CAST(n AS VARCHAR) || ' chars","skills":["asked"],"name":""}}' END AS response FROM asked)
        SELECT resume_id, response, CASE WHEN response <> '' THEN run END AS asked_in, CASE WHEN resume_id % 10 <> 9 THEN response END AS earlier
        FROM answered""",
    "corpus_refresh": f"""WITH held AS (
          SELECT doc_id, text, true AS early FROM documents WHERE doc_id % 10 <> 9 AND doc_id % 7 <> 3
          UNION ALL SELECT NULL, text || ' aeo', true FROM documents WHERE doc_id % 10 <> 9 AND doc_id % 7 = 3
          UNION ALL SELECT doc_id, text, false FROM documents),
        made AS (SELECT DISTINCT doc_id, text, early, {_RUNS.format(early="early", content="text")} AS batch FROM held),
        counted AS (SELECT doc_id, batch, unnest([0, 1, 2, 3]) AS pos, unnest([1, length(text) - length(replace(text, 'a', '')),
          length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'o', ''))]) AS n
          FROM made WHERE NOT early AND text IS NOT NULL),
        lengths AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS norm FROM counted)
        SELECT doc_id, batch, CAST(pos AS INT) AS pos, round(n / norm, 6) AS x FROM lengths""",
    "stream_jobs": f"""WITH {_ANALYSED}, {_GATED},
        saved AS (SELECT g.resume_id, CASE WHEN has_category THEN category ELSE '' END AS category_detected, qualifications, requirements
          FROM gated g JOIN analysed a ON g.resume_id = a.resume_id WHERE reject_reason IS NULL AND NOT (has_category AND category IS NULL)),
        middle AS (SELECT quantile_disc(resume_id, 0.5) AS m FROM uploads)
        SELECT resume_id, (SELECT max(item_id) FROM benchmark) + row_number() OVER (ORDER BY resume_id) AS jd_id, category_detected,
          qualifications, requirements, CASE WHEN resume_id <= m THEN 0 ELSE 1 END AS batch FROM saved, middle""",
    "stream_files": f"""SELECT conv_id, CASE WHEN {_BROKEN} THEN '' ELSE text END AS text, CASE WHEN {_BROKEN} THEN 'ERROR' END AS log_type,
        CASE WHEN {_BROKEN} THEN 'PDF parsing failed: not a document' END AS message FROM ({_FILE_TEXTS})""",
    "category_scores_store": f"""{_RESUMES}, {upserted_ctes('details')}, {_RESPONSES},
        told AS (SELECT u.candidate_id, d.resume_path, d.resume_id, r.response FROM details d JOIN upserted u ON d.email = u.candidate_email
          JOIN responses r ON r.resume_id = d.resume_id WHERE r.kind = 'category_array'),
        arrived AS (SELECT candidate_id, resume_path, 1 AS batch, response FROM told WHERE resume_id % 10 <> 9
          UNION ALL SELECT candidate_id, resume_path, 2, regexp_replace(response, ',\\{{"category":"Spark".*$', ']') FROM told WHERE resume_id % 4 = 1),
        final AS (SELECT candidate_id, response FROM arrived
          QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY batch DESC, resume_path DESC) = 1)
        SELECT candidate_id, json_extract_string(e.value, '$.category') AS category_name, CAST(json_extract(e.value, '$.score') AS DOUBLE) AS score,
          CAST(json_extract(e.value, '$.weight') AS DOUBLE) AS weight, json_extract_string(e.value, '$.justification') AS justification
        FROM final f, json_each(f.response) e""",
    "jd_ingest_jobs": f"""WITH {_ANALYSED}, {_GATED}
        SELECT g.resume_id, g.jd_text, CASE WHEN has_category THEN category ELSE '' END AS category_detected, '2024-06-01' AS uploaded_at,
          qualifications, requirements FROM gated g JOIN analysed a ON g.resume_id = a.resume_id
        WHERE reject_reason IS NULL AND NOT (has_category AND category IS NULL)""",
    "jd_ingest_failed": f"""WITH {_ANALYSED}, {_GATED} SELECT g.resume_id, 'category is null' AS error
        FROM gated g JOIN analysed a ON g.resume_id = a.resume_id WHERE reject_reason IS NULL AND has_category AND category IS NULL""",
    "jd_ingest_audit": f"""WITH {_ANALYSED}, {_GATED},
        joined AS (SELECT g.resume_id, has_category, category, qualifications, requirements
          FROM gated g JOIN analysed a ON g.resume_id = a.resume_id WHERE reject_reason IS NULL)
        SELECT resume_id, 'INFO' AS log_type, 'JD_Analysis' AS process, 'JD upload received' AS message FROM gated
        UNION ALL SELECT resume_id, 'ERROR', 'JD_Analysis', reject_reason FROM gated WHERE reject_reason IS NOT NULL
        UNION ALL SELECT resume_id, 'ERROR', 'JD_Analysis', 'Unhandled exception in /upload: category is null' FROM joined
          WHERE has_category AND category IS NULL
        UNION ALL SELECT resume_id, 'INFO', 'JD_Analysis', 'JD saved (detected=''' || CASE WHEN has_category THEN category ELSE '' END
          || ''', quals=''' || coalesce(qualifications, 'None') || ''', reqs=''' || coalesce(requirements, 'None') || ''')' FROM joined
          WHERE NOT (has_category AND category IS NULL)""",
    "recommend_responses": f"""WITH {_JOBS}, {_SCORED},
        pairs AS (SELECT q.jd_id, q.folder, r.resume_id, r.resume_path, s.final_score, s.error, s.resume_id IS NOT NULL AS told
          FROM {_ACCEPTED} q JOIN jobs j ON q.jd_id = j.jd_id JOIN ({fx.RESUMES}) r ON r.folder = q.folder
          LEFT JOIN score_fields s ON s.resume_id = r.resume_id WHERE {_SCANNED}),
        judged AS (SELECT *, CASE WHEN told THEN error ELSE 'no response' END AS trouble FROM pairs)
        SELECT jd_id, folder, resume_path, CAST(row_number() OVER (PARTITION BY jd_id, folder ORDER BY coalesce(final_score, 0) DESC, resume_path) AS DOUBLE) AS rank,
          final_score, CAST(NULL AS VARCHAR) AS error FROM judged WHERE trouble IS NULL
        UNION ALL SELECT jd_id, folder, resume_path, NULL, NULL, trouble FROM judged WHERE trouble IS NOT NULL""",
    "recommend_model": f"""WITH rated AS (SELECT *, length(prompt) AS n FROM ({_REQUEST_PROMPTS}))
        SELECT jd_id, folder, resume_path, CAST(row_number() OVER (PARTITION BY jd_id, folder ORDER BY n % 11 DESC, resume_path) AS DOUBLE) AS rank,
          CAST(n % 11 AS DOUBLE) AS final_score, CAST(n AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS error FROM rated WHERE n % 7 <> 6
        UNION ALL SELECT jd_id, folder, resume_path, NULL, NULL, NULL, 'no JSON in response' FROM rated WHERE n % 7 = 6""",
    "stream_recommend": ORACLES["recommend"],
    "score_merge": ORACLES["score_upsert"],
}


def _with_doubles(sql: str, columns: tuple[str, ...]) -> str:
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) q"


ORACLES.update({key: _with_doubles(ORACLES[key], columns) for key, columns in NULLABLE_INTEGERS.items()})
