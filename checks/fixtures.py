"""Input views over the given tables, in SQL that Spark and DuckDB both run.

No résumés or job descriptions come with the test tables, so they are derived:
every view reads its whole source table and grows with it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

_NL = "chr(10)"
# Whose e-mail a résumé has: neighbours share one across folders, and every sixth résumé has that of another in its folder.
_OWNER = "(c_custkey - c_custkey % 2 - CASE WHEN c_custkey % 20 >= 10 AND c_custkey % 3 = 0 THEN 10 ELSE 0 END)"

RESUMES = f"""
SELECT c_custkey AS resume_id,
  'f' || CAST(c_custkey % 5 AS STRING) AS folder,
  'resumes/f' || CAST(c_custkey % 5 AS STRING) || '/cv_' || CAST(c_custkey AS STRING)
    || CASE WHEN c_custkey % 11 = 10 THEN '.txt' WHEN c_custkey % 11 = 9 THEN '.PDF' ELSE '.pdf' END AS resume_path,
  CASE WHEN c_custkey % 23 = 22 THEN '  ' || {_NL} || chr(9) ELSE
    {_NL} || CASE c_custkey % 4 WHEN 0 THEN '  Ada Marie Lovelace' WHEN 1 THEN 'jo li' WHEN 2 THEN '123 456'
             ELSE 'Zoë O''Neil (MBA)' END || {_NL}
    || CASE c_custkey % 5 WHEN 0 THEN 'Springfield, IL' WHEN 1 THEN 'New York,NY' WHEN 2 THEN 'Paris, FRANCE'
             WHEN 3 THEN 'Remote' ELSE 'Based in Austin,  TX 78701' END || {_NL}
    || CASE WHEN c_custkey % 9 = 8 THEN 'no contact'
            ELSE 'Mail: User.' || CAST({_OWNER} AS STRING) || '+cv@Mail-'
                 || CAST({_OWNER} % 7 AS STRING) || '.Example.com' END || {_NL}
    || CASE c_custkey % 6 WHEN 0 THEN '+1 (555) 123-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
             WHEN 1 THEN '555.123.4567' WHEN 2 THEN 'ref 12345678901' ELSE 'phone on request' END || {_NL}
    || CASE c_custkey % 3 WHEN 0 THEN 'https://www.linkedin.com/in/user_' || CAST(c_custkey AS STRING) || '/'
             WHEN 1 THEN '<a HREF="HTTPS://LinkedIn.com/in/u-' || CAST(c_custkey AS STRING) || '">' ELSE '' END || {_NL}
    || CASE c_custkey % 7 WHEN 0 THEN '7+ years of experience' WHEN 1 THEN '120 Year experience'
             WHEN 2 THEN '3 years' ELSE CAST(c_custkey % 40 AS STRING) || ' YEARS experience' END || chr(13) || {_NL}
    || CASE c_custkey % 8 WHEN 0 THEN 'PhD in Nursing' WHEN 1 THEN 'Urban planner' WHEN 2 THEN 'Bachelor of Science'
             WHEN 3 THEN 'none' ELSE 'B.S. Physics' END || {_NL}
    || CASE WHEN c_custkey % 10 < 7 THEN 'Work History' || {_NL} || '   ' || {_NL} || '  Senior '
             || lower(c_mktsegment) || ' lead ' || {_NL} ELSE '' END
    || CASE WHEN c_custkey % 10 < 8 THEN 'Technical skills:' || {_NL} || 'SQL, Spark; Python,, SQL' || {_NL}
             || lower(c_mktsegment) || ' , an extremely long skill name that is over forty characters' || {_NL}
             || CASE WHEN c_custkey % 2 = 0 THEN {_NL} || 'Ignored, After blank'
                     ELSE 'Experience' || {_NL} || 'Ignored, After header' END ELSE '' END
  END AS resume_text
FROM customer
"""

# The résumés plus every document as one more résumé: prose of up to 20,000
# words in four languages, with junk, personal data and repeated lines.
CORPUS = f"""
SELECT resume_id, folder, resume_path, resume_text FROM ({RESUMES}) r
UNION ALL
SELECT doc_id + 1000000000 AS resume_id, source AS folder,
  'resumes/' || source || '/doc_' || CAST(doc_id AS STRING) || '.pdf' AS resume_path, text AS resume_text
FROM documents
"""

JOBS = """
SELECT item_id AS jd_id,
  'f' || CAST(item_id % 5 AS STRING) AS folder,
  text AS jd_text,
  CASE WHEN item_id % 7 = 6 THEN NULL
       WHEN item_id % 4 = 0 THEN 'SQL' WHEN item_id % 4 = 1 THEN 'Data Engineering, Spark'
       WHEN item_id % 4 = 2 THEN 'Building' ELSE 'Nursing' END AS category_detected,
  CASE WHEN item_id % 7 = 6 THEN NULL
       WHEN item_id % 3 = 0 THEN 'SQL, Spark; Python' || chr(10) || 'Furniture | Machinery'
       WHEN item_id % 3 = 1 THEN 'Household/Building.Automobile' ELSE '' END AS qualifications,
  CASE WHEN item_id % 7 = 6 THEN NULL
       WHEN item_id % 2 = 0 THEN ' python - SPARK - Scala ' ELSE 'Automobile; sql; sql; Leadership' END AS requirements
FROM benchmark
"""

# What is asked for: every job against its folder, some against a second one, some again, and requests without
# a job id, without a folder, or for a job that does not exist.
REQUESTS = f"""
SELECT jd_id, folder FROM ({JOBS}) j
UNION ALL SELECT jd_id, 'f1' AS folder FROM ({JOBS}) j WHERE jd_id % 4 = 0
UNION ALL SELECT jd_id, folder FROM ({JOBS}) j WHERE jd_id % 3 = 0
UNION ALL SELECT NULL AS jd_id, folder FROM ({JOBS}) j WHERE jd_id % 13 = 1
UNION ALL SELECT jd_id, CASE WHEN jd_id % 2 = 0 THEN '' END AS folder FROM ({JOBS}) j WHERE jd_id % 9 IN (3, 4)
UNION ALL SELECT max(jd_id) + 1 AS jd_id, 'f0' AS folder FROM ({JOBS}) j
"""

# One response per résumé and kind, in thirteen shapes of well- and ill-formed output.
_DETAILS = """'{"name":"Model Name ' || CAST(c_custkey AS STRING) || '","email":"model' || CAST(c_custkey AS STRING)
  || '@example.org","phone":"","linkedin_url":null,"current_location":"Oslo, NO","years_of_experience":'
  || CAST(c_custkey % 30 AS STRING) || ',"skills":' || CASE c_custkey % 3 WHEN 0 THEN '["Go","SQL"]'
  WHEN 1 THEN '[]' ELSE '"Go"' END || '}'"""
_ANALYSIS = """'{"category":"Cat ' || CAST(c_custkey % 5 AS STRING) || '","qualifications":"Q' || CAST(c_custkey AS STRING)
  || '"' || CASE WHEN c_custkey % 2 = 0 THEN ',"requirements":"R, S"' ELSE '' END || '}'"""
_SCORES = """'{"category_score":' || CAST(c_custkey % 11 AS STRING) || ',"requirements_score":' || CAST(c_custkey % 7 AS STRING)
  || '.5,"qualifications_score":' || CAST(c_custkey % 3 AS STRING) || ',"final_score":' || CAST(c_custkey % 10 AS STRING)
  || '.25,"reason":"fits ' || CAST(c_custkey % 4 AS STRING) || '"}'"""


def _shapes(kind: str, body: str) -> str:
    return f"""
SELECT resume_id, '{kind}' AS kind, CASE CAST(resume_id % 13 AS INT)
    WHEN 0 THEN body
    WHEN 1 THEN ' ```json' || chr(10) || body || chr(10) || '``` '
    WHEN 2 THEN '```' || chr(10) || body || chr(10) || '```'
    WHEN 3 THEN 'Sure: ' || body || ' done'
    WHEN 4 THEN 'x {{"category":{{"b":1}},"final_score":3,"name":{{"b":2}}}} y'
    WHEN 5 THEN body || ' and {{"c":2}}'
    WHEN 6 THEN body || ' junk'
    WHEN 7 THEN ''
    WHEN 8 THEN 'no idea'
    WHEN 9 THEN '{{"final_score":1,"category":"first","name":"First Name","final_score":2,"category":"last","name":"Last Name"}}'
    WHEN 10 THEN '{{"final_score":"7","category":null,"qualifications":null,"name":""}}'
    WHEN 11 THEN '{{}}'
    ELSE '[' || body || ']' END AS response
FROM (SELECT c_custkey AS resume_id, {body} AS body FROM customer) b
"""


_ARRAYS = """
SELECT c_custkey AS resume_id, 'category_array' AS kind,
  '[{"category":"SQL","score":' || CAST(c_custkey % 9 AS STRING) || ',"weight":' || CASE WHEN c_custkey % 10 = 0 THEN '0' ELSE '2' END
  || ',"justification":"k"},{"category":"Spark","score":4.5,"weight":'
  || CASE WHEN c_custkey % 10 = 0 THEN '0' ELSE CAST(c_custkey % 4 AS STRING) END || ',"justification":"m"}]' AS response
FROM customer
"""

RESPONSES = "\nUNION ALL\n".join(
    [_shapes("details", _DETAILS), _shapes("analysis", _ANALYSIS), _shapes("score", _SCORES), _ARRAYS]
)

# The candidate table before the batch; even supplier keys share e-mails with résumés.
CANDIDATES = """
SELECT s_suppkey + 1 AS candidate_id, s_name AS candidate_name,
  'user.' || CAST(s_suppkey AS STRING) || '+cv@mail-' || CAST(s_suppkey % 7 AS STRING) || '.example.com' AS candidate_email,
  '555-0000' AS candidate_phone, 'Old Town, OT' AS candidate_location, CAST(s_suppkey % 30 AS INT) AS candidate_year,
  'Old job' AS candidate_job, 'old/cv_' || CAST(s_suppkey AS STRING) || '.pdf' AS candidate_resume,
  TIMESTAMP '2020-01-01 00:00:00' AS created_at, TIMESTAMP '2020-01-01 00:00:00' AS candidate_updated_time,
  CAST(NULL AS STRING) AS candidate_company
FROM supplier
"""

# The score table before the batch: one row per order, null candidates among them.
SCORES = """
SELECT o_orderkey % 40 AS jd_id,
  CASE WHEN o_orderkey % 13 = 12 THEN NULL ELSE o_custkey + 1 END AS candidate_id,
  max(CAST(o_orderkey % 11 AS DOUBLE)) AS category_score, max(CAST(o_orderkey % 7 AS DOUBLE)) AS qualifications_score,
  max(CAST(o_orderkey % 5 AS DOUBLE)) AS requirements_score, max(CAST(o_orderkey % 9 AS DOUBLE)) AS final_score,
  'earlier' AS reason
FROM orders GROUP BY 1, 2
"""

# Category table before the batch, and the names that arrive (most of them again and again).
CATEGORIES = """
SELECT min(p_partkey) + 1 AS category_id, p_type AS name, 'category1' AS type FROM part GROUP BY p_type
"""
INCOMING_CATEGORIES = """
SELECT p_type AS name, 'category2' AS type FROM part
UNION ALL SELECT p_name AS name, 'category2' AS type FROM part
UNION ALL SELECT p_brand AS name, 'category1' AS type FROM part
"""

_PARQUET_SOURCE = re.compile(r"\bFROM (" + "|".join(TABLES) + r")\b")


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run fixture SQL on the parquet files of ``sf_dir``."""
    return spark.sql(_PARQUET_SOURCE.sub(rf"FROM parquet.`{sf_dir}/\1.parquet`", sql))
