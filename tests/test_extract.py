"""Goldens for every field rule, written by hand, and a random comparison with the SQL rules."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from checks.compare import normal_rows
from checks.oracles import FIELDS, details_ctes
from hiregrid.functions import extract

CASES = {
    "email": [
        ("Mail: User.7+cv@Mail-1.Example.com now", "user.7+cv@mail-1.example.com"),
        ("write to me@host.org.", "me@host.org."),  # a trailing dot is kept
        ("a@b@c.d", "b@c.d"),
        ("zoë@bücher.de", "zoë@bücher.de"),
        ("no at sign", None),
        ("user@localhost", None),
        ("x" * 50_000 + "@", None),
        ("", None),
        (None, None),
    ],
    "phone": [
        ("+1 (555) 123-4567", "+1 (555) 123-4567"),
        ("ref 12345678901", "12345678901"),  # no word boundary
        ("12345678", "12345678"),  # a leading 1 is the country code
        ("22345678", "2234567"),
        ("call 555.123.4567 x", "555.123.4567"),
        ("555 123 4567", "555 123 4567"),
        ("12-34", None),
    ],
    "linkedin_url": [
        ("see https://www.linkedin.com/in/ann_b-1/ ok", "https://www.linkedin.com/in/ann_b-1"),
        ('<a HREF="HTTPS://LinkedIn.com/in/u-4">', "HTTPS://LinkedIn.com/in/u-4"),
        ("HTTPS://LINKEDIN.COM/in/u", None),  # only the plain form is case-sensitive
        ("href='http://linkedin.com/in/x' then https://linkedin.com/in/y", "http://linkedin.com/in/x"),
    ],
    "name": [
        ("\n  Ada Marie Lovelace\nx", "Ada Marie Lovelace"),
        ("jo li\nJo li\nJo Li", "Jo Li"),
        ("123 456\nAda L", "123 456"),  # no word begins with a letter
        ("Zoë O'Neil (MBA)", "Zoë O'Neil (MBA)"),
        ("Single\nTwo Words", "Two Words"),
        ("李 小龙\nBruce Lee", "Bruce Lee"),  # letters without case are not upper-case
        ("Ann Lee\r\nx", "Ann Lee"),
        ("a B\x0bC D\x0ce", "C D"),
        ("Ann Lee Ok", "Lee Ok"),
        ("W " * 30_000 + "w", None),
        (" \n\t", None),
    ],
    "years_of_experience": [
        ("7+ years of experience", 7),
        ("120 Year experience", 20),
        ("3 years", None),
        ("12  YEARS experience", 12),
        ("٣ years experience", 3),  # digits of any script
        ("5 yearſ of experience", 5),  # long s is an s without case
    ],
    "education_level": [
        ("Urban planner", "ba"),
        ("management", "ma"),
        ("Bachelor of Science", "Ba"),
        ("MSc", "MS"),
        ("PhD in Nursing", "PhD"),
        ("Ph.D. here", "Ph.D."),
        ("doctorate", "doctorate"),
        ("none", None),
    ],
    "last_position_title": [
        ("Work History\n   \n  Senior lead \nx", "Senior lead"),
        ("Professional Experience\r\nCook", "Cook"),
        ("inexperience\nExperienced\nx", None),  # whole words only
        ("my EXPERIENCE here\n \nChef ", "Chef"),
        ("Experience", None),
        ("Experience\n\nExperience\nCook", "Experience"),  # only the first header counts
    ],
    "current_location": [
        ("Springfield, IL", "Springfield, IL"),
        ("New York,NY", "York,NY"),
        ("Paris, FRANCE", "Paris, FR"),
        ("\n" * 9 + "Austin, TX", "Austin, TX"),  # tenth line, blanks included
        ("\n" * 10 + "Austin, TX", None),
        ("\r\n" * 9 + "Austin, TX", "Austin, TX"),
        ("Austin,\nTX", None),
        ("austin, tx", None),
    ],
    "skills": [
        ("Technical skills: Go\nSQL, Spark; Python,, SQL\nsql\n\nIgnored", ["SQL", "Spark", "Python", "sql"]),
        ("Skills\nSQL\nmy experience here\nGo", ["SQL"]),
        ("Skills\n\nSQL", []),
        ("Skills", []),
        ("skillset\nSQL", []),
        ("Skills\r\nSQL\r\n" + "x" * 40 + "," + "y" * 39, ["SQL", "y" * 39]),
        ("SKILLS\n  SQL ; Go \u0085Rust", ["SQL", "Go", "Rust"]),
        ("none", []),
        (None, []),
    ],
}


@pytest.mark.parametrize("field", CASES)
def test_goldens(spark, field):
    texts, expected = zip(*CASES[field])
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = frame.select("i", extract.RULES[field](F.col("text")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == list(expected)


def test_missing_fields_in_order(spark):
    frame = spark.createDataFrame(
        [(None, "", None, "l", None, 3, None, "t", []), ("n", "e", "p", "l", "c", 1, "d", "t", ["s"])],
        "name string, email string, phone string, linkedin_url string, current_location string, "
        "years_of_experience int, education_level string, last_position_title string, skills array<string>",
    )
    found = [r[0] for r in frame.select(extract.missing_fields()).collect()]
    assert found == [["name", "phone", "current_location", "education_level", "skills"], []]


LONG = {
    "one word": "a" * 400_000,
    "words": "Ab " * 130_000,
    "headers": "Experience " * 40_000,
    "skills headers": "Skills\n" * 60_000,
    "blank lines": " \n" * 200_000,
    "spaces": "12" + " " * 400_000,
    "digits": "1" * 400_000,
    "at signs": "a@" * 200_000,
    "dots": "a.-" * 130_000 + "@",
    "letters and commas": "ab, " * 100_000,
    "links": "https://linkedin.com/i" * 20_000,
    "braces": "{" * 400_000,
}


@pytest.mark.parametrize("field", CASES)
def test_time_is_linear_in_the_text(spark, field):
    frame = spark.createDataFrame([(k, v) for k, v in LONG.items()], "kind string, text string").coalesce(1)
    start = time.monotonic()
    frame.select("kind", extract.RULES[field](F.col("text")).alias("v")).write.format("noop").mode("overwrite").save()
    assert time.monotonic() - start < 10


PIECES = (
    "Experience|experience|ſkills|Skills|SKILLS:| | |\x85|\x1c|\x1f|\x0b|\x0c|\r\n|\r|\n|\n|\n| | | |\t|"
    "\xa0|　|,|;|Ann|bob|Żółć|éa|ß|1|123|4567|-|.|(|)|+1|@|a.b|x_y|com|Ph.D|MBA|years|of|year experience|"
    "Work History|Work|TX|Paris|http://linkedin.com/in/|href=\"|\"|'|Professional Experience|inexperience|\U0001f600|李|Ⅷ"
).split("|")


def test_random_texts_match_the_sql_rules(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 60))) for _ in range(4000)]
    path = str(tmp_path / "texts")
    spark.createDataFrame(list(enumerate(texts)), "resume_id bigint, resume_text string").write.parquet(path)
    ours = spark.read.parquet(path).select("resume_id", *extract.detail_columns(F.col("resume_text")))
    source = f"SELECT resume_id, 'f' AS folder, 'p' AS resume_path, resume_text FROM '{path}/*.parquet'"
    theirs = duckdb.sql(f"WITH {details_ctes(source)} SELECT resume_id, {', '.join(FIELDS)} FROM details")
    assert normal_rows(ours.columns, ours.collect()) == normal_rows(theirs.columns, theirs.fetchall())
