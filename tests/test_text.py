"""Text helpers and prompts."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.functions import prompts, text
from hiregrid.functions.vectors import to_unit


def test_keywords(spark):
    frame = spark.createDataFrame(
        [(" SQL, Spark;; Python\n\xa0Big Data | a/b.c-d ,,SQL",), ("",), (None,), (" - ",)], "t string"
    )
    found = [r[0] for r in frame.select(text.keywords(F.col("t"))).collect()]
    assert found == [["sql", "spark", "python", "big data", "a", "b", "c", "d", "sql"], [], [], []]
    assert frame.select(text.keyword_set(F.col("t"))).first()[0][-1] == "d"


def test_sections(spark):
    frame = spark.createDataFrame(
        [(["a", "", None, "b"], " x ", 3, [1, 0, 2]), (None, None, None, None)],
        "skills array<string>, summary string, other int, projects array<int>",
    )
    types = {f.name: f.dataType for f in frame.schema.fields}
    rows = frame.select(*[text.normalize_section(F.col(c), types[c]) for c in frame.columns]).collect()
    assert [tuple(r) for r in rows] == [("a b", " x ", "3", "1 2"), ("", "", "", "")]
    joined = [r[0] for r in frame.select(text.full_resume_text(frame.schema)).collect()]
    # experience, projects, skills, summary, education, certifications, other
    assert joined == ["1 2 a b  x    3", ""]


def test_identity(spark):
    frame = spark.createDataFrame([("a/b/c.pdf", "N", "e"), ("c.pdf", "", "e"), ("x/", None, "e")], "p string, n string, e string")
    rows = frame.select(text.basename(F.col("p")), text.display_name(F.col("n"), F.col("e"))).collect()
    assert [tuple(r) for r in rows] == [("c.pdf", "N"), ("c.pdf", "e"), ("", "e")]


def test_prompts(spark):
    frame = spark.createDataFrame([(["email", "skills"], "text"), ([], "text")], "m array<string>, t string")
    asked, nothing = [r[0] for r in frame.select(prompts.missing_fields_prompt(F.col("m"), F.col("t"))).collect()]
    assert '["email","skills"]' in asked and "e-mail address; skills" in asked and asked.endswith("Resume:\ntext")
    assert nothing is None
    row = spark.range(1).select(
        prompts.analysis_prompt(F.lit("A, B"), F.lit("jd")), prompts.score_prompt(*map(F.lit, "crqt"))
    ).first()
    assert "from: A, B\n" in row[0] and row[0].endswith("\njd")
    assert "Category:\nc\nRequirements:\nr\nQualifications:\nq\nResume:\nt\n" in row[1]


def test_to_unit(spark):
    schema = T.StructType([T.StructField("v", T.ArrayType(T.FloatType()))])
    frame = spark.createDataFrame([([3.0, 4.0],), ([0.0],), ([],), (None,)], schema)
    found = [r[0] for r in frame.select(to_unit(F.col("v"))).collect()]
    assert found == [[0.6, 0.8], [0.0], None, None]
