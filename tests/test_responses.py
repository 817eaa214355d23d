"""JSON strictness against the standard parser, and the three policies."""

import json

from pyspark.sql import functions as F

from hiregrid.functions import responses
from hiregrid.functions.dialect import strip
from hiregrid.operators import analysis, details
from hiregrid.functions.extract import FIELDS

TEXTS = [
    '{"a":1}', '{"a":1} junk', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "[1]", "[1]]", "7", "null", "true", '"x"', "",
    " ", "no idea", "{}", "[]", '{"a":1,}', "[1,]", "{'a':1}", '{"a":"\n"}', '{"a":1} // c', "NaN", '{"a":NaN}',
    "Infinity", '{"a":{"b":[1,2]}}', "01", '{"a"}', "{", "}", '"#end"', '1,"#end"', " \n{\"a\":1}\t", " {}",
]


def column(spark, values, expression):
    frame = spark.createDataFrame(list(enumerate(values)), "i int, response string")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def parses(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def test_is_json_agrees_with_the_standard_parser(spark):
    found = column(spark, TEXTS, responses.is_json(F.col("response")))
    assert dict(zip(TEXTS, found)) == {t: parses(t) for t in TEXTS}


def test_object_fields(spark):
    values = ['{"a":1,"b":"x","a":2}', '{"b":null}', '{"a":{"c":[1]},"b":""}', "[1]", "7"]
    found = column(spark, values, responses.object_fields(F.col("response"), ("a", "b")))
    assert [tuple(f) if f else None for f in found] == [("2", "x"), (None, None), ('{"c":[1]}', ""), None, None]


def test_policies(spark):
    body = '{"a":{"b":1}}'
    cases = [
        # response, fenced, first object, widest object (None: no JSON found)
        (body, body, body, body),
        (f" ```json\n{body}\n``` ", body, "{}", body),
        (f"```\n{body}\n```", body, "{}", body),
        (f"Sure: {body} done", None, "{}", body),
        ('x {"a":1} y', None, '{"a":1}', '{"a":1}'),
        ('{"a":1} and {"c":2}', None, '{"a":1}', None),
        ("", None, "{}", None),
        ("no idea", None, "{}", None),
        ("[1]", "[1]", "[1]", "[1]"),
        ("{ never closed", None, "{}", None),
        ("{" * 20_000, None, "{}", None),
    ]
    texts = [c[0] for c in cases]
    for position, policy in enumerate(
        (responses.parse_fenced, responses.parse_first_object, responses.parse_widest_object), start=1
    ):
        found = column(spark, texts, policy(F.col("response"))["json"])
        assert found == [c[position] for c in cases], policy.__name__


def test_analysis_keeps_null_and_absent_apart(spark):
    values = ['{"category":"A","requirements":"r"}', '{"category":null,"qualifications":null}', "{}", "[1]", None]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, response string")
    rows = analysis.parse_analysis(frame).orderBy("i").collect()
    assert [(r.categories, r.qualifications, r.requirements) for r in rows] == [
        (["A"], "", "r"), ([None], None, ""), ([], "", ""), ([], "", ""), ([], "", ""),
    ]


def test_scores(spark):
    values = ['{"final_score":7.5,"reason":"ok"}', '{"final_score":"7"}', '{"final_score":"high"}', "[1]", "none", "{}"]
    frame = spark.createDataFrame(list(enumerate(values)), "i int, response string")
    rows = analysis.parse_scores(frame).orderBy("i").collect()
    assert [(r.final_score, r.reason) for r in rows][:3] == [(7.5, "ok"), (7.0, None), (None, None)]
    assert [r.error for r in rows] == [
        None, None, "score is not a number", "response is not an object", "no JSON in response", None,
    ]


def test_fill_only_what_is_missing(spark):
    schema = (
        "id int, name string, email string, phone string, linkedin_url string, current_location string, "
        "years_of_experience int, education_level string, last_position_title string, skills array<string>"
    )
    known = spark.createDataFrame(
        [(1, "Known", None, None, None, "", None, None, None, []), (2, "Known", None, None, None, None, None, None, None, ["a"])],
        schema,
    )
    answers = [
        (1, '```json\n{"name":"New","email":"e@x.y","phone":"","years_of_experience":4,"current_location":"L","skills":["s",1]}```'),
        (2, "not json"),
    ]
    filled = details.fill_missing(known, spark.createDataFrame(answers, "id int, response string"), "id")
    rows = filled.select("id", *FIELDS, "fill_error").orderBy("id").collect()
    assert tuple(rows[0]) == (1, "Known", "e@x.y", None, None, "", 4, None, None, ["s", "1"], False)
    assert tuple(rows[1]) == (2, "Known", None, None, None, None, None, None, None, ["a"], True)


def test_skills_that_are_no_list_become_empty(spark):
    row = (1, "n", "e", "p", "l", "c", 1, "d", "t", [], '{"skills":"Go"}')
    schema = (
        "id int, name string, email string, phone string, linkedin_url string, current_location string, "
        "years_of_experience int, education_level string, last_position_title string, skills array<string>, response string"
    )
    assert details.fill_gaps(spark.createDataFrame([row], schema)).first()["skills"] == []


def test_weighted_final(spark):
    rows = [
        (1, '[{"category":"A","score":7,"weight":2},{"category":"B","score":4,"weight":1}]'),
        (2, '[{"category":"A","score":7,"weight":0}]'),
        (3, "broken"),
    ]
    frame = analysis.category_score_rows(spark.createDataFrame(rows, "id int, response string"))
    assert frame.count() == 3
    totals = dict(analysis.weighted_final(frame, ["id"]).collect())
    assert totals == {1: 6.0, 2: None}


def test_strip_removes_unicode_space(spark):
    assert column(spark, [" \x1f a b 　\x85"], strip(F.col("response"))) == ["a b"]
