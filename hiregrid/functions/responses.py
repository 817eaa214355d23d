"""Strict JSON and the three response-parsing policies.

Each policy yields a struct ``(ok boolean, is_object boolean, json string)``:
``ok`` when JSON text was found, ``is_object`` when it is a key/value object,
``json`` the text to read fields from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.functions.dialect import first_match, strip

_JSON = {"allowSingleQuotes": "false"}
_SENTINEL = "#end"
JSON_SPACE = " \t\n\r"
SCALAR_STARTS = "-+0123456789tfnNI"  # numbers, with those Spark takes that are none, and true, false, null

# Response fences and the characters trimmed around a fenced body.
FENCES = ("```json", "```")
FENCE_TRIM = "` \n"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` refers to it: Catalyst would inline it each time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    ``from_json`` alone ignores what follows the value, so the text is put
    inside an array in front of a sentinel that must come out second and last.
    """
    wrapped = F.from_json(
        F.concat(F.lit("["), text, F.lit(f',"{_SENTINEL}"]')), "array<string>", _JSON
    )
    valid = once(wrapped, lambda w: F.coalesce((F.size(w) == 2) & (F.try_element_at(w, F.lit(2)) == _SENTINEL), F.lit(False)))
    return F.when(once(F.btrim(text, F.lit(JSON_SPACE)), _may_be_json), valid).otherwise(F.lit(False))


def _may_be_json(body: Column) -> Column:
    """Whether trimmed text begins and ends as a JSON value does: parsing prose only to fail costs an exception a row."""
    closed = [body.startswith(first) & body.endswith(last) for first, last in ("{}", "[]", '""')]
    return closed[0] | closed[1] | closed[2] | F.substr(body, F.lit(1), F.lit(1)).isin(*SCALAR_STARTS)


def is_object(json: Column) -> Column:
    """Whether valid, stripped JSON text is a key/value object."""
    return F.coalesce(json.startswith("{"), F.lit(False))


def object_fields(json: Column, keys: tuple[str, ...]) -> Column:
    """A struct of the values under ``keys`` as text, null unless ``json`` is an object.

    Of a repeated key the last value counts; numbers and nested values come as
    their JSON text.
    """
    schema = T.StructType([T.StructField(key, T.StringType()) for key in keys])
    return F.when(is_object(json), F.from_json(json, schema, _JSON))


def has_key(json: Column, key: str) -> Column:
    """Whether an object has ``key``, with null too."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def _outcome(json: Column) -> Column:
    return once(json, lambda j: F.struct(
        j.isNotNull().alias("ok"),
        is_object(j).alias("is_object"),
        j.alias("json"),
    ))


def _valid(text: Column) -> Column:
    return F.when(is_json(text), strip(text))


def unfence(text: Column) -> Column:
    """Drop a leading code fence and what belongs to it."""
    body = strip(text)
    result = body
    for fence in reversed(FENCES):
        inner = F.btrim(F.substr(body, F.lit(len(fence) + 1)), F.lit(FENCE_TRIM))
        result = F.when(body.startswith(fence), inner).otherwise(result)
    return result


def parse_fenced(response: Column) -> Column:
    """Candidate policy: a fence may surround the JSON, nothing else may."""
    return _outcome(once(unfence(response), _valid))


def parse_first_object(response: Column) -> Column:
    """Analysis policy: strict, else the shortest ``{…}``, else an empty object."""
    shortest = first_match(response, r"\A[^{]*+(\{[^}]*+\})", 1)
    return _outcome(F.coalesce(_valid(strip(response)), once(shortest, _valid), F.lit("{}")))


def parse_widest_object(response: Column) -> Column:
    """Score policy: strict, else from the first ``{`` to the last ``}``."""
    widest = first_match(response, r"(?s)\A[^{]*+(\{.*\})", 1)
    return _outcome(F.coalesce(_valid(response), once(widest, _valid)))
