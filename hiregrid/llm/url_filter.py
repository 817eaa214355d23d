"""URL filters: a sort-merge range join of urls and rules over reversed-host keys.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's; the longest rule
(host and path together, then host) wins. Keys are the reversed host labels, then the path, so that everything a rule fits for
one host is one interval of the sort order. A url is looked up once for every ending of its host that a rule could have, which
makes "all subdomains" equal hosts. Each task sorts the keys of its batch and sweeps them together with the sorted rules; a
stack holds the nested rules whose interval is open, the innermost on top.

Rules come to the tasks in blocks of bounded size (one block unless they are very many), the urls are never shuffled, and
equal urls of a batch are swept once. A batch, its keys and a block are all that a task holds.

Defined results: a null url or one without ``://`` has an empty host and path; no rule gives a null rule and ``default``.
A null host or path of a rule is empty; of equal rules with different verdicts, ``block`` counts; a verdict other than the two
is an error of the caller and returned as it is. Repeated urls get equal results; an empty rule table leaves all to ``default``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hiregrid.llm.support import LOWER, UPPER, blocks, fresh

A_TO_Z = str.maketrans(UPPER.decode(), LOWER.decode())
FOUND = "struct<size:int,host_size:int,rule:string,verdict:string>"
HOST_END, PATH_END = re.compile("[/?#]"), re.compile("[?#]")


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = HOST_END.search(rest)
    host, rest = (rest[: end.start()], rest[end.start():]) if end else (rest, "")
    end = PATH_END.search(rest)
    return host.translate(A_TO_Z), rest[: end.start()] if end else rest


def key_of(labels: list[str], path: str) -> str:
    return "\x01".join(reversed(labels)) + "\x02" + path


def sweep(keys: list[tuple[str, str, str]], rules: list[tuple[str, str, str, str]]) -> dict[tuple[str, str], tuple]:
    """The longest rule for each (key, host, path), both lists sorted by key; without an entry if there is none."""
    found, stack, at = {}, [], 0
    for key, host, path in keys:
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        # A separator inside a host can make keys look nested that aren't; the parts decide.
        best = next((r for r in reversed(stack) if r[1] == host and path.startswith(r[2])), None)
        if best:
            found[host, path] = (len(best[1]) + len(best[2]), len(best[1]), best[1] + best[2], best[3])
    return found


def matcher(rows: list) -> Column:
    """An Arrow UDF from a url to the longest rule of a block."""
    rules = sorted((key_of(r["host"].split("."), r["path"]), r["host"], r["path"], r["verdict"]) for r in rows)
    most = max((r["host"].count(".") + 1 for r in rows), default=0)

    @F.arrow_udf(FOUND)
    def longest(urls: pa.Array) -> pa.Array:
        split = [host_and_path(u) for u in urls.to_pylist()]
        keys = set()
        for host, path in set(split):
            labels = host.split(".")
            for k in range(max(0, len(labels) - most), len(labels)):
                keys.add((key_of(labels[k:], path), ".".join(labels[k:]), path))
        found = sweep(sorted(keys), rules)
        best = {}
        for host, path in set(split):
            labels = host.split(".")
            hits = (found.get((".".join(labels[k:]), path)) for k in range(max(0, len(labels) - most), len(labels)))
            hit = max((h for h in hits if h), default=None)
            best[host, path] = dict(zip(("size", "host_size", "rule", "verdict"), hit)) if hit else None
        return pa.array([best[s] for s in split], pa.struct(
            [("size", pa.int32()), ("host_size", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())]
        ))

    return longest


@F.arrow_udf(T.StructType().add("host", T.StringType()).add("path", T.StringType()))
def url_parts(urls: pa.Array) -> pa.Array:
    return pa.array([dict(zip(("host", "path"), host_and_path(u))) for u in urls.to_pylist()],
                    pa.struct([("host", pa.string()), ("path", pa.string())]))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict, which replace columns of these names."""
    clean = rules.select(
        F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hits = [matcher(rows)(F.col(url)) for rows in blocks(clean, F.length("host") + F.length("path") + 64)]
    best = F.array_max(F.array(*hits))
    name = fresh("judged", pages)
    judged = pages.select("*", F.struct(url_parts(F.col(url)).alias("parts"), best.alias("best")).alias(name))
    return judged.withColumns({
        "host": F.col(f"{name}.parts.host"), "path": F.col(f"{name}.parts.path"), "rule": F.col(f"{name}.best.rule"),
        "verdict": F.coalesce(f"{name}.best.verdict", F.lit(default)),
    }).drop(name)
