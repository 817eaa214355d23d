"""Quality rules and ranked search against plain Python, on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hiregrid.llm import lexical, quality
from hiregrid.llm.queries import QUERIES
from tests.llm import cases

LABELS = "doc_id bigint, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return cases.awkward_docs(spark).cache()


def base_counts(text):
    text = text or ""
    words = cases.white_words(text, False)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if cases.white_words(line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols if words else 0, len(lines) - len(set(lines)), len(again), failed


EXTRA_TEXTS = ["a b c a b c", "a a a", "é# é# |x|\né# é# |x|\n \n \n", "one\ntwo\none\r\none\ttwo\n", "# * $", "w " * 49, "w1 w2 w3 " * 17, "\v\f"]


def test_counts(spark):
    texts = [t for _, t in cases.awkward_texts()] + EXTRA_TEXTS
    frame = spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], "doc_id bigint, text string, score string")
    found = {r["doc_id"]: r["judged"] for r in quality.judge(frame, None, "judged").collect()}
    for n, text in enumerate(texts):
        assert (*(found[n][c] for c in quality.COUNTS), found[n]["base_failed"]) == base_counts(text), text
        assert found[n]["score"] == 1


def separable(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = rng.random((n, len(quality.STATISTICS)))
    labels = (rows[:, 2] + rng.normal(0, 0.05, n) < 0.5).astype(float)
    return rows, labels


def test_forest_learns_and_keeps_signs():
    rows, labels = separable(2000)
    forest = quality.boost(rows, labels)
    fresh_rows, fresh_labels = separable(1000, 2)
    assert ((forest.scores(fresh_rows) > 0.5) == (fresh_labels > 0)).mean() > 0.9
    rng = np.random.default_rng(3)
    # Labels that rise with a falling statistic teach nothing about it.
    wrong = quality.boost(rows, (rows[:, 3] > 0.5).astype(float))
    for model in (forest, wrong):
        for at in np.flatnonzero(quality.SIGNS):
            more = fresh_rows.copy()
            more[:, at] += rng.random(len(more))
            assert (model.scores(more) <= model.scores(fresh_rows) + 1e-12).all()


def test_flat_trees_equal_a_walk():
    rows, labels = separable(300)
    forest = quality.boost(rows, labels)
    for row, score in zip(rows[:50], forest.scores(rows[:50])):
        total = forest.base
        for node in forest.roots:
            while forest.asked[node] >= 0:
                node = forest.left[node] if row[forest.asked[node]] <= forest.limit[node] else forest.right[node]
            total += forest.weight[node]
        assert math.isclose(score, 1 / (1 + math.exp(-total)))


def test_held_out_accuracy(spark):
    """Learned from three quarters of the labels, judged on the others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    forest = quality.learn(docs, labels.where(~out))
    judged = quality.judge(docs.join(labels.where(out).select("doc_id", "quality"), "doc_id"), forest, "judged")
    rows = judged.select("quality", (F.col("judged.score") >= quality.KEEP_FROM).alias("good")).collect()
    good, bad = [r["good"] for r in rows if r["quality"]], [r["good"] for r in rows if not r["quality"]]
    assert len(bad) > 50 and sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.05


def test_learning(spark, docs):
    """Nulls, repeated labels and rows, one class only, no rows, and the bound on labelled rows."""
    ids = [i for i, t in cases.awkward_texts() if i is not None]
    labels = spark.createDataFrame([(i, n % 2, 0, "x") for n, i in enumerate(ids)] + [(None, 1, 1, "y"), (ids[0], None, 0, ""), (ids[0], 1, 0, "")], LABELS)
    forest = quality.learn(docs, labels)
    again = quality.learn(docs.orderBy(F.rand()), labels.orderBy(F.rand()))
    assert forest is not None and all(np.array_equal(a, b) for a, b in zip(vars(forest).values(), vars(again).values()))
    assert quality.learn(docs, labels.where("quality = 1")) is None
    assert quality.learn(docs, labels.limit(0)) is None and quality.learn(docs.limit(0), labels) is None
    assert quality.learn(docs, labels, rows=1) is None
    assert quality.keep_good(docs, forest).columns == docs.columns
    assert quality.judge(cases.empty_docs(spark), forest, "judged").count() == 0


def test_quality_query(spark, tmp_path):
    docs = [(i, t, "en", "a", 0) for i, t in cases.awkward_texts()]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = sorted((tuple(r)[:-1] for r in QUERIES["op12_quality"](spark, str(tmp_path)).collect()), key=repr)
    assert found == sorted(((i, *(c := base_counts(t)), not c[-1]) for i, t in cases.awkward_texts()), key=repr)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(cases.A_TO_Z))


def ranking(docs, items, top=20):
    """The plain version: every document against every item."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_words = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, counts, _ in held for t in counts)
    asked = {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in asked.items():
        scored = []
        for doc, counts, n in held:
            score = 0
            for term, times in query.items():
                if tf := counts.get(term):
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)))
            if score:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def search_cases():
    docs = cases.awkward_texts() + [(2000 + n, "tie of equals") for n in range(30)] + [(None, "tie of equals"), (2001, "tie of equals")]
    texts = [t for _, t in docs if t and len(t) < 5000]
    items = [(n, t[5:90]) for n, t in enumerate(texts[::3])] + [
        (100, "tie"), (101, "TIE tie of"), (102, None), (103, ""), (104, "-- !"), (105, "nosuchword"), (None, "equals of"), (None, "equals of"),
        (106, "tie"), (106, "one two three"), (107, " ".join(texts)[:3000])]
    return docs, items


@pytest.mark.parametrize("top, docs_of_run, postings, items_of_block, block", [(20, 8192, 10**7, None, 64), (3, 7, 10**7, 4, 2), (20, 50, 900, 9, 8), (1, 40, 10**7, None, 4)])
def test_search(spark, monkeypatch, top, docs_of_run, postings, items_of_block, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = search_cases()
    frame = spark.createDataFrame([(*d, 1, 2, "q") for d in docs], "doc_id bigint, text string, rank int, score bigint, query string").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, term string")
    found = lexical.search_documents(frame, asked, top, docs_of_run, postings, items_of_block)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == ranking(docs, items, top)


def test_search_empty(spark):
    docs = cases.empty_docs(spark)
    items = spark.createDataFrame([(1, "a b"), (2, None)], "item_id string, text string")
    assert lexical.search_documents(docs, items).count() == 0
    assert lexical.search_documents(docs, items.limit(0)).count() == 0
    assert lexical.search_documents(docs.select("doc_id", F.lit("a b").alias("text")), items).schema["item_id"].dataType.simpleString() == "string"


@pytest.mark.parametrize("span", [64, 8])
def test_runs_skip_blocks(monkeypatch, span):
    """Once good documents were seen, blocks that can't hold better ones are not walked; results are those of a full walk."""
    monkeypatch.setattr(lexical, "BLOCK", span)
    texts = ["rare rare common"] * 5 + ["common filler"] * 2000 + ["rare common"] * 3
    asked = lexical.terms(b"rare common")
    queries = lexical.Queries(np.unique(asked), [(1, np.arange(2), np.ones(2, np.int64))])
    docs = [lexical.terms(t.encode()) for t in texts]
    queries = queries.weigh({lexical.DOCUMENTS: len(docs), lexical.TERMS: sum(map(len, docs)), int(queries.numbers(lexical.terms(b"rare"))[0]): 8,
                             int(queries.numbers(lexical.terms(b"common"))[0]): len(docs)})
    run = lexical.Run(list(range(len(docs))), [len(d) for d in docs], [queries.numbers(d) for d in docs], queries)
    best = lexical.Best(5)
    walked = run.answer(*queries.asked[0][1:], best)
    assert walked < run.blocks / 2
    assert sorted(doc for *_, doc in best.held) == [0, 1, 2, 3, 4]
