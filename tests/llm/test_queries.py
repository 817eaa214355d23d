"""The registered queries against their SQL on the smallest tables, and the pipeline."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, difference
from hiregrid.llm import exact_dedup, language, near_dedup
from hiregrid.llm.oracles import ORACLES
from hiregrid.llm.queries import QUERIES
from hiregrid.session import materialize
from tests.conftest import SF
from tests.llm.cases import (
    DOCS, awkward_docs, awkward_texts, empty_docs, exact_groups, gram_counts, gram_ranks, leaks, near_components, out_of_place, sha,
    white_words,
)
from tests.llm.test_documents import filled


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(spark, key):
    assert difference(QUERIES[key](spark, SF), connect(SF), ORACLES[key]) is None


def test_every_operator_has_a_query():
    assert [sum(k.startswith(f"op{n}_") for k in QUERIES) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in QUERIES


def test_pipeline_runs_all_stages(spark):
    result = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [r["doc_id"] for r in result.collect()]
    assert len(ids) == len(set(ids)) and set(ids) < {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert result.where("taken > 2 * size").count() == 0


@pytest.mark.parametrize("make", [awkward_docs, empty_docs])
def test_stages_keep_columns(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        docs = kept
    corpus_pipeline.mix_sources(spark, docs, SF).collect()


def test_exact_stage_keeps_one_row_per_text(spark):
    kept = [(r["doc_id"], r["text"]) for r in exact_dedup.keep_first(awkward_docs(spark)).collect()]
    assert len(kept) == len({g[3] for g in exact_groups(awkward_texts())})
    assert {k for k, _ in kept} == {g[1] for g in exact_groups(awkward_texts())}


def test_exact_stage_keeps_the_longest_row_of_an_id(spark):
    rows = []
    for i in range(40):  # the longest text comes late; two rows of that length differ only in their source
        rows += [(i, f"a b{i}", "x"), (i, f"a  b{i}", "y"), (i, f" a b {i}", None), (i, f" a b {i}", "z"), (i, f"ab{i}", "x")]
    rows += [(None, "once", "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = [sorted(map(tuple, exact_dedup.keep_first(d).collect()), key=repr)
             for d in (docs.coalesce(1), docs.orderBy(F.desc("source")).coalesce(1), docs.repartition(7, "text"))]
    assert found[0] == found[1] == found[2]
    assert [r[:2] for r in found[0]] == sorted([(i, f" a b {i}") for i in range(40)] + [(None, "once")], key=repr)


def test_near_stage_keeps_first_of_component(spark):
    kept = [r["doc_id"] for r in near_dedup.keep_first(awkward_docs(spark)).collect()]
    found = near_components(awkward_texts())
    expected = [i for i, _ in awkward_texts() if i is None or found[i] == i]
    assert sorted(kept, key=str) == sorted(expected, key=str)


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_source(rows):
    """The targets of sources from (source, size)."""
    sizes = {}
    for source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    return sizes, dict(zip(order, filled([sizes[s] for s in order], 1.5, (5, 2, 1))))


def check_mix(found, rows):
    """``found`` against (doc_id, source, size): targets, and copies whose sums follow the targets."""
    sizes, aims = by_source([r[1:] for r in rows])
    assert sorted(((r["doc_id"], r["size"]) for r in found), key=repr) == sorted(((i, n) for i, _, n in rows), key=repr)
    for source, aim in aims.items():
        own = [r for r in found if r["source"] == source]
        assert all(r["source_size"] == sizes[source] and abs(r["target"] - aim) < 1e-6 for r in own)
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in own)
        assert abs(sum(r["copies"] for r in own) - len(own) * (aim / sizes[source] if sizes[source] else 0)) < 1 + 1e-6


def test_pipeline_against_plain_chain(spark, tmp_path, monkeypatch):
    words = [(t or "").split() for _, t in awkward_texts()]
    items = [(1, " ".join(words[30][60:75])), (2, "one, TWO three"), (3, None), (4, "zz top")]
    folder = write(spark, tmp_path, documents=(awkward_docs(spark).collect(), DOCS), benchmark=(items, "item_id bigint, text string"))
    stages = {}

    def kept(df, label):
        done = materialize(df, label)
        stages[label.removeprefix("pipeline-")] = done
        return done

    monkeypatch.setattr(corpus_pipeline, "materialize", kept)
    mixed = corpus_pipeline.run(spark, folder).collect()
    rows, chain = awkward_texts(), {}
    chain["language"] = rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {g[3]: g[1] for g in exact_groups(rows)}
    longest = {}
    for i, t in rows:
        if best[digest_of(t)] == i and len(t) > len(longest.get((i, digest_of(t)), "")):
            longest[i, digest_of(t)] = t
    chain["exact_dedup"] = rows = [(i, t) for (i, _), t in longest.items()]
    found = near_components(rows)
    chain["near_dedup"] = rows = [(i, t) for i, t in rows if i is None or found[i] == i]
    chain["decontaminate"] = rows = [(i, t) for i, t in rows if not leaks(t, items)[1]]
    before = awkward_texts()
    for name, expected in chain.items():
        assert len(expected) < len(before), name
        assert sorted(map(tuple, stages[name].select("doc_id", "text").collect()), key=repr) == sorted(expected, key=repr), name
        before = expected
    last = stages["decontaminate"].select("doc_id", "source", "text").collect()
    check_mix(mixed, [(i, s, len(white_words(t))) for i, s, t in last])


def digest_of(text):
    return sha("".join((text or "").split()))


def test_queries_without_sql(spark, tmp_path):
    pages = [(n, f"http://h.org/{n}", f"<nav>menu</nav><article><p>text {n} é") for n in range(5)]
    pages += [(n, f"http://u.org/{n}", f"<div>Home</div><p>own {n} words") for n in range(5, 10)] + [(10, None, None)]
    docs = awkward_docs(spark).collect()
    folder = write(spark, tmp_path, pages=(pages, "page_id bigint, url string, html string"), documents=(docs, DOCS))
    found = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in QUERIES["op3_page_text"](spark, folder).collect()}
    texts = [f"text {n} é" for n in range(5)] + [f"own {n} words" for n in range(5, 10)] + [""]
    assert found == {n: (url, texts[n], len(texts[n])) for n, url, _ in pages}

    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 4 == 2

    profiles = {}
    for lang in ("en", "fr"):
        text = " ".join(r["text"] for r in docs if r["lang"] == lang and r["text"] and not out(r["doc_id"]))
        profiles[lang] = gram_ranks(gram_counts(text), language.TOP)
    found = [(r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in QUERIES["op9_language"](spark, folder).collect()]
    judged = [(i, out(i), *out_of_place(t, profiles, language.TOP)) for i, t in awkward_texts()]
    assert sorted(found, key=repr) == sorted(((i, o, k, round(s, 9)) for i, o, k, s in judged), key=repr)

    result = QUERIES["op10_mixing"](spark, folder)
    assert result.columns == ["doc_id", "size", "source_size", "target", "taken"]
    sizes, aims = by_source([(r["source"], len(white_words(r["text"]))) for r in docs])
    expected = [(r["doc_id"], len(white_words(r["text"])), sizes[r["source"]], round(aims[r["source"]], 6)) for r in docs]
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in result.collect()), key=repr) == sorted(
        expected, key=repr)
    assert result.where("taken > 2 * size or size > 0 and taken % size > 0").count() == 0
