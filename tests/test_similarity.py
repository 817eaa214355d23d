"""Top-k in all three plans against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from hiregrid.operators import bounded, similarity

STRATEGIES = ["corpus", "queries", "grid"]
DENSE = [*STRATEGIES, "bounded"]


def brute_force(queries, corpus, k):
    best = set()
    for q, qv in queries.items():
        scored = sorted(((-round(sum(a * b for a, b in zip(qv, v)), 6) + 0.0, c) for c, v in corpus.items()))[:k]
        best |= {(q, c, round(-s + 0.0, 6), n) for n, (s, c) in enumerate(scored, 1)}
    return best


def run(queries, corpus, k, strategy):
    topk = similarity.inner_product_topk(
        queries, corpus, "q", "c", k, strategy=strategy, block_rows=7, cell_rows=50
    )
    return {(r.q, r.c, round(r.score, 6), r["rank"]) for r in topk.collect()}


@pytest.mark.parametrize("strategy", DENSE)
def test_dense(spark, strategy):
    rng = random.Random(1)
    # Coarse values make ties; string ids on the corpus side.
    corpus = {f"p{i:03d}": [rng.randint(-2, 2) * 0.5 for _ in range(4)] for i in range(300)}
    queries = {i: [rng.randint(-2, 2) * 0.5 for _ in range(4)] for i in range(20)}
    found = run(
        spark.createDataFrame(list(queries.items()), "q int, vector array<double>"),
        spark.createDataFrame(list(corpus.items()), "c string, vector array<float>").repartition(5),
        5, strategy,
    )
    assert found == brute_force(queries, corpus, 5)


@pytest.mark.parametrize("strategy", DENSE)
def test_fewer_than_k(spark, strategy):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "q int, vector array<double>")
    corpus = spark.createDataFrame([(1, [0.5, 0.0]), (2, [-0.5, 0.0])], "c int, vector array<double>")
    assert run(queries, corpus, 5, strategy) == {(1, 1, 0.5, 1), (1, 2, -0.5, 2)}
    assert run(queries, corpus.limit(0), 5, strategy) == set()
    assert run(queries.limit(0), corpus, 5, strategy) == set()


def test_bounds_leave_out_cells(spark):
    """Vectors around twenty centres, a third of them equal: most cells are not visited, and nothing is lost."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]

    def near(centre):
        return [x + rng.gauss(0, 0.05) for x in centre]

    corpus = {i: centres[0] if i % 3 == 0 else near(centres[i % 20]) for i in range(600)}
    queries = {i: near(centres[i % 20]) for i in range(40)}
    asked = spark.createDataFrame(list(queries.items()), "q int, vector array<double>")
    known = spark.createDataFrame(list(corpus.items()), "c int, vector array<double>").repartition(5)
    assert run(asked, known, 5, "bounded") == brute_force(queries, corpus, 5)

    cells = bounded.cut_into_cells(known, "c")
    assert len(cells.pivots) == 25 and cells.sizes.sum() == 600 and cells.rows.count() == 600
    floors = {q: sorted((sum(a * b for a, b in zip(v, x)) for x in corpus.values()), reverse=True)[4] for q, v in queries.items()}
    floored = asked.join(spark.createDataFrame(list(floors.items()), "q int, floor double"), "q")
    visited = bounded.visits(floored, cells, 5, first=False).count() + bounded.visits(asked, cells, 5, first=True).count()
    assert visited <= 0.5 * len(queries) * (cells.sizes > 0).sum()


def terms(text):
    counts = Counter(re.findall(r"\w+", text.lower()))
    norm = math.sqrt(sum(n * n for n in counts.values()))
    return {t: n / norm for t, n in counts.items()}


WORDS = "alpha beta Gamma délta 5 the the the x_y".split()


def texts(rng, n):
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 12))) + rng.choice(["", ".", " - "]) for _ in range(n)]


def test_term_vectors(spark):
    docs = list(enumerate(texts(random.Random(2), 100)))
    vectors = similarity.term_vectors(spark.createDataFrame(docs, "d int, text string"), "d", "text")
    found = {(r.d, r.token): r.weight for r in vectors.collect()}
    expected = {(d, t): w for d, text in docs for t, w in terms(text).items()}
    assert found == pytest.approx(expected)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_sparse(spark, strategy):
    rng = random.Random(4)
    docs, asked = dict(enumerate(texts(rng, 200))), dict(enumerate(texts(rng, 15)))
    expected = set()
    for q, text in asked.items():
        query = terms(text)
        scored = sorted((-round(sum(w * query.get(t, 0.0) for t, w in terms(d).items()), 6), c) for c, d in docs.items())
        expected |= {(q, c, -s + 0.0, n) for n, (s, c) in enumerate(scored[:3], 1)}
    found = run(
        similarity.term_arrays(spark.createDataFrame(list(asked.items()), "q int, text string"), "q", "text"),
        similarity.term_arrays(spark.createDataFrame(list(docs.items()), "c int, text string"), "c", "text"),
        3, strategy,
    )
    assert {(q, c, n) for q, c, _, n in found} == {(q, c, n) for q, c, _, n in expected}
    assert sorted(s for _, _, s, _ in found) == pytest.approx(sorted(s for _, _, s, _ in expected), abs=1e-6)


def test_normalized_splits_off_bad_vectors(spark):
    frame = spark.createDataFrame(
        [(1, [3.0, 4.0]), (2, []), (3, None), (4, [0.0, 0.0])], "id int, embedding array<float>"
    )
    good, bad = similarity.normalized(frame)
    assert {r.id: r.embedding for r in good.collect()} == {1: pytest.approx([0.6, 0.8]), 4: [0.0, 0.0]}
    assert {r.id for r in bad.collect()} == {2, 3}


def test_centroids(spark):
    frame = spark.createDataFrame(
        [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -2.0])], "label int, embedding array<float>"
    )
    found = {r.label: r.embedding for r in similarity.centroids(frame, "label").collect()}
    assert found == {1: pytest.approx([0.5**0.5, 0.5**0.5]), 2: [0.0, -1.0]}
