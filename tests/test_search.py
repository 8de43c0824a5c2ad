import math
import random
from collections import Counter

import pytest

from noteloom.operators import retrieval


def split(text):
    return (text or "").replace("/", " ").replace("-", " ").lower().split()


def brute(notes, queries, k):
    docs = {p: split(t) for p, t in notes}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if r < 0 else r for t, r in raw.items()}
    out = set()
    for q, text in queries:
        scores = []
        for path, d in docs.items():
            tf = Counter(d)
            s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / (average or 1))) for t in split(text) if t in tf)
            scores.append((-round(s, 6) + 0.0, path))
        out |= {(q, p, r, round(-s, 4) + 0.0) for r, (s, p) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 900, 1 << 15), (2, 300, 40), (3, 3, 100), (4, 40, 100)])
def test_search_is_the_brute_force_one(spark, seed, n, block):
    rng = random.Random(seed)
    words = lambda m: " ".join(rng.choice(["common", f"w{int(rng.paretovariate(0.7))}", "a-b/C", "Слово"]) for _ in range(m))
    notes = [(f"n{rng.randrange(10**6)}-{i}.md", words(rng.randrange(30))) for i in range(n)]
    notes += [(f"same{i}.md", "w1 w2 w3") for i in range(n // 10)] + [("null.md", None)]
    queries = [(i, words(rng.randrange(6))) for i in range(25)] + [(90, None), (91, "unknown"), (92, "common common")]
    got = retrieval.bm25(
        spark.createDataFrame(notes, "path string, text string").repartition(3), spark.createDataFrame(queries, "query_id long, query string"), 7, block=block, one_in=5
    )
    assert {(r.query_id, r.path, r["rank"], round(r.score, 4) + 0.0) for r in got.collect()} == brute(notes, queries, 7)


def test_search_over_nothing(spark):
    notes, queries = spark.createDataFrame([("a", "x")], "path string, text string"), spark.createDataFrame([("q", "x")], "query_id string, query string")
    assert retrieval.bm25(notes.limit(0), queries, 3).count() == 0 and retrieval.bm25(notes, queries.limit(0), 3).count() == 0
    assert [tuple(r)[:2] for r in retrieval.bm25(notes, queries, 3).collect()] == [("q", "a")]


def test_runs_below_the_bound_are_skipped():
    import numpy as np

    n = 4096
    rows, terms = np.arange(n), np.arange(n) % 32
    tf = np.where(rows % 512 == 0, 5.0, 1.0)
    index = retrieval.TermBlock([f"{i:05d}" for i in range(n)], np.full(n, 4.0), rows, terms, tf, np.ones(32), 4.0, 1.5, 0.75)
    seen = []
    scores = index.scores
    index.scores = lambda t, allowed: (seen.append(int(allowed.sum())), scores(t, allowed))[1]
    assert [p for p, _ in index.best([(0, 1)], 3, -np.inf)] == ["00000", "00512", "01024"] and max(seen) < 6


def test_queries_go_through_a_block_together():
    """Each query has what it has alone, also one without a known term, and none makes calls of its own."""
    import numpy as np

    rng = np.random.default_rng(1)
    n, pairs = 500, np.unique(rng.integers(0, 500 * 40, 4000))
    index = retrieval.TermBlock([f"{i:05d}" for i in range(n)], rng.integers(1, 30, n).astype(float), pairs // 40, pairs % 40, rng.integers(1, 4, len(pairs)).astype(float), rng.random(45), 9.0, 1.5, 0.75)
    lists = [sorted({int(t): int(m) for t, m in zip(rng.integers(0, 45, 6), rng.integers(1, 3, 6), strict=True)}.items()) for _ in range(150)] + [[(42, 1)], []]
    flat = np.array([p for x in lists for p in x])
    least = np.where(np.arange(len(lists)) % 3 == 0, 0.8, -np.inf)
    asked = retrieval.Queries(np.cumsum([0, *map(len, lists)]), flat[:, 0], flat[:, 1])
    calls, scores = [], index.scores
    index.scores = lambda *x: (calls.append(1), scores(*x))[1]
    numbers, rows, score = index.best_of_each(asked, 4, least)
    assert len(calls) <= 2 * -(-len(lists) // 64)
    got = [[(index.paths[i], float(x)) for i, x in zip(rows[numbers == q], score[numbers == q], strict=True)] for q in range(len(lists))]
    assert got == [index.best(x, 4, least[q]) for q, x in enumerate(lists)]
    assert [p for p, _ in got[150]] == ([] if 150 % 3 == 0 else sorted(index.paths)[:4]) and len(got[151]) == 4
