import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from noteloom.llm import dual_tree as dt


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k=10):
    texts = [(d, split(t)) for d, t, *_ in docs]
    texts = [(d, t) for d, t in texts if t]
    n_docs, n_terms = len(texts), sum(len(t) for _, t in texts)
    df = Counter(t for _, terms in texts for t in set(terms))
    wanted = defaultdict(set)
    for i, t, *_ in items:
        wanted[i] |= set(split(t))
    out = []
    for item, terms in wanted.items():
        scores = []
        for doc, own in texts:
            tf, m = Counter(own), 100 - 90 + (90 * len(own) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if t in tf)
            if s > 0:
                scores.append((-s, doc is not None, doc))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(scores[:k], 1)]
    return sorted(map(str, out))


def words(rng, n):
    return " ".join(rng.choice(["a", "b", "The", "the", "Été", "été", "x1", f"w{rng.randrange(40)}", f"v{int(rng.paretovariate(1))}", "你好-ab", "c,d"]) for _ in range(n))


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, score long, item_id string").repartition(4),
        spark.createDataFrame(items, "item_id long, text string, rank int, doc_id string"),
    )


@pytest.mark.parametrize(("seed", "block", "one_in"), [(1, 1 << 20, 64), (2, 1 << 20, 2), (3, 25, 5)])
def test_rows_are_the_brute_force_ones(spark, seed, block, one_in):
    rng = random.Random(seed)
    docs = [(i, words(rng, rng.randrange(60)), 1, "z") for i in range(700)]
    docs += [(i, "the same w1 w2 w3 text", 1, "z") for i in range(2000, 2100)]
    docs += [(None, "the same w1 w2 w3 text", 1, None), (5, None, 1, None), (5, "", 1, None), (7, "w1 w1", 1, None), (7, "w1 w1", 1, None), (8, "!! --", 1, "")]
    items = [(i, words(rng, rng.randrange(12)), 1, "z") for i in range(30)]
    items += [(40, None, 1, "z"), (41, "", 1, "z"), (None, "w5 w6", 1, "z"), (None, "w7", 1, "z"), (42, "unknown", 1, "z"), (3, "w1 w2", 1, "z")]
    out = dt.top_documents(*frames(spark, docs, items), block=block, one_in=one_in)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in out.collect()) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b", 1, "z"), (2, "--", 1, "z")], [(1, "a", 1, "z")])
    assert dt.top_documents(docs.limit(0), items).count() == 0
    assert dt.top_documents(docs, items.limit(0)).count() == 0
    assert dt.top_documents(docs.where("doc_id = 2"), items).count() == 0
    assert [tuple(r) for r in dt.top_documents(docs, items).collect()] == [(1, 1, 1, 287 * (1000000000 // (1000 + 8 * 100)))]


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(dt, "SLICE", 7)
    for text in ("ab cd " * 5, "x" * 40 + " y z", "longlonglong", "", "- - -", "Aé" * 9 + " b"):
        assert [t.decode() for part in dt.terms_of(text.encode()) for t in part] == split(text)
    assert list(dt.terms_of(None)) == []


def test_most_pairs_are_pruned():
    rng = np.random.default_rng(1)
    weights = np.full(400, 5000)
    ids, terms, counts, lengths = [], [], [], []
    for d in range(4096):  # sixteen topics of their own terms
        own = np.unique(rng.integers(0, 24, 12)) + 25 * (d % 16)
        ids.append(d), terms.append(own.astype("<i4").tobytes()), counts.append(np.ones(len(own), "<i4").tobytes()), lengths.append(100)
    rows = [np.unique(rng.integers(0, 24, 6)) + 25 * (i % 16) for i in range(64)]
    items = dt.Items(rows, weights)
    best = dt.Best(np.zeros(64, np.int64), 10)
    scored = dt.Documents(ids, np.array(lengths), terms, counts, weights).search(items, weights, best)
    assert scored < 0.25 * 64 * 4096
    value = 1_000_000_000 // 1800 * 5000
    for item, held in best.held.items():
        wanted = set(rows[items.numbers[item]].tolist())
        every = sorted((-value * len(wanted & set(np.frombuffer(t, "<i4").tolist())), True, d) for d, t in enumerate(terms))
        assert held == every[:10]
