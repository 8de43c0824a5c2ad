import random

import numpy as np
import pytest

from noteloom.llm import jaccard_join as jj
from noteloom.llm.shingles import shingle_sets


def exact(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width=3, percent=90):
    sets = [exact(t, width) for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for (i, _), a in zip(rows, sets, strict=True):
            for (j, _), b in zip(rows, sets, strict=True):
                if i is None or j is None or not a or not b or 100 * len(a & b) < percent * len(a | b):
                    continue
                low = min(label[i], label[j])
                changed |= label[i] != low or label[j] != low
                label[i] = label[j] = low
    return sorted(((i, len(s), label.get(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    line = " ".join(rng.choices(words, k=45))
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([2, 3, 20, 70, 130]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = " ".join(copy)
            rows.append((n, text.upper() if rng.random() < 0.2 else text))
            n += 1
    rows += [(n + k, line + f" x{k} y{k}") for k in range(8)]
    rows += [(n + 20, None), (n + 21, ""), (n + 22, " \n"), (n + 23, "one"), (n + 24, "one"), (n + 25, "One\ttwo"), (n + 26, "one two")]
    rows += [(None, rows[0][1]), rows[3], rows[3], (n + 30, "é È\x0bü\x85 a b c"), (n + 31, "é È\x0bü\x85 a b c ")]
    return rows


def test_sets_match_the_words():
    texts = [t for _, t in corpus(1)]
    for text, got in zip(texts, shingle_sets(texts, 3), strict=True):
        assert len(got) == len(exact(text)) and (np.diff(got.astype(object)) > 0).all()
    a, b = shingle_sets(["a b c d", "x a b c"], 3)
    assert len(np.intersect1d(a, b)) == 1


@pytest.mark.parametrize("seed", range(30))
def test_links_in_a_group(seed):
    rows = [(i, t) for i, t in corpus(seed) if i is not None and exact(t)]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = dict(jj.linked([i for i, _ in rows], shingle_sets([t for _, t in rows], 3), 90))
    assert {(i, got.get(i, i)) for i, _ in rows} == {(i, c) for i, _, c in brute(rows)}


@pytest.mark.parametrize("limits", [{}, {"group_docs": 3}, {"group_docs": 1, "width": 2, "percent": 60}])
def test_components_equal_brute_force(spark, limits):
    rows = corpus(7)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n int")
    got = sorted((tuple(r) for r in jj.jaccard_components(docs, **limits).collect()), key=str)
    assert got == brute(rows, limits.get("width", 3), limits.get("percent", 90))


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, ""), (8, c), (2, c), (9, c), (9, c), (9, None), (4, None)]
    got = {(r.doc_id, r.component_id) for r in jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3), (5, 3), (7, 3), (8, 2), (2, 2), (9, 2), (4, 4)}


def test_large_blocks_meet_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(jj, "HUBS", 2)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(60)]
        for k in range(30):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(60)] = f"x{rng.randrange(50)}"
            rows.append((family * 100 + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jj.jaccard_components(docs, width=1, percent=80, group_docs=7).collect()), key=str)
    assert got == brute(rows, 1, 80)


def test_packs_of_one_text_each(spark, monkeypatch):
    monkeypatch.setattr(jj, "PACK_BYTES", 1)
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jj.jaccard_components(docs, width=3, percent=80).collect()), key=str)
    assert got == brute(rows, 3, 80)


def test_empty_table(spark):
    assert jj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
