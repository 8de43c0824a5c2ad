import numpy as np
import pytest

from noteloom.llm import decontamination as dc
from noteloom.llm.fm_index import FMIndex, suffix_ranks


@pytest.mark.parametrize("seed", range(12))
def test_index_finds_all_places(seed):
    rng = np.random.default_rng(seed)
    text = np.r_[rng.integers(0, 4, rng.integers(1, 300)), 0]
    if seed == 0:
        text = np.r_[np.tile([1, 2, 3, 0], 50), 0]
    index = FMIndex(text, 4)
    for length in (1, 2, 3, 5):
        patterns = rng.integers(1, 4, (30, length))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_ranks_are_a_permutation():
    text = np.array([1, 1, 1, 0, 1, 1, 1, 0, 2, 1, 1, 0])
    assert sorted(suffix_ranks(text).tolist()) == list(range(12))


def brute(docs, items, width=10):
    out = []
    for doc_id, text in docs:
        words, hit, names = dc.words_of(text), set(), set()
        for item, phrase in items:
            w = dc.words_of(phrase)
            for i in range(max(min(len(w), 1), len(w) - width + 1)):
                p = w[i : i + width]
                for j in range(len(words) - len(p) + 1):
                    if words[j : j + len(p)] == p:
                        hit |= set(range(j, j + len(p)))
                        names |= set() if item is None else {str(item)}
        out.append((doc_id, len(words), len(hit), sorted(names)))
    return out


LONG = " ".join(f"w{i % 17}é" for i in range(25))
ITEMS = [(1, LONG), (2, "Short One"), (3, ""), (4, None), (10, LONG), (None, "null item"), (5, "a b c d e f g h i j k")]
DOCS = [
    (1, LONG.upper().replace("É", "é")),
    (2, "x short, one! y short-one"),
    (3, None),
    (4, ""),
    (5, "zz " * 3000 + "a b c d e f g h i j zz b c d e f g h i j k" + " zz" * 50),
    (6, "a b c d e f g h i"),
    (6, "short one"),
    (None, "null item short one"),
    (7, "nothing here"),
]


@pytest.mark.parametrize("shard_words,block_bytes", [(1 << 20, 8 << 20), (5, 8 << 20), (40, 60)])
def test_scan_equals_brute_force(spark, shard_words, block_bytes):
    docs = spark.createDataFrame([(*d, "old") for d in DOCS], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = dc.scan(docs, bench, shard_words=shard_words, block_bytes=block_bytes).collect()
    got = [(r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in out]
    assert sorted(got, key=str) == sorted(brute(DOCS, ITEMS), key=str)
    for r in out:
        assert sum(s.end - s.start for s in r.hit_words) == r.n_hit
    cut = {r.doc_id: r.text for r in dc.scan(docs, bench, remove=True).collect()}
    assert cut[2] == "x ! y " and cut[7] == "nothing here" and cut[3] is None
    assert cut[5].split() == ["zz"] * 3051


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in dc.scan(docs, none).collect()} == {0}
    assert dc.scan(docs.limit(0), none).count() == 0
