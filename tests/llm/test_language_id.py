import itertools
import math

import numpy as np
from noteloom.llm import language_id as li
from noteloom.llm import queries
from noteloom.llm.tables import tokenizer_file

PIECES = {p: k for k, p in enumerate(["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "abb"])}


def segmentations(word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        out, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(word[last:i])
                last = i
        yield [*out, word[last:]]


def probability(word, column):
    total, expected = 0.0, np.zeros(len(PIECES) + 1)
    for seg in segmentations(word):
        ids = [PIECES.get(p, len(PIECES) if len(p) == 1 else None) for p in seg]
        if None not in ids:
            p = math.prod(column[i] for i in ids)
            total += p
            for i in ids:
                expected[i] += p
    return total, expected / total


def test_forward_and_expected_counts_sum_all_segmentations():
    rng = np.random.default_rng(0)
    table = rng.random((len(PIECES) + 1, 3))
    words = ["▁", "▁ab", "▁abba", "▁xab", "▁babbab", "▁ab"]
    lattice = li.Lattice(PIECES)
    got = lattice.forward(words, table)
    for k, w in enumerate(words):
        for lang in range(3):
            assert math.isclose(got[k, lang], math.log(probability(w, table[:, lang])[0]))
    counts = rng.integers(0, 4, (len(words), 3)).astype(float)
    want = np.zeros_like(table)
    for k, w in enumerate(words):
        for lang in range(3):
            want[:, lang] += counts[k, lang] * probability(w, table[:, lang])[1]
    assert np.allclose(lattice.expected(words, counts, table), want)


def test_scorer_edges():
    model = li.learn([("x", "▁ab", 5), ("y", "▁ba", 5)], PIECES)
    scorer = li.Scorer(model, most=1)
    texts = ["ab ab", "BA, ba!", None, "", "123 _ $", "ab " * 5000, "ab" * 400, "zz"]
    got = list(scorer(texts))
    assert [x for x, _ in got] == ["x", "y", "und", "und", "und", "x", got[6][0], got[7][0]]
    assert all(0 <= s <= 1 for _, s in got)
    assert list(li.Scorer(li.Model([], PIECES, np.ones((9, 0))))(["ab"])) == [("und", 0.0)]


def test_held_out_accuracy(spark):
    out = queries.op5_piece_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "ab", "x", "s"), (1, "ab", "x", "s"), (None, None, None, "s"), (3, "ba", "y", "s"), (4, "ba", None, "s")], "doc_id long, text string, lang string, score string")
    model = li.fit(docs)
    assert model.languages == ["x", "y"]
    got = li.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted(r.lang_pred for r in got.collect()) == ["und", "x", "x", "y", "y"]
    assert li.identify(docs.limit(0), li.fit(docs.limit(0))).count() == 0


def test_words_below_double_precision_keep_their_scores():
    """As after a fit on millions of words: rare letters of long words cost less than 1e-308 in all."""
    lattice = li.Lattice({"▁": 0, "q": 1, "z": 2, "qz": 3, "the": 4})
    table = np.array([[1e-9, 2e-9], [3e-9, 1e-10], [1e-9, 4e-10], [1e-12, 1e-11], [0.5, 0.4], [1e-14, 1e-15]])
    words = ["▁" + "qz" * 20, "▁the", "▁" + "q" * 36, "▁" + "ж" * 39, "▁" + "qz" * 30]
    got = lattice.forward(words, table)
    want = [lattice.log_sums(len(w), lattice.pieces_in(w), np.log(table))[-1] for w in words]
    assert np.isfinite(got).all() and np.allclose(got, want)
    counts = np.ones((len(words), 2))
    spread = lattice.expected(words, counts, table)
    alone = sum(lattice.expected([w], np.ones((1, 2)), table) for w in words)
    assert np.isfinite(spread).all() and np.allclose(spread, alone)
    assert np.allclose(spread[5], 39) and np.all(spread.sum(axis=0) >= 5)


def test_scores_of_a_large_fit_are_numbers(spark):
    words = [(lang, word, 400_000) for lang, many in (("de", "der die und katze"), ("en", "the a and cat")) for word in ["▁" + w for w in many.split()] for _ in range(5)]
    model = li.learn(words, li.vocabulary(tokenizer_file("piece_bpe_32k.model")))
    df = spark.createDataFrame([(1, "the cat " + "qz" * 20), (2, "die katze " + "ъq" * 20), (3, "qz" * 20)], "doc_id long, text string")
    got = {r.doc_id: r for r in li.identify(df, model).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
