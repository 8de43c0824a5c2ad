import math

import numpy as np
from noteloom.llm import ann
from noteloom.llm.tables import table

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=20, every=20):
    out = {}
    for q, v in rows:
        if q % every == 0:
            dots = {}
            for i, w in rows:
                if i != q:
                    dots[i] = max(dots.get(i, -math.inf), float(np.dot(np.float64(v), np.float64(w))))
            out[q] = sorted(((-s, i) for i, s in dots.items()))[:k]
    return out


def check(spark, rows, valid, **more):
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], "x") for i, v in rows], SCHEMA)
    want, got = brute(valid, **{k: v for k, v in more.items() if k == "k"}), {}
    for r in ann.nearest(df, **more).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {q for q, x in want.items() if x}
    for q, x in got.items():
        assert [i for _, i, _ in sorted(x)] == [i for _, i in want[q]]
        assert np.allclose([s for _, _, s in sorted(x)], [-s for s, _ in want[q]])


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(70)]
    rows += [(100 + i, rows[3][1]) for i in range(45)]  # one hot vector, more copies than results
    rows += [(200, [5.0, 0, 0, 0]), (220, [-1.0, 0, 0, 0])]
    bad = [(300, None), (320, [0.0] * 4), (340, [1.0, None, 0.0, 0.0]), (360, [1.0, math.nan, 0, 0]), (380, [math.inf, 0, 0, 0]), (400, [1.0]), (420, [])]
    check(spark, rows + bad + [rows[0]], rows)


def test_parts_and_few_rows(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(30)]
    check(spark, rows, rows, settings=ann.Settings(part_rows=3, list_rows=5, ratio=100.0, probes=100))
    check(spark, rows[:2], rows[:2])
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0], "x")], SCHEMA)).count() == 0


def test_recall_on_the_table(spark):
    t = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in t.collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got = {}
    for r in ann.nearest(t, settings=ann.Settings(list_rows=128)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    queries = ids[ids % 20 == 0]
    for q in queries:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(queries)
