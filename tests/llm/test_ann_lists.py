import numpy as np
from noteloom.llm import ann


def test_the_ratio_alone_prunes():
    rng = np.random.default_rng(4)
    settings = ann.Settings()
    points = rng.normal(size=(1600, 64))
    points[1200:] += 40  # a cluster apart, which the graph ties to nothing else
    lists = ann.Lists(points.astype(np.float32), settings)
    for query in rng.normal(size=(4, 64)).astype(np.float32):
        away = ((lists.centroids - query) ** 2).sum(axis=1)
        want = np.flatnonzero(away <= away.min() * settings.ratio**2)
        got = lists.probe(query)
        assert set(got) == set(want.tolist()) and (np.diff(away[got]) >= 0).all()
    wide = ann.Lists(points.astype(np.float32), ann.Settings(ratio=100.0))
    assert len(wide.probe(points[0].astype(np.float32) + 1)) == 1600


def test_recall_of_more_than_512_lists(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, every=100, settings=ann.Settings(list_rows=6, ratio=4.0)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits, exact = 0, x.astype(float)
    for q in range(0, 9000, 100):
        s = exact @ exact[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.95 * 20 * 90
