import numpy as np
from noteloom.llm import quality_rules as qr
from noteloom.llm import queries


def test_compiled_rules_score_like_the_model(spark):
    rng = np.random.default_rng(0)
    texts = ["Fine words, in a row. " * rng.integers(1, 9) for _ in range(150)] + ["JUNK!! $$$ ### " * rng.integers(1, 9) for _ in range(150)]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = qr.fit(docs, labels)
    assert model.rules
    values = qr.statistics(docs.text)
    rows = docs.select("doc_id", *[v.alias(k) for k, v in values.items()]).collect()
    x = np.array([[r[k] for k in model.names] for r in rows])
    z = model.bias + sum(w * qr.holds(x, r) for r, w in zip(model.rules, model.weights, strict=True))
    want = {r.doc_id: s for r, s in zip(rows, 1 / (1 + np.exp(-z)), strict=True)}
    for r in qr.score(docs, model).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-9
        assert (r.score >= 0.5) == (r.doc_id < 150)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x " * 90_000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = qr.fit(docs, labels)
    got = [r.score for r in qr.score(docs, model).collect()]
    assert len(got) == 4 and set(got) == {0.5}
    assert qr.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    out = queries.op4_rule_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").collect()
    good = np.array([r.score for r in rows if r.quality == 1])
    bad = np.array([r.score for r in rows if r.quality == 0])
    auc = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    accuracy = np.mean([r.predicted == r.quality for r in rows])
    assert auc > 0.8 and accuracy > 0.88, (auc, accuracy)
