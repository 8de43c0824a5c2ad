import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, *pairs):
    return spark.createDataFrame([(i, t, None, "x", len(t or "")) for i, t in pairs], SCHEMA)


def test_documents_stay_where_no_language_was_learned(spark):
    docs = rows(spark, (1, "plain words"), (2, "né"), (3, "123 _ !"), (4, None), (5, ""), (None, "слово"))
    assert sorted(r.text for r in cp.language_stage(spark, docs, "").collect()) == ["né", "plain words", "слово"]


def test_repeated_ids_lose_only_equal_texts(spark):
    docs = rows(spark, (1, "one text"), (1, "another text"), (1, "one text"), (None, "no id"), (None, "no id"), (None, "other"))
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicate_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, "one text"), (1, "another text"), (None, "no id"), (None, "other")], key=str)
