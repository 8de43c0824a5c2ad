import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from test_decontamination import brute as hits_of
from test_jaccard_join import brute as groups_of
from pyspark.sql import functions as F
from test_secret_scan import base

import corpus_pipeline as cp
from noteloom.llm.tables import table

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(900_001, None, "en", "x", 0), (900_002, "123 !!", "en", "x", 6), (None, "no id here", "en", "x", 10)], docs.schema)
    docs = docs.unionByName(extra)
    all_ = [(r.doc_id, r.text) for r in docs.collect()]
    first = cp.language_stage(spark, docs, SF)
    kept = [(r.doc_id, r.text) for r in first.collect()]
    assert sorted(kept, key=str) == sorted([x for x in all_ if x[0] not in (900_001, 900_002)], key=str)
    second = cp.near_duplicate_stage(spark, first, SF)
    want = {i for i, _, c in groups_of(kept) if i == c or i is None}
    assert {r.doc_id for r in second.collect()} == want and second.count() == len(want)
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    third = cp.decontamination_stage(spark, second, SF)
    found = {i: (w, h) for i, w, h, _ in hits_of([(r.doc_id, r.text) for r in second.collect()], bench)}
    after = {r.doc_id: r.text for r in third.collect()}
    before = {r.doc_id: r.text for r in second.collect()}
    assert set(after) == {i for i, (w, h) in found.items() if h == 0 or h < w}
    assert any(h for _, h in found.values())
    for i, text in after.items():
        assert (text == before[i]) == (found[i][1] == 0)
    fourth = cp.secret_stage(spark, third, SF)
    clean = {r.doc_id: r for r in fourth.collect()}
    assert fourth.columns == cp.COLUMNS and set(clean) == set(after)
    for i, r in clean.items():
        assert r.n_chars == len(r.text)
        assert not base(r.text) and (r.text == after[i] or base(after[i]) or "[SECRET]" in r.text)
    pieces = cp.packing_stage(spark, fourth, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(clean)


def test_run_is_the_stages_in_turn(spark):
    out = cp.run(spark, SF)
    assert out.columns[:2] == ["doc_id", "start"] and out.count() > 0


def test_the_language_found_decides_the_sequences(spark):
    """Wrong and missing languages are replaced, and no sequence holds two."""
    docs = table(spark, SF, "documents").orderBy("doc_id").limit(200)
    given = {r.doc_id: r.lang for r in docs.collect()}
    some = sorted(i for i, lang in given.items() if lang is not None)
    lost, wrong = some[5], some[11]
    other = next(x for x in given.values() if x and x != given[wrong])
    odd = F.when(F.col("doc_id") == lost, None).when(F.col("doc_id") == wrong, other).otherwise(F.col("lang"))
    first = cp.language_stage(spark, docs.withColumn("lang", odd), SF)
    langs = {r.doc_id: r.lang for r in first.collect()}
    assert langs[lost] == given[lost] and langs[wrong] == given[wrong]
    pieces = cp.packing_stage(spark, first.repartition(1), SF).collect()
    held = {}
    for r in pieces:
        assert r.lang == langs[r.doc_id]
        held.setdefault(r.sequence_id, set()).add(r.lang)
    assert all(len(x) == 1 for x in held.values()) and len(set().union(*held.values())) > 1
    assert {r.doc_id for r in pieces} == set(langs)


def test_without_a_language_to_learn_the_given_one_stays(spark):
    docs = spark.createDataFrame([(1, "words here", None, "x", 10), (3, "12 34", None, "x", 5)], table(spark, SF, "documents").schema)
    assert [(r.doc_id, r.lang) for r in cp.language_stage(spark, docs, SF).collect()] == [(1, None)]
