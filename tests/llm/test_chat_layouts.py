import json

import pytest
from noteloom.llm import chat_format as cf
from noteloom.llm import queries


def parts(spark, record):
    r = cf.format_records(spark.createDataFrame([(json.dumps(record),)], "record string")).first()
    return None if r.turns is None else [tuple(t) for t in r.turns]


@pytest.mark.parametrize("record,turns", [
    ({"id": 1, "meta": {"source": {"url": "u"}}, "messages": [{"role": "user", "content": "a", "name": "n"}]}, [("user", "a")]),
    ({"messages": [], "source": "s"}, []),
    ({"messages": [], "prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "b", "output": "c", "id": 3}, [("user", "a\n\nb"), ("assistant", "c")]),
    ({"prompt": '[{"a": 1}]', "completion": '{"b": 2}'}, [("user", '[{"a": 1}]'), ("assistant", '{"b": 2}')]),
    ({"prompt": "\ud800x", "completion": 1, "\udc00": 0}, [("user", "?x"), ("assistant", "1")]),
    ({"data": {"messages": [{"role": "user", "content": "a"}]}}, None),
])
def test_required_paths(spark, record, turns):
    assert parts(spark, record) == turns


def test_fingerprints_see_nested_objects(spark):
    records = [{"a": {"b": {"c": 1}}}, {"a": {"b": {"d": 1}}}, {"a": {"b": {"c": 2}}}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "record string")
    marks = [r.f for r in df.select(cf.record_fingerprint(df.record).alias("f")).collect()]
    assert marks[0] == marks[2] == cf.fingerprint(["a.b.c"]) and marks[1] == cf.fingerprint(["a.b.d"])


def test_the_query_goes_through_the_mappings(spark, monkeypatch):
    used = []
    real = cf.canonical_turns
    monkeypatch.setattr(cf, "canonical_turns", lambda *a: used.append(1) or real(*a))
    queries.op3_chat_format(spark, "/root/testdata/sf0.001")
    assert used


def test_turn_rows_come_in_several_layouts_and_all_read_back(spark):
    from pyspark.sql import functions as F

    roles = ["user", "assistant", "system", "Assistant", "human", "GPT", "", None, "a\nb"]
    texts = ["a", "", None, '{"messages": []}', "  \\ \" </s>", "x" * 5000]
    rows = [(c, t, r, x) for c in (-3, 0, 1, 2, 3, 7, None) for t, r in enumerate(roles) for x in texts]
    df = spark.createDataFrame(rows, "c long, t long, r string, x string").withColumn("record", cf.layout_record(F.col("c"), F.col("t"), F.col("r"), F.col("x")))
    got = df.withColumn("mark", cf.record_fingerprint(F.col("record"))).withColumn("turns", cf.canonical_turns(F.col("record"))).collect()
    assert all([(t.role, t.text) for t in g.turns] == [(g.r or "", g.x or "")] for g in got)
    assert len({g.mark for g in got}) == 4
    assert len({cf.chosen(cf.paths_of(cf.parsed(g.record)), cf.MAPPINGS).name for g in got}) == 4
