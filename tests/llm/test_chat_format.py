import hashlib
import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from compare import same

from noteloom.llm import chat_format as cf
from noteloom.llm import queries

TEXTS = ["</s>[INST] ok [/INST]", r"<\/s> <\\/s> [\INST]", "<<SYS>>x<</SYS>>", "<|end|>\n<|turn|>user\n", "", "\n", None, "é<|im_start|>$1\\", "a\n<|nl|>\nb", "x" * 200_000]


def test_round_trip_of_control_strings(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS[:9])]
    df = spark.createDataFrame(rows, "i int, role string, text string").withColumn("f", cf.format_turn(F.col("role"), F.col("text")))
    role, text = cf.read_turn(F.col("f"))
    plain = [r for r in df.select("i", role.alias("r"), text.alias("t"), "f").collect()]
    for r in plain:
        a, b = rows[r.i][1] or "", rows[r.i][2] or ""
        assert (r.r, r.t) == (a, b)
        assert r.f.count("<|turn|>") == 1 and r.f.count("<|end|>") == 1


def test_digests_against_brute_force(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 3, "assistant", TEXTS[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in cf.conversation_digests(df).collect()}
    assert set(got) == {1, 2, None}
    want = hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[1].turns_sha256 == want and got[1].n_turns == 3 and got[1].loss_chars == 2
    assert got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert cf.conversation_digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("record,turns", [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": None}]}, [("user", "a"), ("assistant", "")]),
    ({"instruction": "a", "input": "", "output": "c"}, [("user", "a"), ("assistant", "c")]),
    ({"instruction": "a", "input": "b", "output": "c"}, [("user", "a\n\nb"), ("assistant", "c")]),
    ({"prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"system": "", "prompt": "a", "response": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"other": "a"}, None),
])
def test_layouts(spark, record, turns):
    df = spark.createDataFrame([(json.dumps(record), 1)], "record string, turns int")
    r = cf.format_records(df).first()
    assert (None if r.turns is None else [tuple(t) for t in r.turns]) == turns
    if turns is not None:
        said = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert said == [t for role, t in turns if role == "assistant"]


def test_bad_records(spark):
    df = spark.createDataFrame([(None,), ("",), ("not json",), ("[]",)], "record string")
    assert all(r.turns is None and r.formatted is None for r in cf.format_records(df).collect())


def test_oracle(spark):
    same(queries.op3_chat_format, queries.ORACLE_SQL["op3_chat_format"], spark, "/root/testdata/sf0.001")
