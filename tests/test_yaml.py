import datetime

import pytest

from noteloom.functions import yaml as ym
from noteloom.sources import notes as ns

CASES = [
    ("a: 1\nb: x y", {"a": 1, "b": "x y"}), ("", None), ("# only\n", None), ("a:\nb: ~\nc: null", {"a": None, "b": None, "c": None}),
    ("tags:\n- a\n- b: 1\n  c: 2\n- - x\n  - y\n-\n  z: 1", {"tags": ["a", {"b": 1, "c": 2}, ["x", "y"], {"z": 1}]}),
    ("m:\n  k:\n    deep: true\n  l:\n  - 1.5\n  - no\nn: 2", {"m": {"k": {"deep": True}, "l": [1.5, False]}, "n": 2}),
    ("d: 2024-05-01\nq: '2024-05-01'", {"d": "2024-05-01", "q": "2024-05-01"}),
    ("tags: ['a: b', \"c # d\", e#f, g]", {"tags": ["a: b", "c # d", "e#f", "g"]}), ("u: https://x.y/z#t # note", {"u": "https://x.y/z#t"}),
    ("s: 'it''s'\nt: \"a\\n\\u00e9\\\"\"", {"s": "it's", "t": 'a\né"'}), ("f: {a: 1, 'b': [x, {c: d}], e}", {"f": {"a": 1, "b": ["x", {"c": "d"}], "e": None}}),
    ("l: |\n  one\n   two\n\n  three\n\nk: >-\n  a\n  b\n\n  c\n", {"l": "one\n two\n\nthree\n", "k": "a b\nc"}), ("l: |+\n  a\n\n", {"l": "a\n\n\n"}), ("p: one\n  two\n\n  three", {"p": "one two\nthree"}),
    ('q: "one\n  two"\nr: [a,\n  b]', {"q": "one two", "r": ["a", "b"]}), ("'k 1': v\n\"k:2\": w\nключ: да", {"k 1": "v", "k:2": "w", "ключ": "да"}), ("a:\r\n- x\r\n", {"a": ["x"]}), ("- a\n- b", ["a", "b"]),
    ("empty: []\nm: {}", {"empty": [], "m": {}}), ("a: -1\nb: +2\nc: 1_000\nd: 012\ne: .5\nf: 1e3", {"a": -1, "b": 2, "c": 1000, "d": "012", "e": 0.5, "f": "1e3"}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_reads(text, want):
    assert ym.read(text) == want


@pytest.mark.parametrize("text", ["a: [1, 2", "a: 'x", "a: &x 1", "a:\n  b: 1\n c: 2", "a: b\n\tc: d", "a: |9x\n  t", "a: [1] x", "{[a]: 1}"])
def test_refuses(text):
    with pytest.raises(ym.Unreadable):
        ym.read(text)
    assert ym.json_of(text) is None


def test_written_front_matter_reads_back(spark):
    tags = ["plain", "a: b", "#x", "x #y", "true", "12", "2024-01-01", "кот", "it's", "- d", "[l]", "tab\tq", 'q"uo\\te', "é", " lead", "end:", "null", "domain/тема", "line\nend"]
    rows = [(t, tags, "2024-05-01", s, "body [[X]]\n") for t, s in (("Title: one # two", "model-knowledge"), ("да", "a: b"), ("'quoted'", ""), ("multi\nline", "x"), ("100", "~"))]
    df = spark.createDataFrame(rows, "title string, tags array<string>, created string, source string, body string")
    from pyspark.sql import functions as F

    raw = ns.rendered(df.title, df.tags, df.created, df.source, df.body, F.array().cast("array<string>"), F.lit(False), F.array(F.lit("https://a")))
    out = ns.parse_notes(df.select(F.concat("title", F.lit(".md")).alias("path"), raw.alias("raw_content"), "source", F.col("title").alias("was")).drop("was"))
    for (title, _, created, source, _), r in zip(rows, out.collect(), strict=True):
        assert r.title == title and r.tags == sorted({t.lstrip("#") for t in tags}) and r.frontmatter["created"] == created and r.frontmatter.get("source", "") == source
        assert r.body == "\n## Источники\n\n- https://a\n\nbody [[X]]\n" and r.outlinks == ["X"]
    assert datetime.date.fromisoformat(rows[0][2])


def test_nested_front_matter_is_a_variant(spark):
    text = "---\ntitle: T\nmeta:\n  k: [1, {x: y}]\ntags: solo\n---\nbody"
    df = spark.createDataFrame([("a.md", text), ("b.md", "---\n: [\n---\nbody"), ("c.md", "no front"), ("d.md", "---\n- list\n---\nx"), ("e.md", None)], "path string, raw_content string")
    got = {r.path: r for r in ns.parse_notes(df).selectExpr("*", "try_variant_get(front, '$.meta.k[1].x', 'string') x").collect()}
    assert got["a.md"].x == "y" and got["a.md"].tags == ["solo"] and got["a.md"].frontmatter["meta"] == '{"k":[1,{"x":"y"}]}'
    assert [got[p].title for p in ("b.md", "c.md", "d.md")] == ["b", "c", "d"] and got["b.md"].frontmatter == {} and got["b.md"].body == "body" and got["e.md"].tags in ([], None)
