import unicodedata

import pytest
from pyspark.sql import functions as F

from noteloom.functions import text as tx
from noteloom.operators import assembly, drafts


def test_titles_are_compared_composed(spark):
    words = ["Йод и ёж", "Café–Ångström", "naïve", "ǖ", "plain", "", "ἀρχή", "日本", None, " й "]
    df = spark.createDataFrame([(w, w and unicodedata.normalize("NFD", w)) for w in words], "w string, d string")
    for r in df.select("w", tx.normalized_title(F.col("w")).alias("a"), tx.normalized_title(F.col("d")).alias("b"), F.transform(F.array("d"), tx.normalized_title).alias("c")).collect():
        assert r.a == r.b == r.c[0] and (r.w is None or r.a == r.w.strip().replace("–", "-"))


def test_overview_keeps_notes_without_a_description(spark):
    rows = [("T", 0, "create", "A", None), ("T", 1, "create", "B", ""), ("T", 2, "create", "C", "c")]
    df = spark.createDataFrame(rows, "topic string, ord int, action string, title string, description string")
    (r,) = assembly.overview(df, spark.createDataFrame([], "title string")).collect()
    assert r.body == "- [[A]]\n- [[B]]\n- [[C]] — c"


@pytest.mark.parametrize("rows", [[("a.md", "create")], [("x.md", "update")], [("n.md", "create"), ("n.md", "create")]])
def test_conflicting_changesets_are_refused(spark, rows):
    vault = spark.createDataFrame([("a.md", "A")], "path string, content string")
    some = spark.createDataFrame([(p, a, "b", "m") for p, a in rows], "path string, action string, body_md string, append_section string")
    with pytest.raises(ValueError, match="conflicts"):
        drafts.committed(vault, some, spark.createDataFrame([], "path string"), False, True)
