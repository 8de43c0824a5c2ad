import pytest

from noteloom.functions import markdown as md


@pytest.mark.parametrize("text,titles,want", [
    ("Sparkline und Spark!", ["Spark"], "Sparkline und [[Spark]]!"),
    ("См. [[RAG|алиас]] и RAG.", ["RAG"], "См. [[RAG|алиас]] и RAG."),
    ("Большой словарь и словарь.", ["словарь", "Большой словарь"], "[[Большой словарь]] и [[словарь]]."),
    ("> цитата RAG\nwww.x/RAG $$RAG$$", ["RAG"], "> цитата [[RAG]]\nwww.x/RAG $$RAG$$"),
    ("```\ncode\nRAG", ["RAG"], "```\ncode\nRAG"),
    ("# RAG\n> [!note] RAG\n| RAG |\n```\nRAG\n```\n`RAG` https://x/RAG $RAG$\nпро RAG и RAG", ["RAG"], "# RAG\n> [!note] RAG\n| RAG |\n```\nRAG\n```\n`RAG` https://x/RAG $RAG$\nпро [[RAG]] и RAG"),
    ("", ["x"], ""),
])
def test_links(text, titles, want):
    assert md.with_links(text, titles) == want
    assert md.with_links(want, titles) == want


@pytest.mark.parametrize("text,want", [
    ("Это однoмерная выборка.", "Это одномерная выборка."),
    ("spark, RowGroup и столбецQ.", "spark, RowGroup и столбецQ."),
    ("`однoмерная` и a‑b", "`однoмерная` и a-b"),
    ("```\nоднoмерная\n```\nоднoмерная", "```\nоднoмерная\n```\nодномерная"),
])
def test_lookalikes(text, want):
    assert md.without_lookalikes(text) == want


def test_columns(spark):
    df = spark.createDataFrame([("1,3-5", "é RAG", ["RAG"]), ("5-3,1", None, None), ("1,x", "", []), ("0", "a", ["a"]), ("1-999999999", "", [])], "s string, t string, l array<string>")
    rows = df.select(md.selection(df.s, 5).alias("s"), md.linked(df.t, df.l).alias("l"), md.nfc(df.t).alias("n"), md.glitch_free(df.t).alias("g")).collect()
    assert [r.s for r in rows] == [[4, 3, 2, 0], [4, 3, 2, 0], None, None, None]
    assert rows[0].l == "é [[RAG]]" and rows[0].n == "é RAG" and rows[1].l is None and rows[3].l == "[[a]]"


@pytest.mark.parametrize("text,want", [
    ("x" * 40 + "\n\n" + "y" * 39, 1), ("- a\n- b\n\n- c\n\n" + "z" * 50, 2), ("```\n\na\n```\n\n| a |\n|---|\n| b |", 2),
    ("> " + "q" * 60 + "\n> more\n\n# " + "h" * 60, 0), ("short\nlines " + "w" * 40, 1), ("", 0), ("1. a\n\n   " + "k" * 50 + "\n\nend", 1),
])
def test_content_blocks(text, want):
    assert md.content_blocks_of(text, 40, "_none_") == want
