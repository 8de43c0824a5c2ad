"""Text functions on the known cases."""

import pytest
from pyspark.sql import functions as F

from noteloom.functions import text as tx
from noteloom.operators import validation


def value(spark, make, *args):
    df = spark.createDataFrame([args], ", ".join(f"a{i} string" for i in range(len(args)))) if args else spark.range(1)
    return df.select(make(*[F.col(f"a{i}") for i in range(len(args))]).alias("x")).first().x


@pytest.mark.parametrize("make,args,want", [
    (lambda f, t: tx.note_path(f, t), ("Знания/RAG", "Chunking"), "Знания/RAG/Chunking.md"),
    (lambda f, t: tx.note_path(f, t), ("", "Chunking"), "Chunking.md"),
    (lambda t: tx.slug(t), (' a/b\\c: "d"  [e]#^|? ',), "a b c d e"),
    (lambda t: tx.slug(t), ("???",), "Без названия"),
    (lambda t: tx.headings_within(t), ("# A\n### B\n##### C\n```\n# x\n```\n# D",), "## A\n### B\n#### C\n```\n# x\n```\n## D"),
    (lambda t, h: tx.without_own_heading(t, h), ("## Определение\n\nТекст", "определение"), "Текст"),
    (lambda t, h: tx.without_own_heading(t, h), ("## Другое\n\nТекст", "определение"), "## Другое\n\nТекст"),
    (lambda t: tx.first_sentence(t), ("Слово т.д. и слово ещё. Потом другое.",), "Слово т.д. и слово ещё."),
    (lambda t: F.array_join(tx.normalized_tags(F.split(t, ", ")), "|"), ("#Python, python, Data Science, 2024, a/b, ",), "python|data-science|a/b"),
    (lambda t: tx.collapse_brackets(t), ("[[[[X]]]] и [[Y]]",), "[[X]] и [[Y]]"),
    (lambda t: tx.strip_brackets(t), ("[[ Title ]]",), "Title"),
    (lambda t: tx.snapped(t, F.create_map(F.lit("Retrieval-Augmented Generation"), F.lit("Retrieval-Augmented Generation"))), ("[[Retrieval‑Augmented Generation]]",), "Retrieval-Augmented Generation"),
    (lambda t: tx.snapped(t, F.create_map(F.lit("x"), F.lit("x"))), ("https://x.y",), None),
    (lambda t: tx.snapped(t, F.create_map(F.lit("x"), F.lit("x"))), ("[[ ]]",), None),
    (lambda t: F.array_join(tx.wikilinks(t), "|"), ("см. [[B#x|y]], [[A]] и [[A]]",), "A|B"),
    (lambda t: F.array_join(tx.all_tags(F.array(F.lit("#ml")), t), "|"), ("текст #тег/под слово#нет #ml",), "ml|тег/под"),
    (lambda t: tx.summary(t, 12), ("# H\n\n one two \n three four",), "one two…"),
    (lambda t: tx.closed_fence(t), ("a\n```\nb",), "a\n```\nb\n```"),
    (lambda t: tx.plain_text(t), ("# H\n> [!note] x\n> кв [[A|б]]\n| t |\n*я* `c`\n```\ncode",), "кв б я c"),
    (lambda t: tx.repaired_json(t), ('```json\n{"c": 0. Nine}\n```',), '{"c": 0.9}'),
    (lambda t: tx.estimated_tokens(t), ("ж" * 23,), 11),
    (lambda t: tx.estimated_tokens(t), ("",), 0),
    (lambda t: tx.stem(t), ("a/b.c/Note 1.md",), "Note 1"),
    (lambda t: tx.page_text(t), ("<nav>n</nav><p>a &amp; b</p><script>x<y</script>",), "a & b"),
    (lambda t: F.array_join(validation.body_codes(t, F.lit(True)), "|"), ("```\nx",), "unbalanced_code_fence|very_short_note"),
    (lambda t: F.array_join(validation.body_codes(t, F.lit(True)), "|"), (" \n",), "empty_body"),
])
def test_cases(spark, make, args, want):
    assert value(spark, make, *args) == want
