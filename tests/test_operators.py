"""Operators on the known cases: classes, batches, autofix, merges, sources and streams."""

import pandas as pd
from pyspark.sql import functions as F

from noteloom.operators import assembly, batching, links, retrieval, usage, vault, web
from noteloom.sources import notes as ns
from noteloom.streaming import incremental


def test_cosine_and_classes(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([], [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    assert [r.c for r in df.select(retrieval.cosine(df.a, df.b).alias("c")).collect()] == [1.0, 0.0, 0.0]
    s = spark.createDataFrame([(0.9,), (0.7,), (0.2,)], "s double")
    assert [r.k for r in s.select(retrieval.similarity_class(s.s).alias("k")).collect()] == ["duplicate", "ambiguous", "distinct"]


def test_greedy_batches():
    f = pd.DataFrame({"list_id": [1, 1, 1], "tokens": [4, 4, 4]})
    assert next(batching.greedy(iter([f]), 10))["batch"].tolist() == [0, 0, 1]
    assert next(batching.greedy(iter([f]), 0))["batch"].tolist() == [0, 1, 2]


def test_autofix(spark):
    schema = "task_id long, draft_id string, ord int, action string, title string, path string"
    rows = [(1, "a", 0, "create", "X", "X.md"), (1, "b", 1, "create", "X", "X.md"), (1, "c", 2, "create", "A", "A.md"), (2, "d", 0, "create", "X", "X.md"), (2, "e", 1, "update", "A", "A.md")]
    vault_ = spark.createDataFrame([("A.md",), ("X (2).md",)], "path string")
    got = {r.draft_id: (r.title, r.path, r.fixed) for r in assembly.autofixed(spark.createDataFrame(rows, schema), vault_).collect()}
    assert got["a"] == ("X", "X.md", False) and got["b"] == ("X (3)", "X (3).md", True)
    assert got["c"] == ("A (2)", "A (2).md", True) and got["d"] == ("X", "X.md", False) and got["e"] == ("A", "A.md", False)


def test_merge_and_redirect(spark):
    schema = "g int, ord int, title string, tags array<string>, links_out array<string>, body_md string, needs_review boolean, critic_rounds int"
    rows = [(1, 0, "A", ["rag"], ["B", "X"], "# a", False, 1), (1, 1, "B", ["rag", "ml"], ["A", "Y", "A + B"], "b\n```", True, 3)]
    m = assembly.merged(spark.createDataFrame(rows, schema), "g").first()
    assert (m.title, m.merged_from, m.tags, m.links_out, m.needs_review, m.critic_rounds) == ("A + B", ["A", "B"], ["rag", "ml"], ["X", "Y"], True, 3)
    assert m.body_md == "## A\n\n## a\n\n## B\n\nb\n```\n```"
    d = spark.createDataFrame([("c", "C", ["A", "B", "D"]), ("d", "D", ["B", "C"]), ("e", "E", [])], "draft_id string, title string, links_out array<string>")
    moved = spark.createDataFrame([("A", "AB"), ("B", "AB")], "old string, new string")
    assert {r.draft_id: r.links_out for r in links.redirect(d, moved).collect()} == {"c": ["AB", "D"], "d": ["AB", "C"], "e": []}


def test_relationships(spark):
    d = spark.createDataFrame([(1, "A", "Знания/A.md", ["B", "Нет", "file"]), (2, "B", "Знания/B.md", []), (3, "T", "x/file.md", [])], "draft_id int, title string, path string, links_out array<string>")
    assert sorted(r.to_note for r in links.relationships(d).collect()) == ["x/file.md", "Знания/B.md", "Нет"]


def test_links_dash_variant(spark):
    known = spark.createDataFrame([("a-b",)], "name string")
    some = spark.createDataFrame([("n", "a‑b"), ("n", "a-b"), ("n", "zz")], "source_path string, target_title string")
    assert sorted((r.target_title, r.code) for r in links.check_links(some, known).collect()) == [("a‑b", "wikilink_dash_variant_mismatch"), ("zz", "broken_wikilink")]


def test_limits(spark):
    one = spark.range(1)

    def limit(hits, seconds, **more):
        return one.select(usage.limit_after_hits(F.lit(hits), F.lit(seconds), 8000, factor=0.5, recovery=100.0, **more).alias("x")).first().x

    assert (limit(1, 0), limit(1, 50), limit(1, 100)) == (4000, 6000, 8000)


def test_pieces():
    assert web.pieces("", 10) == [""] and web.pieces(None, 10) == [""]
    assert web.pieces("one two x. three four", 11) == ["one two x.", "three four"]
    assert "".join(web.pieces("x" * 25, 10)) == "x" * 25


def test_note_source(spark, tmp_path):
    (tmp_path / "Знания").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.md").write_text("no")
    (tmp_path / "Знания" / "Эмбеддинги.md").write_text('---\ntitle: "Эмбеддинги"\ntags:\n- ml\n- embeddings\n---\n\nТекст #тег и [[База|б]].\n')
    (tmp_path / "a.md").write_text("plain [[Эмбеддинги]]")
    (tmp_path / "b.md").write_text("---\ntags: [x, '#y']\ntitle:\n---\nbody")
    got = {r.path: r for r in ns.parse_notes(ns.read_notes(spark, str(tmp_path))).collect()}
    assert set(got) == {"Знания/Эмбеддинги.md", "a.md", "b.md"}
    first = got["Знания/Эмбеддинги.md"]
    assert (first.title, first.tags, first.outlinks) == ("Эмбеддинги", ["embeddings", "ml", "тег"], ["База"])
    assert got["a.md"].title == "a" and got["b.md"].tags == ["x", "y"] and got["b.md"].title == "b" and got["b.md"].body == "body"


def test_sync_twice_changes_nothing(spark):
    n = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content_hash string")
    empty = n.limit(0)
    assert tuple(vault.sync_counts(vault.sync_status(empty, n)).first()) == (2, 2, 0, 0)
    assert tuple(vault.sync_counts(vault.sync_status(n, n)).first()) == (2, 0, 2, 0)


def test_checkpoints(spark, tmp_path):
    rows = spark.createDataFrame([(5, "a"), (4, "b")], "version int, task_id string")
    ns.write_json(rows, str(tmp_path / "c"))
    (tmp_path / "c" / "broken.json").write_text("{not json\n")
    assert [r.task_id for r in ns.read_checkpoints(spark, str(tmp_path / "c"), "version int, task_id string").collect()] == ["a"]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "path string, updated_at int").write.parquet(src)
    stream = spark.readStream.schema("path string, updated_at int").parquet(src)
    incremental.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    table = incremental.current(spark.read.parquet(str(tmp_path / "out")))
    assert sorted((r.path, r.updated_at) for r in table.collect()) == [("a", 2), ("b", 1)]


def test_rendered_note_reads_back(spark, tmp_path):
    row = ("Заметка: 1", ["a", "b"], "2024-05-01", "", "Тело [[[[X]]]]\n", ["[[Y]]", "Z"], False)
    df = spark.createDataFrame([row], "t string, tags array<string>, c string, s string, b string, l array<string>, m boolean")
    text = df.select(ns.rendered(df.t, df.tags, df.c, df.s, df.b, df.l, df.m).alias("x")).first().x
    assert text == '---\ntitle: "Заметка: 1"\ntags:\n- a\n- b\ncreated: \'2024-05-01\'\n---\n\nТело [[X]]\n\n## Связанные заметки\n\n- [[Y]]\n- [[Z]]\n'
    (tmp_path / "n.md").write_text(text)
    back = ns.parse_notes(ns.read_notes(spark, str(tmp_path))).first()
    assert (back.title, back.tags, back.outlinks) == ("Заметка: 1", ["a", "b"], ["X", "Y", "Z"])


def test_exponential_average_equals_the_fold(spark):
    rows = [(k, "r", f"2024-01-0{1 + k // 4} 00:00:{k:02d}", float(k * k % 7)) for k in range(12)]
    df = spark.createDataFrame(rows, "event_id int, role string, ts string, x double").withColumn("ts", F.col("ts").cast("timestamp"))
    want = rows[0][3]
    for r in rows[1:]:
        want = 0.3 * r[3] + 0.7 * want
    assert abs(usage.moving_average(df, F.col("x")).first().average - want) < 1e-9


def test_listing_labels(spark):
    from noteloom.operators import planning

    tasks = spark.sql("select * from values (1L, 'asked', timestamp'2024-01-02 00:00:00'), (2L, '', timestamp'2024-01-01 21:00:00'), (3L, null, timestamp'2024-01-03 00:00:00'), (4L, '', timestamp'2024-01-04 00:00:00') t(task_id, raw_query, created_at)")
    rows = [(2, 0, "create", "First", False), (2, 1, "create", "Map", True), (3, 0, "update", "U", False), (3, 1, "create", "N" * 70, False)]
    drafts = spark.createDataFrame(rows, "task_id long, ord int, action string, title string, is_moc boolean")
    results = spark.createDataFrame([(1, 0, 2, True), (2, 1, 0, False)], "task_id long, errors long, warnings long, ok boolean")
    got = [tuple(r) for r in planning.staged_listing(tasks, drafts, results).collect()]
    assert got == [
        (2, "Map", "02.01.2024 00:00 по мск", 2, 0, "ЕСТЬ ОШИБКИ (errors=1, warnings=0)"), (1, "asked", "02.01.2024 03:00 по мск", 0, 0, "OK (warnings=2)"),
        (3, "N" * 57 + "…", "03.01.2024 03:00 по мск", 1, 1, "не проверялся"), (4, "—", "04.01.2024 03:00 по мск", 0, 0, "не проверялся"),
    ]


def test_candidates_of_subtopics(spark):
    rows = [(1, "http://a/", "s"), (2, "HTTP://A", "s"), (3, "http://b", "s"), (4, "http://a", "t"), (5, "//", "s"), (6, "http://c", "s"), (7, "http://d", "s")]
    df = spark.createDataFrame(rows, "n int, url string, topic string")
    assert sorted(r.n for r in web.candidates(df, "topic", "n", 1).collect()) == [1, 3, 4]


def test_texts_are_cut_in_batches_of_bounded_bytes(spark):
    """Whatever the session had, units bound the bytes that Python gets at a time; pieces are those of ``pieces``."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        texts = [("x" * (k * 97 % 9000)) + (". ą\n" * (k % 50)) for k in range(1, 200)] + [" " * 3500]
        rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
        got = {r.unit_id: r.chunk for r in web.units(rows, "id", "text").collect()}
        assert got == {f"{i}#{at}": p for i, t in enumerate(texts) for at, p in enumerate(web.pieces(t[:8000], 3000)[:3])}
        assert int(spark.conf.get(name)) <= 8 << 20
    finally:
        if before is not None:
            spark.conf.set(name, before)
