import pytest
from pyspark.sql import functions as F

from noteloom.operators import staging as st
from noteloom.operators.assembly import HUMANITIES

SCHEMA = "task_id long, draft_id string, ord long, action string, path string, title string"
MORE = SCHEMA + ", body_md string, links_out array<string>"


def frame(spark, *rows, schema=SCHEMA):
    return spark.createDataFrame(list(rows), schema)


def vault(spark, *paths):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[-1][:-3]) for p in paths], "path string, title string")


def fixed(spark, rows, *paths):
    out, issues = st.autofixed(st.completed(frame(spark, *rows, schema=SCHEMA + ", links_out array<string>")), vault(spark, *paths))
    return {r.draft_id: (r.title, r.path, r.links_out) for r in out.collect()}, {(r.draft_id, r.code, r.message) for r in issues.collect()}


def test_repeated_path_gets_a_number_and_redirects_nothing(spark):
    got, issues = fixed(spark, [(1, "a", 0, "create", "K/X.md", "X", []), (1, "b", 1, "create", "K/X.md", "X", []), (1, "c", 2, "create", "K/B.md", "B", ["X"])])
    assert got == {"a": ("X", "K/X.md", []), "b": ("X (2)", "K/X (2).md", []), "c": ("B", "K/B.md", ["X"])}
    assert issues == {("b", "path_autofixed", "Заметка «X»: путь занят другой заметкой этой задачи (K/X.md) — переименована в «X (2)» (K/X (2).md).")}


def test_taken_path_gets_a_number_and_redirects(spark):
    rows = [(1, "a", 0, "create", "K/A.md", "A", []), (1, "b", 1, "create", "K/B.md", "B", ["A", "A (2)", "Z"]), (2, "c", 0, "create", "K/C.md", "C", ["A", "A"])]
    got, issues = fixed(spark, rows, "K/A.md", "K/old.md")
    assert got["a"] == ("A (2)", "K/A (2).md", []) and got["b"][2] == ["A (2)", "Z"] and got["c"][2] == ["A", "A"] and len(issues) == 1


def test_numbers_avoid_names_of_task_and_vault(spark):
    rows = [
        (1, "a", 0, "create", "K/X.md", "X", []), (1, "b", 1, "create", "L/X.md", "X", []), (1, "c", 2, "create", "L/X (3).md", "Y", []), (1, "d", 3, "update", "L/X.md", "X (4)", []),
        (1, "e", 4, "create", "X.md", "X", []), (1, "f", 5, "create", "K/X?.md", "X?", []),
    ]
    got, _ = fixed(spark, rows, "K/X.md", "L/X.md", "X.md", "X (6).md", "K/X (2).md", "K/X?.md")
    # a: the vault has K/X (2); b: L/X (2) is free; e: titles 2-4 and path 6 are taken; f: slug of its own
    assert got["a"][:2] == ("X (3)", "K/X (3).md") and got["b"][:2] == ("X (2)", "L/X (2).md") and got["e"][:2] == ("X (5)", "X (5).md")
    assert got["f"][:2] == ("X? (4)", "K/X (4).md") and got["c"][:2] == ("Y", "L/X (3).md") and got["d"][0] == "X (4)"


def test_no_free_number_leaves_the_draft(spark):
    got, issues = fixed(spark, [(1, "a", 0, "create", "X.md", "X", [])], "X.md", *[f"X ({n}).md" for n in range(2, 100)])
    assert got["a"][:2] == ("X", "X.md") and not issues


def codes(out, task=1):
    return [(r.code, r.draft_id) for r in out.where(F.col("task_id") == task).orderBy("seq").collect()]


def test_issues_come_in_order(spark):
    body = "Текст заметки. " * 30
    rows = [
        (1, "u", 0, "update", "no.md", "U", "", ["B–C"]), (1, "a", 1, "create", "A.md", "A", "", ["Nowhere"]), (1, "b", 2, "create", "A.md", "B-C", body + "\n```", []),
        (1, "c", 3, "create", "C.md", " ", "English prose only. " * 20, []), (2, "z", 0, "create", "Z.md", "Z", f"{body}\n\n{body}\n\n{body}", ["A", "old"]),
    ]
    drafts = frame(spark, *rows, schema=MORE).withColumn("note_id", F.col("draft_id"))
    front = F.when(F.col("draft_id") == "b", '{"x": {"a": 1}, "tags": ["t", [1], {"k": 2}], "n": 1, "s": "{\\"q\\": 1}"}').otherwise("{}")
    headings = spark.createDataFrame([("b", 0, "One"), ("b", 1, "Two"), ("z", 0, "Three")], "note_id string, pos int, heading string")
    deletes = spark.createDataFrame([(1, "d.md"), (1, "e.md")], "task_id long, path string")
    _, extra = st.autofixed(st.completed(frame(spark, (1, "p", 0, "create", "P.md", "P"))), vault(spark, "P.md"))
    out = st.run_validation(drafts.withColumn("frontmatter", front), vault(spark, "A.md", "k/old.md"), deletes, False, headings, extra)
    assert codes(out) == [
        ("path_autofixed", "p"), ("delete_not_allowed", None), ("create_collides_with_existing", "a"), ("create_collides_with_existing", "b"), ("duplicate_path_in_changeset", "b"),
        ("update_missing_target", "u"), ("broken_wikilink", "a"), ("wikilink_dash_variant_mismatch", "u"), ("empty_body", "a"),
        ("yaml_unsupported_type", "b"), ("yaml_unsupported_type", "b"), ("yaml_unsupported_type", "b"), ("unbalanced_code_fence", "b"), ("note_too_short_structural", "b"),
        ("missing_outline_heading", "b"), ("missing_outline_heading", "b"), ("empty_title", "c"), ("note_too_short_structural", "c"), ("note_language_mismatch", "c"), ("empty_body", "u"),
    ]
    assert codes(out, 2) == [("missing_outline_heading", "z")]
    said = {r.code: r.message for r in out.collect()}
    assert said["delete_not_allowed"].startswith("Changeset содержит 2 операций") and "всего 0%" in said["note_language_mismatch"]
    assert "(отличаются только" in said["wikilink_dash_variant_mismatch"] and "'B-C'" in said["wikilink_dash_variant_mismatch"]
    told = {r.task_id: (r.errors, r.warnings, r.ok) for r in st.report(out, spark.range(1, 4).withColumnRenamed("id", "task_id")).collect()}
    assert told[2] == (0, 1, True) and told[3] == (0, 0, True) and not told[1][2]


def test_maps_need_no_structure_and_updates_no_body(spark):
    rows = [(1, "m", 0, "create", "M.md", "M", "- [[A]] — x " * 5, []), (1, "u", 1, "update", "U.md", "U", "", [])]
    drafts = frame(spark, *rows, schema=MORE).withColumn("is_moc", F.col("draft_id") == "m").withColumn("append_section", F.when(F.col("draft_id") == "u", "раздел " * 10))
    assert codes(st.run_validation(drafts, vault(spark, "U.md"))) == []


def merge_rows(spark):
    text = "string, tags array<string>, links_out array<string>, body_md string, source_refs array<string>, unverified_sections array<string>, merged_from array<string>, needs_review boolean, critic_rounds long"
    rows = [
        (1, "a", 0, "create", "K/A.md", "A", ["t", "u"], ["B", "Z"], HUMANITIES + "\n\n## One\n\n```\n# code", ["r1"], ["s"], [], False, 1),
        (1, "b", 1, "create", "K/B.md", "B", ["u", "v"], ["Z", "A"], "text", ["r1", "r2"], [], ["B1", "B2"], True, 3),
        (1, "c", 2, "create", "C.md", "C", [], ["b1", "B2", "A", "C"], "own", [], [], [], False, 0),
        (1, "d", 3, "update", "D.md", "D", [], ["B"], "", [], [], [], False, 0), (2, "e", 0, "create", "E.md", "E", [], ["A"], "own", [], [], [], False, 0),
    ]
    return spark.createDataFrame(rows, SCHEMA.replace("title string", "title " + text)).withColumn("folder", F.when(F.col("path").startswith("K/"), "K").otherwise(""))


def groups(spark, *rows):
    return spark.createDataFrame(list(rows), "task_id long, g int, draft_id string, title string")


def test_merged_draft(spark):
    out = {r.draft_id: r for r in st.merged(merge_rows(spark), groups(spark, (1, 0, "a", None), (1, 0, "b", None))).collect()}
    assert set(out) == {"a", "c", "d", "e"}
    m = out["a"]
    assert (m.title, m.path, m.ord, m.tags, m.links_out, m.source_refs, m.unverified_sections) == ("A + B", "K/A + B.md", 0, ["t", "u", "v"], ["Z"], ["r1", "r2"], ["s"])
    assert (m.merged_from, m.needs_review, m.critic_rounds, m.note_id) == (["A", "B1", "B2"], True, 3, "")
    assert m.body_md == f"{HUMANITIES}\n\n## A\n\n### One\n\n```\n# code\n```\n\n## B\n\ntext"
    assert out["c"].links_out == ["b1", "A + B"] and out["d"].links_out == ["B"] and out["e"].links_out == ["A"]


def test_merged_draft_with_a_title_of_its_own(spark):
    out = {r.draft_id: r for r in st.merged(merge_rows(spark), groups(spark, (1, 0, "a", " Own "), (1, 0, "c", " Own "))).collect()}
    assert out["a"].title == "Own" and out["a"].path == "K/Own.md" and out["a"].merged_from == ["A", "C"] and out["b"].links_out == ["Z", "Own"]


@pytest.mark.parametrize(
    ("rows", "problem"),
    [([(1, 0, "a", "")], "fewer_than_two"), ([(1, 0, "a", ""), (1, 0, "d", "")], "not_a_create"), ([(1, 0, "a", ""), (1, 0, "x", "")], "unknown_draft"), ([(1, 0, "a", ""), (1, 0, "b", ""), (1, 1, "b", ""), (1, 1, "c", "")], "overlap")],
)
def test_groups_that_cannot_be_merged(spark, rows, problem):
    with pytest.raises(ValueError, match=problem):
        st.merged(merge_rows(spark), groups(spark, *rows))


def test_all_creates(spark):
    out = st.merged(merge_rows(spark), st.all_creates(merge_rows(spark)))
    assert sorted((r.task_id, r.title) for r in out.collect()) == [(1, "A + B + C"), (1, "D"), (2, "E")]


def test_content_map(spark):
    rows = [(1, "a", 0, "create", "A.md", "A", "First one. Second.", []), (1, "b", 1, "create", "B.md", "B", "", []), (1, "c", 2, "create", "F/T — обзор (2).md", "x", "", []), (2, "d", 0, "create", "D.md", "D", "", [])]
    drafts = frame(spark, *rows, schema=MORE).withColumn("note_id", F.col("draft_id"))
    topics = spark.createDataFrame([(1, " T ", " About\nall ", "F", "technical"), (2, "U", "", "F", "x")], "task_id long, topic string, summary string, folder string, domain string")
    abstracts = spark.createDataFrame([("b", " An \n abstract "), ("c", None)], "note_id string, abstract string")
    (m,) = st.content_map(drafts, topics, abstracts, vault(spark, "F/T — обзор.md", "T — обзор (3).md")).collect()
    assert (m.title, m.path, m.tags, m.links_out, m.is_moc) == ("T — обзор (3)", "F/T — обзор (3).md", ["moc", "domain/technical"], ["A", "B", "x"], True)
    assert m.body_md == "> [!abstract] Кратко\n> About\n> all\n\n## Заметки\n\n- [[A]] — First one.\n- [[B]] — An abstract\n- [[x]]"


def test_inline_links(spark):
    rows = [(1, "a", 0, "create", "A.md", "Own", "Own and Other", ["Own", "Other"]), (1, "b", 1, "update", "B.md", "B", "Other", ["Other"]), (1, "m", 2, "create", "M.md", "M", "Other", ["Other"])]
    drafts = st.completed(frame(spark, *rows, schema=MORE).withColumn("is_moc", F.col("draft_id") == "m"))
    assert {r.draft_id: r.body_md for r in st.inline_linked(drafts).collect()} == {"a": "Own and [[Other]]", "b": "Other", "m": "Other"}


def test_change_report(spark):
    drafts = frame(spark, (1, "a", 0, "create", "A.md", "A"), (1, "u", 1, "update", "U.md", "U"))
    deletes = spark.createDataFrame([(1, "x.md"), (1, "b.md")], "task_id long, path string")
    links = spark.createDataFrame([(1,), (1,)], "task_id long")
    issues = st.run_validation(drafts.withColumn("append_section", F.lit("\n# New part\nmore " * 4)), vault(spark, "U.md"), deletes)
    out = st.change_report(drafts, deletes, links, issues).where("task_id = 1").orderBy("section", "ord")
    assert [r.lines.split("\n")[0] for r in out.collect()] == [
        "Задача: 1", "НОВЫЕ ЗАМЕТКИ (1):", "  + A.md", "ДОПОЛНЯЕМЫЕ ЗАМЕТКИ (1):", "  ~ U.md", "⚠️  УДАЛЕНИЯ (2) — по умолчанию заблокированы:", "  - b.md", "  - x.md",
        "Новые связи (wikilinks): 2", "Валидация: ЕСТЬ ОШИБКИ (errors=1, warnings=1)",
        "  ❌ [delete_not_allowed] Changeset содержит 2 операций удаления, но ALLOW_DELETE=false. Удаление заблокировано по умолчанию.",
        "  ⚠️ [note_too_short_structural] " + st.MESSAGES["note_too_short_structural"][1].replace("{0}", "0"),
    ]


def test_a_report_goes_over_its_issues_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(level):
        seen.add(1)
        return level

    issues = spark.createDataFrame([(1, 1, "error", "c", "m", "d"), (1, 2, "warning", "c", "m", "d"), (2, 1, "warning", "c", "m", "e")], "task_id long, seq int, level string, code string, message string, draft_id string")
    issues = issues.withColumn("level", F.udf(counted, "string").asNondeterministic()("level"))
    drafts = spark.createDataFrame([(1, "d", 0, "create", "d.md", "D"), (2, "e", 0, "create", "e.md", "E")], "task_id long, draft_id string, ord long, action string, path string, title string")
    none = drafts.limit(0).select("task_id", "path")
    told = {(r.task_id, r.ord): r.lines for r in st.change_report(drafts, none, none.select("task_id"), issues).where("section = 5").collect()}
    assert len(told) == 5 and told[1, -1] == "Валидация: ЕСТЬ ОШИБКИ (errors=1, warnings=1)" and told[2, 1] == "  ⚠️ [c] m"
    assert seen.value == 3
