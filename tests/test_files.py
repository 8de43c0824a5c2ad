import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noteloom.operators import staging as st
from noteloom.sources import changesets as cs
from noteloom.sources import files


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def rows(spark, *some):
    return spark.createDataFrame(list(some), "path string, content string")


def test_files_are_read_whatever_their_names(spark, tmp_path):
    for name, text in (("a.md", "A"), ("_b.md", "B"), (".c.md", "C"), ("Знания/_x/d.md", "Д"), (".obsidian/e.md", "E"), ("k/.trash/f.md", "F"), ("g.txt", "G")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.md").write_bytes(b"x\xff")
    got = {r.path: r.content for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "A", "_b.md": "B", ".c.md": "C", "Знания/_x/d.md": "Д", "bad.md": "x�"}
    many = spark.read.format("text_files").option("bytes", 1).load(str(tmp_path))
    assert many.rdd.getNumPartitions() == 5 and many.count() == 5


def test_empty_and_missing_folders(spark, tmp_path):
    assert files.read_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no folder"):
        files.read_files(spark, str(tmp_path / "none")).count()


def test_written_files_read_back(spark, tmp_path):
    some = rows(spark, ("a.md", "one\n"), ("x/y/b.md", "два"), ("_c.md", None)).repartition(3)
    files.write_files(some, f"file://{tmp_path}")
    assert {r.path: r.content for r in files.read_files(spark, str(tmp_path)).collect()} == {"a.md": "one\n", "x/y/b.md": "два", "_c.md": ""}
    assert tree(tmp_path) == ["_c.md", "a.md", "x/y/b.md"]


def test_a_refused_write_leaves_nothing(spark, tmp_path):
    (tmp_path / "a.md").write_text("old")
    for bad in (rows(spark, ("new.md", "n"), ("a.md", "x")), rows(spark, ("new.md", "n"), ("new.md", "m")).repartition(2), rows(spark, ("new.md", "n"), ("../up.md", "x"))):
        with pytest.raises(Exception):
            files.write_files(bad, str(tmp_path))
        assert tree(tmp_path) == ["a.md"] and (tmp_path / "a.md").read_text() == "old"
    files.write_files(rows(spark, ("a.md", "x")), str(tmp_path), overwrite=True)
    assert (tmp_path / "a.md").read_text() == "x"


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(0, 40, 1, 4).select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("path"), F.when(F.col("id") == 39, F.raise_error("stop")).otherwise("x").alias("content"))
    with pytest.raises(Exception):
        files.write_files(bad, str(tmp_path))
    assert not [f for f in tree(tmp_path) if not f.startswith(".staged-")]


def test_changesets(spark, tmp_path):
    drafts = spark.createDataFrame(
        [(1, "a", 0, "create", "K/A.md", "A", "body", None), (1, "b", 1, "update", "U.md", "U", "", "more\n"), (2, "c", 0, "create", "C.md", "C", "x", None)],
        "task_id long, draft_id string, ord long, action string, path string, title string, body_md string, append_section string",
    ).withColumn("created", F.lit("2024-01-01"))
    deletes = spark.createDataFrame([(3, "d.md")], "task_id long, path string")
    vault = spark.createDataFrame([("U.md", "U")], "path string, title string")
    issues = st.run_validation(drafts, vault, deletes)
    root = str(tmp_path)
    cs.save_changesets(root, drafts, deletes, issues)
    assert tree(root) == ["1/changeset.json", "1/notes_preview/K__A.md", "1/notes_preview/U.md", "2/changeset.json", "2/notes_preview/C.md", "3/changeset.json"]
    assert open(f"{root}/1/notes_preview/U.md").read() == "more\n" and open(f"{root}/2/notes_preview/C.md").read() == "---\ntitle: C\ncreated: '2024-01-01'\n---\n\nx\n"
    (tmp_path / "4").mkdir()
    (tmp_path / "4" / "changeset.json").write_text("{broken")
    (tmp_path / "5").mkdir()
    got = {r.task_id: r for r in cs.load_changesets(spark, root).collect()}
    assert set(got) == {"1", "2", "3"} and not got["3"].ok and got["2"].ok and [d.title for d in got["1"].drafts] == ["A", "U"] and got["3"].deletes == ["d.md"]
    assert sorted(r.task_id for r in cs.pending_tasks(spark, root).collect()) == ["1", "2", "3", "4"]
    cs.save_changesets(root, drafts.where("task_id = 2").withColumn("title", F.lit("C2")), deletes.limit(0), issues.limit(0))
    assert {r.task_id: len(r.drafts) for r in cs.load_changesets(spark, root).collect()} == {"1": 2, "2": 1, "3": 0}


def test_changesets_are_found_without_a_look_at_their_previews(spark, tmp_path):
    some = spark.range(40).select(F.concat((F.col("id") % 4).cast("string"), F.lit("/p/"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.lit("x").alias("content"))
    files.write_files(some.unionByName(rows(spark, ("0/changeset.json", "{}"), ("3/changeset.json", "[]"))), str(tmp_path))
    assert len(tree(tmp_path)) == 42
    reader = files.Reader({"path": str(tmp_path), "inside": "changeset.json"})
    assert [p.names for p in reader.partitions()] == [[f"{k}/changeset.json" for k in range(4)]]
    assert sorted((r.path, r.content) for r in files.read_inside(spark, str(tmp_path), "changeset.json").collect()) == [("0/changeset.json", "{}"), ("3/changeset.json", "[]")]


def test_tasks_move_what_they_staged_and_may_run_again(tmp_path):
    job = f"{files.STAGED}x"
    batch = pa.RecordBatch.from_pydict({"path": ["a/b.md", "a/c.md"], "content": ["B", None]})
    moves = list(files.staged([batch], str(tmp_path), job))
    for _ in range(2):
        assert [n for b in files.placed(moves, str(tmp_path), job) for n in b.column(0).to_pylist()] == [2]
    assert (tmp_path / "a" / "b.md").read_text() == "B" and (tmp_path / "a" / "c.md").read_text() == ""
