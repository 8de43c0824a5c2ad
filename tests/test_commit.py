import os

import pytest

from noteloom.operators import commit as cm

DRAFT = "task_id long, draft_id string, ord long, action string, path string, title string, body_md string, append_section string, created string"


@pytest.fixture
def vault(spark, tmp_path):
    root = str(tmp_path / "vault")
    rows = [("a.md", "---\ntags: [x]\n---\nOld [[B]] \n\n"), ("b.md", "b #y"), ("c.md", "c")]
    assert cm.created(spark, root, spark.createDataFrame(rows, "path string, content string")) == 1
    return root


def drafts(spark, *rows):
    return spark.createDataFrame([(1, str(k), k, *r, "2024-01-02") for k, r in enumerate(rows)], DRAFT)


def paths(spark, *some):
    return spark.createDataFrame([(p,) for p in some], "path string")


def contents(spark, root):
    return {r.path: r.content for r in cm.current(spark, root)["notes"].collect()}


def test_commit_makes_a_version(spark, vault):
    rows = [
        ("update", "a.md", "A", "", " one [[[[N]]]] "), ("create", "n.md", "N", "New", None), ("update", "n.md", "N", "", "more"),
        ("update", "a.md", "A", "", "two"), ("update", "b.md", "B", "Anew", None),
    ]
    assert cm.committed(spark, vault, drafts(spark, *[(a, p, t, b, m) for a, p, t, b, m in rows]), paths(spark, "c.md", "zz.md"), True, True) == 2
    got = contents(spark, vault)
    front = "---\ntitle: {}\ncreated: '2024-01-02'\n---\n\n{}\n"
    assert got == {"a.md": "---\ntags: [x]\n---\nOld [[B]]\n\none [[N]]\n\ntwo\n", "n.md": front.format("N", "New") + "\nmore\n", "b.md": front.format("B", "Anew")}
    now = cm.current(spark, vault)
    assert sorted(map(tuple, now["tags"].collect())) == [("a.md", "x")]
    assert sorted(map(tuple, cm.resolved_links(now).select("source_path", "target_title", "target_path").collect())) == [("a.md", "B", "b.md"), ("a.md", "N", "n.md")]
    assert {r.path for r in now["backups"].collect()} == {"a.md", "b.md"}
    assert {r.path for r in cm.current(spark, vault, 1)["notes"].collect()} == {"a.md", "b.md", "c.md"}


@pytest.mark.parametrize(
    ("rows", "gone", "ok", "leave", "said"),
    [
        ([("create", "a.md", "A", "x", None)], [], True, True, "create_collides_with_existing: a.md"),
        ([("update", "q.md", "Q", "", "x")], [], True, True, "update_missing_target: q.md"),
        ([("create", "q.md", "Q", "x", None), ("create", "q.md", "Q", "y", None)], [], True, True, "duplicate_path_in_changeset: q.md"),
        ([], ["a.md"], True, False, "delete_not_allowed: a.md"), ([], [], False, True, "validation"),
    ],
)
def test_refused_changesets_leave_nothing(spark, vault, rows, gone, ok, leave, said):
    before = sorted(os.listdir(vault))
    good = ("create", "good.md", "G", "x", None)
    with pytest.raises(cm.CommitError, match=said):
        cm.committed(spark, vault, drafts(spark, good, *rows), paths(spark, *gone), ok, leave)
    assert sorted(os.listdir(vault)) == before and cm.versions(spark, vault) == [1] and "good.md" not in contents(spark, vault)


def test_only_the_first_of_two_commits_ends(spark, vault):
    assert cm.committed(spark, vault, drafts(spark, ("create", "n.md", "N", "x", None)), paths(spark), True) == 2
    with pytest.raises(cm.CommitError, match="exists"):
        cm._publish(spark, vault, 2, cm.indexed(spark.createDataFrame([("z.md", "z")], "path string, content string")), {})
    assert set(contents(spark, vault)) == {"a.md", "b.md", "c.md", "n.md"}


def test_empty_changeset_and_missing_collection(spark, vault, tmp_path):
    assert cm.committed(spark, vault, drafts(spark), paths(spark), True) == 2 and len(contents(spark, vault)) == 3
    with pytest.raises(cm.CommitError):
        cm.current(spark, str(tmp_path / "none"))
