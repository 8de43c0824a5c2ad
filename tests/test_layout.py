"""The library must stand without its optional subpackage."""

from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "noteloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "noteloom").parts:
            assert "noteloom.llm" not in path.read_text()


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
