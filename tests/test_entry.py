import __spark_entry__ as entry


def test_every_query_has_a_stable_name():
    names = entry.queries()
    assert {"p6_found", "p7_found", "health_score", "title_duplicates_fuzzy"} <= set(names)
    assert set(entry.oracle_sql()) <= set(names)


def test_nothing_outside_imports_the_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for path in (root / "bookwarp").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "bookwarp.llm" not in path.read_text(), path
