"""What the driver calls, and that nothing but the entry needs the subpackage llm."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "p1_found" in entry.queries()


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "score"] and rows.count() > 0


def test_library_does_not_import_llm():
    for path in (ROOT / "textloom").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
