"""The optional subpackage stays optional, and queries keep to the contract."""

import re
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_nothing_imports_the_optional_subpackage():
    for file in (ROOT / "factloom").rglob("*.py"):
        if "llm" not in file.relative_to(ROOT).parts:
            assert not re.search(r"factloom\.llm|from factloom import llm|corpus_pipeline", file.read_text()), file


def test_queries_and_sql_match():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 40


def test_no_local_checkpoints():
    for file in (ROOT / "factloom").rglob("*.py"):
        assert "localCheckpoint" not in file.read_text(), file


def test_entry(spark):
    if Path("/root/testdata/sf0.001").exists():
        assert __spark_entry__.entry(spark).count() > 0
