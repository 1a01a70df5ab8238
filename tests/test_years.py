"""Queries against their SQL on ids that read as years."""

import duckdb
import pytest

from factloom.plans.queries import ORACLE_SQL, QUERIES


def against_sql(spark, tmp_path, name, **tables):
    for table, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet')")
    df = QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    expected = sorted(repr([r[i] for i in at]) for r in cursor.fetchall())
    assert sorted(repr(list(r)) for r in df.collect()) == expected and expected


@pytest.mark.parametrize("name", ["junk_lines", "cleaned_paragraphs"])
def test_ids_that_read_as_years(spark, tmp_path, name):
    against_sql(spark, tmp_path, name, documents="SELECT range AS doc_id, 'x' AS text FROM range(1880, 2120)")
