"""Core queries against their SQL at the smallest size."""

import math
from pathlib import Path

import duckdb
import pytest

from factloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = ("derive_relative", "whatif_cascade", "stale_propagation", "edit_scenarios")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value.isoformat()[:19].replace("T00:00:00", "") if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    if not Path(SF).exists():
        pytest.skip("no test data")
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = con.execute(ORACLE_SQL[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert found == sorted(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())
