"""The registered queries against their SQL, on the smallest provided tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = ["CMP.NULL_FIELD", "UNQ.EXACT_DUPLICATE", "CON.STALE_REPEAT", "TIM.OUT_OF_ORDER", "CAL-03", "CAL-06", "WIN-02",
         "WIN-05", "INS-07", "PAT-01", "SRC-07", "SRC-10", "REC-01"]


def test_every_query_has_its_sql():
    own = set(entry.queries()) - set(entry.CORPUS)
    assert own <= set(entry.oracle_sql()) and len(own) == 130


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="provided tables are not here")
class TestTables:
    def test_entry_runs(self, spark):
        assert entry.entry(spark).count() > 100

    @pytest.mark.parametrize("name", QUICK)
    def test_query_agrees(self, spark, con, name):
        cur = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in cur.description]
        df = entry.queries()[name](spark, SF)
        assert sorted(df.columns) == sorted(columns)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
