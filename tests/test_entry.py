"""The driver contract, on the smallest given tables where they are present."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
SF = Path("/root/testdata/sf0.001")

import __spark_entry__ as entry  # noqa: E402

present = pytest.mark.skipif(not SF.exists(), reason="tables not present")


def test_every_sql_has_a_query():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    own = {q for q in queries if not q.startswith("op") and q != "pipeline"}
    assert own - set(oracle) == {"score_fields"}


@present
def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "yield_kg_per_ha" in df.columns


@present
@pytest.mark.parametrize(
    "name", ["soil_weekly", "pit_join_ttl", "psi_by_feature", "temporal_split", "contract_report"]
)
def test_queries_agree_with_sql(spark, name):
    import duckdb
    from compare import TABLES, compare

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    outcome, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], str(SF))
    assert outcome.startswith("ok")
