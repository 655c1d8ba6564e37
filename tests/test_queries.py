"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import ENTRY_DIR, entry, oracle_sql, queries  # noqa: E402
from tools.check_oracles import TABLES, rows_of  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(ENTRY_DIR).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{ENTRY_DIR}/{name}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = rows_of(queries()[name](spark, ENTRY_DIR).toArrow())
    if name not in oracle_sql():
        assert got[2]
        return
    want = rows_of(duck.sql(oracle_sql()[name]).to_arrow_table())
    assert got[0] == want[0]
    assert got[2] == want[2]


def test_catalogue_order_numbers_ranges(spark, duck):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = queries()["file_catalogue_order"](spark, ENTRY_DIR)
        got = sorted((r.place, r.key) for r in frame.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted((p, k) for k, p in duck.sql(oracle_sql()["file_catalogue_order"]).fetchall())
    assert len(frame.inputFiles()) > 1
    assert "row_number" not in frame._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["doc_id", "text", "matched"] and frame.count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
