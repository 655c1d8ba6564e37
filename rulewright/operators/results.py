"""Write a result, count what it affected, and filter by outcome."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rulewright.functions.text import column
from rulewright.operators.transform import COUNTER

# Rows per output file, bytes per row group.
ROWS_PER_FILE = 100_000
ROW_GROUP_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class Totals:
    rows: int
    matched: int


def write_result(df: DataFrame, uri: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Replace ``uri`` with the table as Parquet, files bounded in rows.

    Tasks write what they read: there is no shuffle, and file order follows
    input order.
    """
    (
        df.write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .option("compression", "snappy")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(uri)
    )


def write_counted(
    df: DataFrame, uri: str, rows_per_file: int = ROWS_PER_FILE, counter: str = COUNTER
) -> Totals:
    """Write and count in the same pass.

    The counts are taken in the writing stage itself, where each task's numbers
    are accepted once, so a lost executor does not count twice.
    """
    seen = Observation(f"totals-{uuid.uuid4().hex}")
    watched = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(column(counter)), F.lit(0)).alias("matched"),
    )
    write_result(watched, uri, rows_per_file)
    return Totals(seen.get["rows"], seen.get["matched"])


def totals(df: DataFrame, counter: str = COUNTER) -> DataFrame:
    """One row: total_rows, matched_cells (0 for an empty table)."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.sum(column(counter)), F.lit(0)).alias("matched_cells"),
    )


def count_matches(spark: SparkSession, uri: str) -> int:
    """Affected cells of a written result; reads the counter column alone."""
    return totals(spark.read.parquet(uri)).first()["matched_cells"]


def affected_rows(df: DataFrame, counter: str = COUNTER) -> DataFrame:
    """Rows in which the rule affected at least one cell."""
    return df.where(column(counter) > 0)


def invalid_rows(df: DataFrame, valid_columns: Sequence[str]) -> DataFrame:
    """Rows in which at least one checked cell failed."""
    bad = F.lit(False)
    for name in valid_columns:
        bad = bad | ~column(name)
    return df.where(bad)
