"""The queries, each beside the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rulewright.sources.tables import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name``, with its SQL where SQL can say it."""

    def keep(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{name}.parquet", base=sf_dir)


def derive(df: DataFrame, columns: str) -> DataFrame:
    """The columns of a SELECT list, written once for both engines."""
    escaped = columns.replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql(f"SELECT {escaped} FROM {{t}}", t=df)


def text(value: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def spark_text(value: str) -> str:
    """A Python string as a Spark SQL literal, in which backslashes escape."""
    return text(value.replace("\\", "\\\\"))


def choose(words: list[str], index: str, quote: Callable[[str], str] = text) -> str:
    """SQL for the word at a 0-based index, counted round."""
    lines = " ".join(f"WHEN {i} THEN {quote(w)}" for i, w in enumerate(words))
    return f"CASE {index} % {len(words)} {lines} END"


def both(columns: str) -> tuple[str, str]:
    """A SELECT list for Spark and for DuckDB, whose names for some things differ."""
    spark = {"text": "STRING", "micros": "unix_micros", "stamp": "timestamp_micros", "list": "array"}
    duckdb = {"text": "VARCHAR", "micros": "epoch_us", "stamp": "make_timestamp", "list": "list_value"}
    return columns.format(**spark), columns.format(**duckdb)
