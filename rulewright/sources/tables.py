"""Read a table by its extension."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from rulewright.errors import SourceError
from rulewright.sources.delimited import read_delimited

# Extensions that can be selected, and schemes taken as they are.
EXTENSIONS = (".csv", ".tsv", ".xlsx", ".xls", ".parquet")
WORKBOOKS = (".xlsx", ".xls")
WHOLE_URIS = ("s3a://", "file:", "hdfs://", "/")


def extension(uri: str) -> str:
    """Lower-cased extension with its dot; empty when there is none."""
    name, dot, tail = uri.rstrip("/").rpartition(".")
    return dot + tail.lower() if dot and tail else ""


def resolve_uri(key: str, base: str = "") -> str:
    """A full URI or absolute path as given (s3 becomes s3a); a bare key below ``base``."""
    if key.startswith("s3://"):
        return "s3a://" + key.removeprefix("s3://")
    if key.startswith(WHOLE_URIS) or not base:
        return key
    return f"{base.rstrip('/')}/{key.lstrip('/')}"


def read_table(
    spark: SparkSession,
    key: str,
    *,
    base: str = "",
    sep: str | None = "",
) -> DataFrame:
    """Open CSV, TSV or Parquet as a DataFrame.

    Delimited columns are all text; Parquet keeps its own types.  ``sep`` overrides the
    delimiter, ``sep=None`` detects it.  Workbooks are listed but not read, since Spark
    has no reader for them.
    """
    uri = resolve_uri(key, base)
    kind = extension(uri)
    if kind == ".parquet":
        return spark.read.parquet(uri)
    if kind in (".csv", ".tsv"):
        usual = "\t" if kind == ".tsv" else ","
        return read_delimited(spark, uri, usual if sep == "" else sep)
    if kind in WORKBOOKS:
        raise SourceError(f"unsupported file type {kind!r}: workbooks are not read; save {key} as CSV or Parquet")
    raise SourceError(f"unsupported file type {kind!r} for {key}")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path; empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
