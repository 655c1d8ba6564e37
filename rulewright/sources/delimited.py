"""Delimited text: every column is text, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Delimiters considered, in order of preference, and the fallback.
DELIMITERS = (",", ";", "\t", "|")
FALLBACK = ","
HEAD_LINES = 50


def detect_delimiter(spark: SparkSession, uri: str, lines: int = HEAD_LINES) -> str:
    """The delimiter of the header that most head lines agree with.

    A delimiter counts by the share of head lines with as many of it as the header has,
    more than half at least; then by its number in the header, then by the order above,
    so that a ragged line changes nothing.  Text inside quotes is left out.  TSV files are
    always tab-separated; a file in which nothing is clear is split at the fallback.
    """
    if uri.lower().endswith(".tsv"):
        return "\t"
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = [
        F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) for d in DELIMITERS
    ]
    # head() opens as few partitions as it needs, however large the file is.
    head = spark.read.text(uri).where(F.length(F.trim("value")) > 0).select(*counts).head(lines)
    seen = dict(zip(DELIMITERS, zip(*head)))
    clear = {d: (n.count(n[0]) / len(n), n[0]) for d, n in seen.items() if n[0] > 0 and 2 * n.count(n[0]) > len(n)}
    return max(clear, key=clear.get) if clear else FALLBACK


def read_delimited(spark: SparkSession, uri: str, sep: str | None = ",") -> DataFrame:
    """Header row, text columns, quotes doubled inside quotes, bad rows kept.

    A line is a record, so large files split across tasks.  ``sep=None`` detects
    the delimiter from the head of the file.
    """
    if sep is None:
        sep = detect_delimiter(spark, uri)
    return spark.read.csv(
        uri,
        sep=sep,
        header=True,
        inferSchema=False,
        quote='"',
        escape='"',
        multiLine=False,
        encoding="UTF-8",
        mode="PERMISSIVE",
    )
