"""A look at a source: a few rows, or a few values of one column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions.text import SAMPLE_CLIP, as_text, clip, column, text_or_blank
from rulewright.operators.transform import free_name, visible
from rulewright.sources.tables import extension, read_table, resolve_uri

# Rows shown when none are asked for, the most ever shown, samples taken.
PREVIEW_ROWS = 5
PREVIEW_CEILING = 20
SAMPLE_ROWS = 5


@dataclass(frozen=True)
class Preview:
    """Bounded head of a table; ``frame`` has at most PREVIEW_CEILING rows."""

    frame: DataFrame | None
    columns: list[str] = field(default_factory=list)
    note: str = ""
    truncated: bool = False


def head_of(df: DataFrame, rows: int | None = PREVIEW_ROWS) -> DataFrame:
    """First rows as text: blanks for NULL, bookkeeping columns hidden."""
    size = min(rows or PREVIEW_ROWS, PREVIEW_CEILING)
    cells = [text_or_blank(column(n)).alias(n) for n in visible(df.columns)]
    return df.select(*cells).limit(size)


def preview(
    spark: SparkSession,
    key: str,
    rows: int | None = PREVIEW_ROWS,
    *,
    base: str = "",
) -> Preview:
    """Head of a source.  The delimiter is detected, blank headers become col_<i>, and headers
    that are equal but for blanks or case are numbered: A, A_2."""
    uri = resolve_uri(key, base)
    df = read_table(spark, uri, sep=None)
    if extension(uri) != ".parquet":
        # The scan calls a blank header _c<i>.
        names = [
            f"col_{i}" if n == f"_c{i}" else n.strip() for i, n in enumerate(df.columns)
        ]
        free: list[str] = []
        for name in names:
            free.append(free_name(name, free))
        df = df.toDF(*free)
    if not df.columns:
        return Preview(None, note="no columns")
    # One row more than is shown tells whether there are more.
    head = head_of(df, rows)
    size = min(rows or PREVIEW_ROWS, PREVIEW_CEILING)
    return Preview(head, head.columns, truncated=len(df.limit(size + 1).take(size + 1)) > size)


def sample_values(df: DataFrame, columns: Sequence[str], limit: int = SAMPLE_ROWS) -> DataFrame:
    """A few non-blank values of the first column, clipped; column ``sample``."""
    if not columns:
        return df.limit(0).select(F.lit("").alias("sample"))
    text = as_text(column(columns[0]))
    # The limit comes last, so that a collect opens as few partitions as it needs.
    shown = df.where(F.length(text) > 0).select(clip(text, SAMPLE_CLIP).alias("sample"))
    return shown.limit(limit)
