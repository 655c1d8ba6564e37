"""Cell, name and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clip lengths.
SAMPLE_CLIP = 120
MESSAGE_CLIP = 4000
TYPE_CLIP = 64

# Size units, each 1024 times the one before.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def column(name: str) -> Column:
    """Column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(cell: Column) -> Column:
    """Cell as text; NULL stays NULL."""
    return cell.cast("string")


def text_or_blank(cell: Column) -> Column:
    """Cell as text with NULL read as the empty string."""
    return F.coalesce(cell.cast("string"), F.lit(""))


def quote_replacement(value: str) -> str:
    """Make a value literal for a Java replacement (no group references)."""
    return value.replace("\\", "\\\\").replace("$", "\\$")


def effective_pattern(pattern: Column, case_insensitive: Column) -> Column:
    """Column form of the case switch, for tables of rules."""
    add = F.coalesce(case_insensitive, F.lit(False)) & ~pattern.startswith("(?i)")
    return F.when(add, F.concat(F.lit("(?i)"), pattern)).otherwise(pattern)


def squeeze(text: Column) -> Column:
    """Lower-case, runs of whitespace as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def clip(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def extension_of(key: Column) -> Column:
    """Lower-cased extension with its dot; empty when there is none."""
    tail = F.lower(F.substring_index(key, ".", -1))
    has = key.contains(".") & (tail != "")
    return F.when(has, F.concat(F.lit("."), tail)).otherwise(F.lit(""))


def human_size(size: Column) -> Column:
    """Bytes with one decimal and a unit; halves go to the even digit."""
    out = None
    last = len(SIZE_UNITS) - 1
    for power, unit in enumerate(SIZE_UNITS):
        scaled = size.cast("double") / F.lit(float(1024**power))
        shown = F.format_string(f"%.1f {unit}", F.bround(scaled, 1))
        if power == last:
            return out.otherwise(shown)
        test = F.abs(scaled) < 1024.0
        out = F.when(test, shown) if out is None else out.when(test, shown)
    return out


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with two decimals, halves to even; NULL when either end is missing."""
    return F.bround((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6), 2)


def distinct_texts(*arrays: Column) -> Column:
    """Order-preserving union of text arrays, NULLs dropped."""
    empty = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(a, empty) for a in arrays])
    return F.array_distinct(F.array_compact(joined))


def quoted_list(values: Column) -> Column:
    """Array of texts shown as ['a', 'b']."""
    shown = F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))
