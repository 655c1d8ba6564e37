"""Line dedup: lines that many documents share stay in one of them only.

Lines are exploded and normalised, and their keys hashed to 128 bits; distinct
documents are counted per hash; documents are joined with the shared keys they lose,
and reassembled from the remaining lines in their order.

The counts are spread by (hash, document) before they meet per hash, so a line that a
third of all documents hold is summed from partial counts.  Documents are shuffled
once, by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import free_name, lean, stored, with_fields

# The white space stripped from lines and the letters lower-cased.
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The seed of Spark's xxhash64, and that after the literal of the second hash.
SECOND = "second"
FIRST_SEED = 42
SECOND_SEED = xxhash.xxh64_intdigest(SECOND.encode(), FIRST_SEED)
TO_LOWER = str.maketrans(UPPER, LOWER)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per line key of at least ``min_chars`` code points that at least
    ``min_docs`` distinct doc_id hold: h1, h2 (its hash), keeper (largest doc_id)."""
    return (
        _long_lines(docs, min_chars)
        .groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )


def _long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """The distinct long keys of each document with their hash."""
    keys = F.array_distinct(
        F.filter(
            F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key),
            lambda k: F.length(k) >= min_chars,
        )
    )
    return docs.select("doc_id", F.explode(keys).alias("key")).select(
        "doc_id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(SECOND), "key").alias("h2")
    )


def key_hash(key: str) -> tuple[int, int]:
    """h1 and h2 of a key, as the expressions above give them."""
    body = key.encode()
    return tuple(x - (x >> 63 << 64) for x in (xxhash.xxh64_intdigest(body, FIRST_SEED), xxhash.xxh64_intdigest(body, SECOND_SEED)))


def remaining(lines: list[str], gone: set[tuple[int, int]], min_chars: int) -> list[str]:
    """The lines whose key is short or not in ``gone``."""

    def stays(line: str) -> bool:
        key = line.strip(BLANKS).translate(TO_LOWER)
        return len(key) < min_chars or key_hash(key) not in gone

    return [line for line in lines if stays(line)]


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, with their shared lines taken out of ``text``,
    and n_lines (before), n_dropped.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses
    all its lines except in the largest doc_id that holds it, where all of them stay.
    NULL or empty text is one empty line, and comes back as the empty text.  Rows with
    one doc_id count as one document and each lose the same keys; a row without doc_id
    counts for nothing and loses every shared key.  Columns of ``docs`` named n_lines or
    n_dropped are replaced.  An empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped")
    owner, lost = free_name(docs, "__id"), free_name(docs, "__gone")
    # Written, so that the join reads both sides by shuffle and a very common line can be split.
    shared = stored(shared_lines(docs, min_chars, min_docs), "shared-lines")
    gone = (
        _long_lines(docs, min_chars)
        .join(shared, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("doc_id").alias(owner)).agg(F.collect_set(F.struct("h1", "h2")).alias(lost))
    )
    names = docs.columns
    marked = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(owner)), "left").select(*names, lost)
    shape = with_fields(docs, n_lines="long", n_dropped="long")
    at = names.index("text")

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                parts = (text or "").split("\n")
                kept = remaining(parts, {(g["h1"], g["h2"]) for g in gone}, min_chars) if gone else parts
                texts.append("\n".join(kept))
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            columns = [c for i, c in enumerate(batch.columns) if i < len(names)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"]
            )

    return marked.mapInArrow(lean(reassemble), shape)
