"""A filter that goes to the rows: a bitmap of hashed values, broadcast as a table of words.

Rows that a join would drop are dropped before they are shuffled.  A bitmap lets all
wanted rows pass and some others, so a join, or a step that can do with more rows, follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for a value, of which two are set, so that one unwanted value in 70 passes; bits of any bitmap (8 MB).
BITS_EACH = 16
MOST_BITS = 1 << 26
SEEDS = (0, 1)


def _word_and_bit(column: str, bits: int, seed: int) -> tuple[Column, Column]:
    """Where the bit of a value is: the word's number, and a word with that bit."""
    place = F.pmod(F.xxhash64(F.lit(seed), column), F.lit(bits))
    return F.floor(place / 64), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def possible(rows: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be among ``values``: a stored table of one column of the same type.

    NULL is a value.  With more than ``MOST_BITS / BITS_EACH`` values more unwanted ones
    pass, and nothing else changes.  The rows stay where they are.
    """
    bits = min(MOST_BITS, max(64, values.count() * BITS_EACH))
    name = values.columns[0]
    places = [F.struct(word.alias("__word"), bit.alias("__bits")) for word, bit in (_word_and_bit(name, bits, seed) for seed in SEEDS)]
    words = values.select(F.explode(F.array(*places)).alias("p")).groupBy("p.__word").agg(F.bit_or("p.__bits").alias("__bits"))
    for seed in SEEDS:
        word, bit = _word_and_bit(column, bits, seed)
        rows = rows.join(F.broadcast(words), (F.col("__word") == word) & (F.col("__bits").bitwiseAND(bit) != 0), "left_semi")
    return rows
