"""Sharding: contiguous runs of atomic groups with the smallest possible largest shard.

Equal texts form an atomic group; groups are ordered by their hash.  The smallest
feasible capacity is found by binary search, each capacity checked by filling shards
greedily, and the order is cut there.

Group sizes stay distributed.  The driver sees sums over ranges of the hash: a capacity
that works with cuts between ranges only is an upper bound, one that fails even with
cuts inside ranges a lower bound.  Ranges in which a cut may fall are summed at a finer
grain until they are single groups, so the answer is exact and each pass returns a few
thousand sums, whatever the input.  A group above the fair share has a shard of its own,
and the others share the rest.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.llm.common import stored

SHARDS = 24
FIRST_BITS, MORE_BITS = 12, 6
#: Parts of a shard in which rows are numbered side by side.
LANES = 1024
TOP = 1 << 63


class Range(NamedTuple):
    low: int  # first hash, counted from 0
    size: int
    single: bool  # holds one group


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), size (UTF-8 bytes plus 8), text_crc32."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.xxhash64(text).alias("mark"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def _range_id(bits: int) -> Column:
    # The hash counted from 0, so that ranges are in the order of signed marks.
    return F.shiftrightunsigned(F.col("mark").bitwiseXOR(F.lit(-TOP)), 64 - bits)


def _sums(rows: DataFrame, bits: int) -> list[Range]:
    found = rows.groupBy(_range_id(bits).alias("range")).agg(
        F.sum("size").alias("size"), (F.min("mark") == F.max("mark")).alias("single")
    )
    return [Range(r.range << (64 - bits), r.size, r.single) for r in sorted(found.collect(), key=lambda r: r.range)]


def _reach(ends: list[int], ranges: list[Range], start: int, capacity: int, inside: bool) -> int:
    """How far a shard gets that begins at ``start``; ``inside``: cuts inside ranges of several groups are allowed."""
    goal = start + capacity
    n = bisect_right(ends, goal) - 1
    if n == len(ranges):
        return ends[-1]
    return goal if inside and not ranges[n].single else max(ends[n], start)


def _reaches(ranges: list[Range], ends: list[int], shards: int, capacity: int, inside: bool) -> list[int]:
    at, out = 0, []
    for _ in range(shards):
        at = _reach(ends, ranges, at, capacity, inside)
        out.append(at)
    return out


def _smallest(ranges: list[Range], ends: list[int], shards: int, inside: bool) -> int:
    low, high = -(-ends[-1] // shards), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if _reaches(ranges, ends, shards, middle, inside)[-1] >= ends[-1]:
            high = middle
        else:
            low = middle + 1
    return low


def smallest_capacity(rows: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the first mark of each shard but the first."""
    bits = FIRST_BITS
    ranges = _sums(rows, bits)
    if not ranges:
        return 0, []
    while True:
        ends = [0, *accumulate(r.size for r in ranges)]
        least, enough = (_smallest(ranges, ends, shards, inside) for inside in (True, False))
        early = _reaches(ranges, ends, shards, least, False)
        late = _reaches(ranges, ends, shards, enough, True)
        split = {
            n
            for a, b in zip(early[:-1], late[:-1])
            for n in range(bisect_right(ends, a) - 1, min(bisect_right(ends, b), len(ranges)))
            if not ranges[n].single
        }
        if not split or bits + MORE_BITS >= 64:
            break
        wanted = rows.sparkSession.createDataFrame([(ranges[n].low >> (64 - bits),) for n in sorted(split)], "range long")
        # At most as many ids as there are ranges on the driver.
        inner = rows.withColumn("range", _range_id(bits)).join(F.broadcast(wanted), "range", "left_semi")
        bits += MORE_BITS
        ranges = sorted([r for n, r in enumerate(ranges) if n not in split] + _sums(inner, bits))
    cuts = [bisect_right(ends, at) - 1 for at in _reaches(ranges, ends, shards, enough, False)[:-1]]
    return enough, [ranges[n].low - TOP for n in cuts if n < len(ranges)]


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0) for every row.

    NULL texts count as empty, and equal texts share a shard.  Rows with equal or NULL
    doc_id are rows of their own.  Other columns are not read.  An empty table gives no rows.
    """
    rows = stored(sized(docs), "sized")
    groups = rows.groupBy("mark").agg(F.sum("size").alias("size"))
    left = rows.agg(F.sum("size")).first()[0] or 0
    own: list[int] = []
    for group in groups.orderBy(F.desc("size"), "mark").limit(shards).collect():
        if len(own) + 1 == shards or group.size * (shards - len(own)) <= left:
            break
        own.append(group.mark)
        left -= group.size
    common = rows.where(~F.col("mark").isin(own)) if own else rows
    _, firsts = smallest_capacity(common, shards - len(own))
    shard: Column = F.lit(0)
    for first in firsts:
        shard = shard + (F.col("mark") >= F.lit(first)).cast("int")
    for n, mark in enumerate(own):
        shard = F.when(F.col("mark") == F.lit(mark), F.lit(shards - 1 - n)).otherwise(shard)
    lane = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(LANES)).cast("int")
    placed = rows.select("*", shard.alias("shard"), lane.alias("lane"))
    # At most shards * LANES rows.
    before = placed.groupBy("shard", "lane").agg(F.count("*").alias("n")).select(
        "shard", "lane",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("lane")) - F.col("n")).alias("before"),
    )
    number = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "mark"))
    return placed.join(F.broadcast(before), ["shard", "lane"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + number - 1).alias("slot")
    )
