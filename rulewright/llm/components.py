"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node in ``links`` (columns a, b).

    In each round every node is tied to the smallest of its neighbours, first its larger
    ones (large star), then its smaller ones (small star), until nothing changes.  Nodes
    with very many links are handled by joins, which adaptive execution splits.  NULL
    nodes have no links.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(a, b).distinct(), "links")
    seen = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("low").alias("a"), F.col("v").alias("b"))
        least = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(least, "b").where("a <> low").select(F.col("low").alias("a"), F.col("a").alias("b"))
        edges = stored(small.union(least.select("low", "b")).distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)


def bipartite_roots(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a matrix of links, a number per row and column that is equal inside a component."""
    n = np.int32(len(hit))
    rows = np.arange(n, dtype=np.int32)
    while True:
        columns = np.where(hit, rows[:, None], n).min(axis=0)
        fresh = np.minimum(rows, np.where(hit, columns[None, :], n).min(axis=1))
        if (fresh == rows).all():
            return rows, columns
        rows = fresh
