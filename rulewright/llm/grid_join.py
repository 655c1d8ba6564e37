"""Embedding near-dedup by an epsilon grid order join.

Vectors of unit length have a cosine of at least ``COSINE`` when they are at most
``EPSILON`` apart.  They are projected on leading principal dimensions, sorted by their
grid cell there (cells as wide as ``EPSILON``), and cut into blocks.  Intervals of the
sorted sequence are joined recursively: two intervals whose boxes are farther apart than
``EPSILON`` are skipped, others are split, down to pairs of blocks.  A block pair is
compared by one matrix product.

The dimensions are fitted on at most ``SAMPLE`` vectors.  They only decide how much is
skipped: a projection never lengthens a distance, so no pair is lost.  Equal vectors are
one node with a count, and a block pair returns one row per node, not its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.llm.common import stored
from rulewright.llm.components import bipartite_roots, components

COSINE = 0.93
EPSILON = math.sqrt(2 - 2 * COSINE)
SAMPLE = 4096
CELLS = 4
DIMENSIONS = 8
BLOCK = 1024
FAN = 4
SALTS = 4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, also when squares would over- or underflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)


def usable() -> Column:
    e = F.col("embedding")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & whole & F.exists(e, lambda x: x != 0), F.lit(False))


def principal_dimensions(nodes: DataFrame, size: int) -> np.ndarray:
    """Leading directions of at most ``SAMPLE`` vectors, those with the smallest node hashes."""
    few = nodes.where(F.col("size") == size).select("node", "embedding").orderBy("node").limit(SAMPLE).collect()
    x = unit(np.array([r.embedding for r in few]))
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=True)[2][: min(DIMENSIONS, size)].T


def blocks(nodes: DataFrame, bases: dict[int, np.ndarray]) -> DataFrame:
    """label, size, block, nodes, counts, vectors, low, high: runs of the grid order, at most ``BLOCK`` long."""
    known = nodes.sparkSession.sparkContext.broadcast(bases)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column("size"))
            places = np.zeros((len(sizes), DIMENSIONS))
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                base = known.value[size]
                places[mine, : base.shape[1]] = unit(_matrix(batch.column("embedding").take(pa.array(mine)), size)) @ base
            cells = np.floor(places / EPSILON).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places.tolist(), pa.list_(pa.float64())), *(pa.array(cells[:, k]) for k in range(CELLS))],
                [*batch.schema.names, "place", *(f"c{k}" for k in range(CELLS))],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = rows.combine_chunks()
            for at in range(0, rows.num_rows, BLOCK):
                part = rows.slice(at, BLOCK).to_batches()[0]
                size = part.column("size")[0].as_py()
                places = _matrix(part.column("place"), DIMENSIONS)
                yield pa.RecordBatch.from_pydict({
                    "label": part.column("label")[:1], "size": part.column("size")[:1], "block": pa.array([number]),
                    "nodes": pa.array([np.array(part.column("node")).tobytes()], pa.binary()),
                    "counts": pa.array([np.array(part.column("count")).tobytes()], pa.binary()),
                    "vectors": pa.array([_matrix(part.column("embedding"), size).astype(np.float64).tobytes()], pa.binary()),
                    "low": pa.array([places.min(axis=0).tolist()], pa.list_(pa.float64())),
                    "high": pa.array([places.max(axis=0).tolist()], pa.list_(pa.float64())),
                })
                number += 1

        last = None
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist()))
            start = 0
            for k in range(len(keys) + 1):
                if k == len(keys) or keys[k] != last:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    start = k
                    if k < len(keys):
                        if held:
                            yield from out(pa.Table.from_batches(held))
                            held = []
                        last = keys[k]
            if sum(b.num_rows for b in held) >= 8 * BLOCK:
                whole = pa.Table.from_batches(held)
                n = whole.num_rows // BLOCK * BLOCK
                yield from out(whole.slice(0, n))
                held = whole.slice(n).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    shape = ", ".join(f"{n} {kinds[n]}" for n in nodes.columns) + ", place array<double>, " + ", ".join(f"c{k} int" for k in range(CELLS))
    order = ["label", "size", *(f"c{k}" for k in range(CELLS)), "node"]
    placed = stored(nodes.mapInArrow(project, shape), "grid-places")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        cut, f"label {kinds['label']}, size int, block long, nodes binary, counts binary, vectors binary, low array<double>, high array<double>"
    )


def block_pairs(cut: DataFrame) -> DataFrame:
    """left, right: the pairs of blocks of one label and size that may hold a link, left up to right."""
    by = ["label", "size"]
    first = cut.select(*by, "block", "low", "high", (F.row_number().over(Window.partitionBy(*by).orderBy("block")) - 1).alias("i0"))
    first = stored(first, "boxes")
    most = first.agg(F.max("i0")).first()[0]
    if most is None:
        return first.select(F.col("block").alias("left"), F.col("block").alias("right")).limit(0)
    depth = 0
    while FAN**depth <= most:
        depth += 1

    def level(n: int) -> DataFrame:
        width = FAN**n
        corner = [
            *(F.min(F.col("low")[k]).alias(f"l{k}") for k in range(DIMENSIONS)),
            *(F.max(F.col("high")[k]).alias(f"h{k}") for k in range(DIMENSIONS)),
        ]
        return first.groupBy(*by, F.floor(F.col("i0") / width).alias("i")).agg(*corner)

    pairs = level(depth).select(*by, F.col("i").alias("a"), F.col("i").alias("b"))
    for n in range(depth - 1, -1, -1):
        boxes = level(n).withColumn("up", F.floor(F.col("i") / FAN))
        left = boxes.select(*by, F.col("up").alias("a"), F.col("i").alias("x"), *(F.col(f"{e}{k}").alias(f"x{e}{k}") for e in "lh" for k in range(DIMENSIONS)))
        right = boxes.select(*by, F.col("up").alias("b"), F.col("i").alias("y"), *(F.col(f"{e}{k}").alias(f"y{e}{k}") for e in "lh" for k in range(DIMENSIONS)))
        gaps = [F.greatest(F.lit(0.0), F.col(f"xl{k}") - F.col(f"yh{k}"), F.col(f"yl{k}") - F.col(f"xh{k}")) for k in range(DIMENSIONS)]
        apart = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
        pairs = pairs.join(left, [*by, "a"]).join(right, [*by, "b"]).where(F.col("x") <= F.col("y")).where(apart <= EPSILON**2 + 1e-9)
        pairs = stored(pairs.select(*by, F.col("x").alias("a"), F.col("y").alias("b")), "intervals")
    name = first.select(*by, F.col("i0").alias("a"), F.col("block").alias("left"))
    other = first.select(*by, F.col("i0").alias("b"), F.col("block").alias("right"))
    return pairs.join(name, [*by, "a"]).join(other, [*by, "b"]).select("left", "right")


def links_of_pairs(pairs: DataFrame, cut: DataFrame, cosine: float) -> DataFrame:
    """node, links, root: per block pair and node with links, their number and a node of its component."""
    near = 1e-9

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["size"])
                mine = (np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["counts"], np.int64), unit(vectors), vectors)
                if not row["member"]:
                    hub = mine
                    continue
                s = hub[2] @ mine[2].T
                hit = s >= cosine
                for i, j in np.argwhere(np.abs(s - cosine) < near).tolist():
                    a, b = hub[3][i], mine[3][j]
                    hit[i, j] = a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= cosine
                same = row["left"] == row["right"]
                if same:
                    hit |= hit.T
                    np.fill_diagonal(hit, False)
                left, right = bipartite_roots(hit | np.eye(len(hit), dtype=bool) if same else hit)
                out = [(hub[0][k], hit[k] @ mine[1], hub[0][left[k]]) for k in np.flatnonzero(hit.any(axis=1))]
                if not same:
                    out += [(mine[0][k], hub[1] @ hit[:, k], hub[0][right[k]]) for k in np.flatnonzero(hit.any(axis=0))]
                columns = zip(*out) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in columns], ["node", "links", "root"])

    data = ["size", "nodes", "counts", "vectors"]
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("right"), F.lit(SALTS)).cast("int"))
    members = salted.join(cut.select(F.col("block").alias("right"), *data), "right").select("left", "salt", F.lit(1).alias("member"), "right", *data)
    hubs = salted.select("left", "salt").distinct().join(cut.select(F.col("block").alias("left"), *data), "left")
    hubs = hubs.select("left", "salt", F.lit(0).alias("member"), F.col("left").alias("right"), *data)
    ordered = members.union(hubs).repartition("left", "salt").sortWithinPartitions("left", "salt", "member")
    return ordered.mapInArrow(compare, "node long, links long, root long")


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows``.

    Vectors of one label and one length link when their cosine is at least ``cosine``
    (``COSINE`` or more, since the grid is made for it).  Rows whose label or vector is
    NULL, whose vector is empty or zero, or holds NULL or a number that is not finite
    link with nothing.  Equal vectors link; repeated rows count as rows of their own.
    component_id is the smallest vec_id reachable (NULL ids name no component).  Other
    columns are not read.  An empty table gives no rows.
    """
    good = usable()
    named = rows.select("vec_id", "label", "embedding").select(
        "vec_id", F.when(good, F.xxhash64("label", "embedding")).alias("node"), F.when(good, F.col("label")).alias("label"),
        F.when(good, F.col("embedding")).alias("embedding"),
    )
    nodes = stored(
        named.where("node IS NOT NULL").groupBy("node", "label", "embedding").agg(F.count("*").alias("count"), F.min("vec_id").alias("least"))
        .withColumn("size", F.size("embedding")),
        "vectors",
    )
    bases = {r.size: principal_dimensions(nodes, r.size) for r in nodes.select("size").distinct().collect()}
    cut = stored(blocks(nodes.drop("least"), bases), "blocks")
    found = stored(links_of_pairs(block_pairs(cut), cut, cosine), "vector-links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = nodes.select("node", "count", "least").join(sums, "node", "left").join(roots, "node", "left").select(
        "node", (F.col("count") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"), "least"
    )
    smallest = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = whole.join(smallest, "root").select("node", "n_links", "component_id")
    out = named.select("vec_id", "node").join(facts, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
