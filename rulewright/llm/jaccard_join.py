"""N-gram Jaccard join with several global token orders.

Two shingle sets with Jaccard similarity of 0.8 or more share k tokens among the first
``n - ceil(0.8 n) + k`` tokens of each, in any global order.  Three orders are used.
Each puts tokens that many documents hold last and orders the others by a hash of its
own.  In the first order k is a tenth of the set and one more, so documents that only
have a passage in common are no candidates; pairs must also share a prefix token (k = 1)
in the other orders before they are verified by the size of their intersection.

Documents with equal sets are one node.  The aim is the components, so a list of nodes
that share a token is not expanded into pairs: every node is first compared with one
pivot of its list, linked nodes become one component, and lists inside one component are
done.  After ``ROUNDS`` rounds with other pivots, all nodes of different components that
share one of their rarest prefix tokens are compared in blocks, so no link between
components is missed and no pair is a row.  A block holds nodes of one component where it
is large, else nodes that the rounds tied together or that have their least prefix token
in common, up to ``BLOCK_TOKENS`` tokens and ``BLOCK_NODES`` nodes.  Of two blocks the prefixes of the first order
travel first; a matrix product counts what nodes share, and only nodes with as many shared
tokens as a partner of fitting size asks for go on.  Of those the prefixes of all three
orders are intersected, and whole sets travel only for nodes that pass every order with
the same partner.

Tokens travel to their lists as packed arrays, one per task and bucket.  A task compares
one pair of blocks at a time.  A text is hashed whole, in a slice of its own if it is
longer than a megabyte; its distinct shingles are what a task must hold of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from rulewright.llm.bitmap import possible
from rulewright.llm.common import lean, stored
from rulewright.llm.components import bipartite_roots, components
from rulewright.llm.textbytes import U64, mix, shingle_sets, signed, slices

#: Seeds of the second and third order; the first orders tokens by their own value.
SEEDS = (0x5DEECE66D1234567, 0x2545F4914F6CDD1D)
ROUNDS = 2
#: A token with more than one in 2^18 of all set members is frequent, so at most 2^18 are.
FREQUENT_BITS = 18
#: Tokens that a task holds at once, and bytes of text whose shingles are worked out at once.
CHUNK = 1 << 20
SLICE = 1 << 20
#: Prefix tokens that one bucket should not exceed.
BUCKET_TOKENS = 4_000_000
SALTS = 32
#: A component of so many nodes has blocks of its own.
LARGE = 256
#: Prefix tokens of a block, unless one node has more.
BLOCK_TOKENS = 1 << 18
#: Nodes of a block, so that a matrix with a cell for each pair of nodes fits a task.
BLOCK_NODES = 4096
#: Tokens and rows of a matrix product.
COLUMNS = 2048
STRIP = 512


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a token set."""
    return int(signed(mix(np.array([np.add.reduce(mix(tokens ^ U64(0x9E3779B97F4A7C15))) + U64(len(tokens))], U64)))[0])


def prefix_length(n: int, shared: int = 1) -> int:
    return n - -(-4 * n // 5) + shared


def prefix(tokens: np.ndarray, frequent: np.ndarray, seed: int = 0) -> np.ndarray:
    """The first tokens of a sorted set in one order (0: the first), so many that similar sets share
    one of them, or in the first order a tenth of the set and one more."""
    late = np.zeros(len(tokens), bool)
    if len(frequent):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        late = frequent[at] == tokens
    keys = mix(tokens ^ U64(seed)) if seed else tokens
    return tokens[np.lexsort((keys, late))[: prefix_length(len(tokens), 1 if seed else len(tokens) // 10 + 1)]]


def describe(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, node, n_shingles) for documents and (token, seen) for tokens that are
    frequent in some part of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "node", "n_shingles", "token", "seen"]
        waiting: list[np.ndarray] = []
        held = 0

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(waiting or [np.zeros(0, U64)]), return_counts=True)
            often = counts >= max(2, held >> 16)
            n = int(often.sum())
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(signed(tokens[often])), pa.array(counts[often])], names)

        for batch in batches:
            for i, j, data, at in slices(batch.column("text"), SLICE):
                sets = list(shingle_sets(data, at))
                sizes = [len(s) for s in sets]
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(sizes, pa.int64()), none, none], names
                )
                waiting += sets
                held += sum(sizes)
                if held >= CHUNK:
                    yield frequent()
                    waiting, held = [], 0
        yield frequent()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lean(run), "doc_id long, node long, n_shingles long, token long, seen long"
    )


def frequent_tokens(described: DataFrame, total: int) -> np.ndarray:
    """At most 2^18 tokens, sorted."""
    least = max(64, total >> FREQUENT_BITS)
    rows = described.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") > least)
    return np.sort(np.array([r.token for r in rows.select("token").collect()], np.int64).view(U64))


def shared_lists(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """token, node, n: the nodes with each prefix token of the first order that several nodes have."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes, sizes, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            t = np.concatenate(tokens)
            row = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
            o, n = np.array(nodes, np.int64), np.array(sizes, np.int32)
            bucket = (mix(t) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            # A node is named once per bucket; its tokens tell which of the names is theirs.
            out = []
            for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                k = order[edges[b] : edges[b + 1]]
                here, which = np.unique(row[k], return_inverse=True)
                which = which.astype(np.uint16 if len(here) <= 1 << 16 else np.uint32)
                out.append((b, t[k].tobytes(), which.tobytes(), o[here].tobytes(), n[here].tobytes()))
            columns = zip(*out)
            kinds = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "tokens", "which", "nodes", "sizes"])

        for batch in batches:
            for _, _, data, at in slices(batch.column("text"), SLICE):
                for s in shingle_sets(data, at):
                    if len(s):
                        tokens.append(prefix(s, known.value))
                        nodes.append(node_of(s))
                        sizes.append(len(s))
                        held += len(tokens[-1])
                if held >= CHUNK:
                    yield out()
                    tokens, nodes, sizes, held = [], [], [], 0
        if held:
            yield out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for cells in zip(*(batch.column(c) for c in ("tokens", "which", "nodes", "sizes"))):
                tokens, which, nodes, sizes = (x.as_buffer() for x in cells)
                at = np.frombuffer(which, f"u{8 * which.size // tokens.size}")
                parts.append((np.frombuffer(tokens, U64), np.frombuffer(nodes, np.int64)[at], np.frombuffer(sizes, np.int32)[at]))
        if not parts:
            return
        t, o, n = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((o, t))
        t, o, n = t[order], o[order], n[order]
        first = np.append(True, (t[1:] != t[:-1]) | (o[1:] != o[:-1]))
        t, o, n = t[first], o[first], n[first]
        same = t[1:] == t[:-1]
        several = np.append(same, False) | np.append(False, same)
        table = pa.RecordBatch.from_arrays([pa.array(signed(t[several])), pa.array(o[several]), pa.array(n[several])], ["token", "node", "n"])
        for at in range(0, table.num_rows, 100_000):
            yield table.slice(at, 100_000)

    dealt = docs.select("text").mapInArrow(lean(deal), "bucket int, tokens binary, which binary, nodes binary, sizes binary")
    return dealt.repartition(buckets, "bucket").mapInArrow(lean(gather), "token long, node long, n int")


def _least_shared() -> Column:
    """Prefix tokens that a node of n tokens shares with any similar one, of 0.8 n tokens at least."""
    return (F.floor(F.ceil(F.col("n") * 4 / 5) / 10) + 1).cast("int")


def worth_comparing(lists: DataFrame) -> DataFrame:
    """``lists`` without most nodes that share too few prefix tokens with all others together.

    The rows stay where they are, those of a token beside each other; a node that passes without need meets nobody.
    """
    nodes = lists.groupBy("node", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= _least_shared()).select("node")
    return stored(possible(lists, "node", stored(nodes, "open-nodes")), "open-lists")


def rarest(lists: DataFrame) -> DataFrame:
    """``lists`` with the rarest tokens of each node only, so many that similar nodes still share one.

    Of s tokens, k of which a similar node has, the first s - k + 1 in any common order will do.
    """
    common = lists.groupBy("token").agg(F.count("*").alias("held"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("held", "token"))
    sizes = lists.groupBy("node").agg(F.count("*").alias("s"))
    return (
        lists.join(common, "token").where("held > 1").withColumn("rank", rank).join(sizes, "node")
        .where(F.col("rank") <= F.col("s") - _least_shared() + 1).select("token", "node", "n")
    )


def node_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, tokens (sorted, packed) for the nodes in ``wanted`` (columns id, node): one document's text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_pylist()
            for i, _, data, at in slices(batch.column("text"), SLICE):
                found = [(nodes[i + k], s) for k, s in enumerate(shingle_sets(data, at))]
                found = [(node, s.tobytes()) for node, s in found if len(s) and node_of(s) == node]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["node", "tokens"])

    # Texts move only where their document may be wanted.
    texts = possible(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted.select("id"))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
    return texts.mapInArrow(lean(run), "node long, tokens binary")


def verified(pairs: DataFrame, sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """The rows of ``pairs`` (node, pivot) that are links: prefixes of all orders meet, and so do 0.8 of the union."""
    known = pairs.sparkSession.sparkContext.broadcast(frequent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, hub, hub_prefixes = None, None, []
        for batch in batches:
            links = []
            columns = [batch.column(c) for c in ("pivot", "member", "node", "tokens")]
            for at, member, node, tokens in zip(*(c.to_pylist() for c in columns[:3]), columns[3]):
                s = np.frombuffer(tokens.as_buffer(), U64)
                if not member:
                    if at != pivot:
                        pivot, hub, hub_prefixes = at, s, [prefix(s, known.value, seed) for seed in SEEDS]
                    continue
                if not all(np.isin(prefix(s, known.value, seed), p).any() for seed, p in zip(SEEDS, hub_prefixes)):
                    continue
                shared = len(np.intersect1d(s, hub, assume_unique=True))
                if 100 * shared >= 80 * (len(s) + len(hub) - shared):
                    links.append((at, node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])

    sets = possible(sets, "node", pairs.select("node").union(pairs.select("pivot")))
    salted = pairs.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int"))
    members = salted.join(sets, "node").select("pivot", "salt", F.lit(1).alias("member"), "node", "tokens")
    pivots = salted.select("pivot", "salt").distinct().join(sets.select(F.col("node").alias("pivot"), "tokens"), "pivot")
    pivots = pivots.select("pivot", "salt", F.lit(0).alias("member"), F.col("pivot").alias("node"), "tokens")
    ordered = members.union(pivots).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member")
    return ordered.mapInArrow(lean(compare), "a long, b long")


def _with_component(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("comp", F.col("node"))
    return lists.join(roots, "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("comp"))


def _fit() -> Column:
    """Sizes that allow a similarity of 0.8."""
    return 5 * F.least("n", "other_n") >= 4 * F.greatest("n", "other_n")


def _enough() -> Column:
    """As many shared prefix tokens as a similarity of 0.8 asks for."""
    return F.count("*") >= F.floor(F.min(F.least("n", "other_n")) / 10) + 1


def star_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """node, pivot: each node with the pivot it shares most prefix tokens with, of another component."""
    pivot = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), F.col("node").alias("pivot"), F.col("comp").alias("other"), F.col("n").alias("other_n")))
    hubs = lists.groupBy("token").agg(pivot.alias("p"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token", "p.*")
    return (
        lists.join(hubs, "token").where(F.col("comp") != F.col("other")).where(_fit())
        .groupBy("node", "pivot").agg(F.count("*").alias("shared"), _enough().alias("enough")).where("enough")
        .groupBy("node").agg(F.max(F.struct("shared", "pivot")).alias("best"))
        .select("node", "best.pivot")
    )


def blocks_of(packed: DataFrame, clusters: DataFrame) -> DataFrame:
    """node, comp, block, owner: ``owner`` is the component that all nodes of the block are in, if it is large."""
    facts = packed.select("node", "comp", F.size("tokens").alias("held"), F.array_min(F.transform("tokens", lambda t: F.xxhash64(t))).alias("least"))
    nodes = facts.join(clusters.select("node", F.col("root").alias("cluster")), "node", "left")
    sizes = nodes.groupBy("comp").agg(F.count("*").alias("size"))
    owner = F.when(F.col("size") >= LARGE, F.col("comp"))
    pool = F.xxhash64(owner.isNotNull(), F.col("cluster").isNotNull(), F.coalesce(owner, F.col("cluster"), F.col("least")))
    nodes = nodes.join(sizes, "comp").select("node", "comp", "held", owner.alias("owner"), pool.alias("pool"))
    pools = nodes.groupBy("pool").agg(F.ceil(F.greatest(F.sum("held") / BLOCK_TOKENS, F.count("*") / BLOCK_NODES)).alias("parts"))
    block = F.xxhash64("pool", F.pmod(F.xxhash64("node"), F.col("parts")))
    return nodes.join(pools, "pool").select("node", "comp", "owner", block.alias("block"))


def block_pairs(rare: DataFrame, blocks: DataFrame) -> DataFrame:
    """left, right: blocks with nodes of different components that share a token in ``rare`` lists."""
    facts = blocks.groupBy("block").agg(F.first("owner").alias("owner"), (F.min("comp") != F.max("comp")).alias("mixed"))
    tokens = rare.select("token", "node").join(blocks.select("node", "block"), "node").select("token", "block").distinct().join(facts, "block")
    other = tokens.select("token", F.col("block").alias("right"), F.col("owner").alias("other_owner"))
    apart = F.when(F.col("block") == F.col("right"), F.col("mixed")).otherwise(~F.col("owner").eqNullSafe(F.col("other_owner")) | F.col("owner").isNull())
    pairs = tokens.join(other, "token").where((F.col("block") <= F.col("right")) & apart)
    return pairs.select(F.col("block").alias("left"), "right").distinct()


def sides(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """left, right, side, node: the nodes of both blocks of each pair; a block with itself has one side."""
    nodes = blocks.select("block", "node")
    first = pairs.join(nodes.withColumnRenamed("block", "left"), "left").select("left", "right", F.lit(0).alias("side"), "node")
    second = pairs.where("left <> right").join(nodes.withColumnRenamed("block", "right"), "right")
    return first.union(second.select("left", "right", F.lit(1).alias("side"), "node"))


class Facing:
    """The nodes of a pair of blocks, with as many token sets each as the table has columns of them."""

    def __init__(self, rows: list[tuple], lists: int):
        self.left, self.right = rows[0][0], rows[0][1]
        one = [r for r in rows if r[2] == 0]
        self.rows = (one, one if self.left == self.right else [r for r in rows if r[2] == 1])
        self.node, self.n, self.comp = ([np.array([r[k] for r in side], np.int64) for side in self.rows] for k in (3, 4, 5))
        self.sets = [[[r[6 + k] for r in side] for side in self.rows] for k in range(lists)]

    def fits(self) -> np.ndarray:
        """Which nodes may be similar by their sizes and are not known to be connected."""
        one, other = self.n[0][:, None], self.n[1][None, :]
        hit = 5 * one >= 4 * other
        hit &= 5 * other >= 4 * one
        hit &= self.comp[0][:, None] != self.comp[1][None, :]
        return hit

    def enough(self) -> np.ndarray:
        """As many shared tokens of the first order's prefixes as a similarity of 0.8 asks for."""
        one, other = ((n // 10 + 1).astype(np.int32) for n in self.n)
        return np.minimum(one[:, None], other[None, :])

    def shared(self, k: int) -> np.ndarray:
        return _meets(*self.sets[k])


def face_to_face(members: DataFrame, facts: DataFrame, judge, shape: str) -> DataFrame:
    """``judge`` of each pair of blocks; ``facts`` has node, n, comp and one or more arrays of tokens."""
    names = [c for c in facts.columns if c not in ("node", "n", "comp")]
    kept = StructType.fromDDL(shape).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in judge(Facing(rows, len(names)))], kept)

        waiting: list[tuple] = []
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("left", "right", "side", "node", "n", "comp")]
            lists = [[np.sort(np.array(x.values, np.int64).view(U64)) for x in batch.column(c)] for c in names]
            for row in zip(*plain, *lists):
                if waiting and waiting[-1][:2] != row[:2]:
                    yield out(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield out(waiting)

    ordered = members.join(facts, "node").select("left", "right", "side", "node", "n", "comp", *names)
    return ordered.repartition("left", "right").sortWithinPartitions("left", "right", "side", "node").mapInArrow(lean(run), shape)


def _hit(facing: Facing, hit: np.ndarray) -> list[np.ndarray]:
    """left, right, side, node of the nodes with a partner."""
    some = [facing.node[0][hit.any(1)], facing.node[1][hit.any(0)]]
    if facing.left == facing.right:
        some = [np.union1d(*some), some[1][:0]]
    n = sum(map(len, some))
    return [np.full(n, facing.left), np.full(n, facing.right), np.repeat([0, 1], [len(x) for x in some]), np.concatenate(some)]


def by_count(facing: Facing) -> list[np.ndarray]:
    return _hit(facing, facing.fits() & (facing.shared(0) >= facing.enough()))


def by_orders(facing: Facing) -> list[np.ndarray]:
    hit = facing.fits()
    for k, least in ((0, facing.enough()), (1, 1), (2, 1)):
        if hit.any():
            hit &= facing.shared(k) >= least
    return _hit(facing, hit)


def by_sets(facing: Facing) -> list[np.ndarray]:
    """Enough links to connect what is linked: a, b."""
    hit = facing.fits()
    if hit.any():
        for shared, n, row in zip(facing.shared(0), facing.n[0], hit):
            shared = shared.astype(np.int64)
            row &= 100 * shared >= 80 * (n + facing.n[1] - shared)
    rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    first, second = bipartite_roots(hit)
    a = np.concatenate([facing.node[0][rows], facing.node[1][columns]])
    b = np.concatenate([facing.node[0][first[rows]], facing.node[0][second[columns]]])
    return [a[a != b], b[a != b]]


def orders_of(sets: DataFrame, nodes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """node, second, third: the prefixes in the other orders of the given nodes, and of some more."""
    known = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, tokens in zip(batch.column("node").to_pylist(), batch.column("tokens")):
                s = np.frombuffer(tokens.as_buffer(), U64)
                found = [pa.array([signed(prefix(s, known.value, seed))], pa.list_(pa.int64())) for seed in SEEDS]
                yield pa.RecordBatch.from_arrays([pa.array([node]), *found], ["node", "second", "third"])

    return possible(sets, "node", nodes).mapInArrow(lean(run), "node long, second array<long>, third array<long>")


def block_links(pairs: DataFrame, blocks: DataFrame, packed: DataFrame, sets: DataFrame, frequent: np.ndarray) -> DataFrame:
    """a, b: enough links between the nodes of each pair of blocks to connect what is linked there."""
    seat = "left long, right long, side long, node long"
    counted = stored(face_to_face(sides(pairs, blocks), packed, by_count, seat), "counted-nodes")
    nodes = packed.withColumnRenamed("tokens", "first")
    others = orders_of(sets, counted.select("node"), frequent)
    passed = stored(face_to_face(counted, nodes.join(others, "node"), by_orders, seat), "ordered-nodes")
    # Whole sets, of those nodes only.
    facts = possible(sets, "node", passed.select("node")).join(passed.select("node").distinct(), "node").join(packed.select("node", "n", "comp"), "node")
    return face_to_face(passed, _unpacked(facts), by_sets, "a long, b long")


def _unpacked(facts: DataFrame) -> DataFrame:
    """node, n, comp, tokens with the packed tokens as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("tokens")]
            edges = np.append(0, np.cumsum([len(x) for x in tokens]))
            flat = pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "n", "comp")), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat)], ["node", "n", "comp", "tokens"]
            )

    return facts.select("node", "n", "comp", "tokens").mapInArrow(lean(run), "node long, n int, comp long, tokens array<long>")


def _meets(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted sets, worked out for ``COLUMNS`` tokens at a time."""
    both = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        tokens, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
        known = both[at] == tokens
        order = np.argsort(at[known], kind="stable")
        return rows[known][order], at[known][order]

    sides = [(len(x), *places(x)) for x in (left, right)]
    for first in range(0, len(both), COLUMNS):
        parts = []
        for n, rows, at in sides:
            some = slice(*np.searchsorted(at, (first, first + COLUMNS)))
            part = np.zeros((n, min(COLUMNS, len(both) - first)), np.float32)
            part[rows[some], at[some] - first] = 1
            parts.append(part)
        for row in range(0, len(out), STRIP):
            out[row : row + STRIP] += parts[0][row : row + STRIP] @ parts[1].T
    return out


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Words are runs without white space, A-Z lower-cased; one to four words are one
    shingle.  Texts without words (NULL too) have no shingle and are alone.  component_id
    is the smallest doc_id of the component.  Rows with one doc_id are judged by their
    own texts; a NULL doc_id takes part but names no component, so a component without
    ids has NULL.  Tokens are 64-bit hashes of shingles.  Other columns are not read.
    An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    described = stored(describe(docs), "shingle-sets")
    rows = described.where("n_shingles IS NOT NULL").select("doc_id", "node", "n_shingles")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    frequent = frequent_tokens(described, total)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (5 * BUCKET_TOKENS))
    lists = worth_comparing(stored(shared_lists(docs, frequent, buckets), "shared-lists"))
    ids = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"))
    # Written, so that its size is known before texts are moved to it.
    wanted = stored(ids.join(lists.select("node").distinct(), "node"), "wanted-nodes")
    sets = stored(node_sets(docs, wanted), "node-sets")
    links, roots, clusters = None, None, None
    for turn in range(ROUNDS):
        pairs = stored(star_pairs(_with_component(lists, roots), turn), "pairs")
        found = stored(verified(pairs, sets, frequent), "found")
        links = found if links is None else links.union(found)
        near = pairs.select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        clusters = near if clusters is None else clusters.union(near)
        roots = components(links)
    grouped = _with_component(lists, roots)
    packed = grouped.groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.collect_list("token").alias("tokens"))
    packed = stored(packed, "node-prefixes")
    blocks = stored(blocks_of(packed, components(clusters)), "blocks")
    last = stored(block_pairs(rarest(lists), blocks), "block-pairs")
    roots = components(links.union(stored(block_links(last, blocks, packed, sets, frequent), "found")))
    named = rows.join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component"))
    smallest = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
