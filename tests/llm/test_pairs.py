"""Similarity joins against brute force."""

from __future__ import annotations

import random

import brute
import pytest

from rulewright.llm.components import components
from rulewright.llm.grid_join import near_vectors
from rulewright.llm.jaccard_join import near_copies


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def some_texts():
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(n)) for n in (3, 5, 12, 40, 120, 120)]
    out = []
    for text in base:
        out.append(text)
        for _ in range(9):
            w = text.split()
            for _ in range(rnd.randrange(0, max(2, len(w) // 25))):
                w[rnd.randrange(len(w))] = "x" + str(rnd.randrange(9))
            out.append(rnd.choice([" ", "\n", "\t "]).join(w).upper() if rnd.random() < 0.3 else " ".join(w))
    return out


def test_near_copies(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(1000 + k, t) for k, t in enumerate(some_texts())]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "One"), (2004, "one"), (None, "one"), (2004, "two three"), (None, "alone here"), (2005, "É é")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS token", "3 AS component_id")
    assert rows_of(near_copies(table)) == brute.near_copies(rows)


def test_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr("rulewright.llm.jaccard_join.BLOCK_TOKENS", 60)
    monkeypatch.setattr("rulewright.llm.jaccard_join.LARGE", 2)
    rows = list(enumerate(some_texts()))
    assert rows_of(near_copies(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.near_copies(rows)


def test_no_documents(spark):
    assert rows_of(near_copies(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_near_vectors(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        v = [rnd.gauss(0, 1) for _ in range(6)]
        for j in range(rnd.randrange(1, 7)):
            rows.append((len(rows), k % 3, [x + rnd.gauss(0, 0.18) for x in v] if j else v))
    rows += [(900, 0, rows[0][2]), (901, 0, rows[0][2]), (901, 0, rows[0][2]), (902, 1, rows[0][2]), (903, None, rows[0][2])]
    rows += [(904, 0, None), (905, 0, []), (906, 0, [0.0] * 6), (907, 0, [float("nan")] * 6), (908, 0, [None] + [1.0] * 5)]
    rows += [(909, 0, [float("inf")] * 6), (None, 0, rows[0][2]), (910, 0, [1.0, 2.0]), (911, 0, [2.0, 4.0]), (912, 0, [1e-200] * 6), (913, 0, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS node", "2 AS size")
    want = brute.near_vectors([r if r[0] != 912 else (912, 0, [1.0] * 6) for r in rows])
    assert rows_of(near_vectors(table)) == want


def test_no_vectors(spark):
    assert rows_of(near_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))) == []


@pytest.mark.parametrize("shape", ["chain", "star", "two"])
def test_components(spark, shape):
    links = {"chain": [(k, k + 1) for k in range(40)], "star": [(7, k) for k in range(30)], "two": [(1, 2), (2, 1), (5, 5), (9, 4), (None, 3)]}[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {"chain": {k: 0 for k in range(41)}, "star": {k: 0 for k in range(30)}, "two": {1: 1, 2: 1, 9: 4, 4: 4}}[shape]
    assert got == want


def test_a_family_of_related_texts(spark, monkeypatch):
    """Texts that share much and are no near copies: few pairs of blocks, and the links among them found."""
    import rulewright.llm.jaccard_join as join

    rnd = random.Random(9)
    pool = [[f"w{rnd.randrange(10**6)}" for _ in range(30)] for _ in range(300)]
    rows = []
    for k in range(120):
        parts = [rnd.choice(pool) for _ in range(40)]
        rows.append((k, " ".join(w for p in parts for w in p)))
    for k in range(0, 20, 4):  # near copies, of which the rounds may find some
        words = rows[k][1].split()
        words[50:60] = ["x"] * 10
        rows.append((500 + k, " ".join(words)))
    made = []
    kept = join.block_pairs
    monkeypatch.setattr(join, "block_pairs", lambda *given: made.append(kept(*given)) or made[-1])
    monkeypatch.setattr(join, "ROUNDS", 1)
    got = rows_of(near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.near_copies(rows)
    assert made[0].count() < 120 * 119 / 2 / 4


def test_blocks_of_every_size(spark, monkeypatch):
    """Small blocks and no rounds to speak of: the blocks find every link."""
    import rulewright.llm.jaccard_join as join

    rows = [(k, t) for k, t in enumerate(some_texts())]
    for tokens, large in ((40, 2), (1 << 18, 256)):
        monkeypatch.setattr(join, "BLOCK_TOKENS", tokens)
        monkeypatch.setattr(join, "LARGE", large)
        monkeypatch.setattr(join, "star_pairs", lambda lists, turn: lists.select("node", lists.node.alias("pivot")).limit(0))
        assert rows_of(near_copies(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.near_copies(rows)


def test_very_long_texts(spark):
    rnd = random.Random(2)
    words = [f"v{rnd.randrange(10**7)}" for _ in range(400_000)]
    changed = list(words)
    changed[1000:21000] = ["y"] * 20000
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:200_000])), (4, "a b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: len(brute.shingles(t)) for k, t in rows}
    assert got == {1: (sets[1], 1), 2: (sets[2], 1), 3: (sets[3], 3), 4: (1, 4)}


def test_a_pair_of_blocks_takes_little_memory():
    """Matrices with a cell for each pair of nodes are few and of small numbers."""
    import tracemalloc

    import numpy as np

    import rulewright.llm.jaccard_join as join

    n, rnd = 1500, np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 1 << 15, 40).astype(np.uint64)) for _ in range(n)]
    rows = [(1, 2, side, side * n + k, len(s), side * n + k, s) for side in (0, 1) for k, s in enumerate(sets)]
    found = {}
    for judge in (join.by_count, join.by_orders, join.by_sets):
        facing = join.Facing([(*r, r[6], r[6]) for r in rows], 3)
        tracemalloc.start()
        found[judge] = judge(facing)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 25 * n * n, judge
    assert {(b - n if b >= n else b) for b in found[join.by_sets][0].tolist()} == set(range(n))


def test_blocks_have_a_bounded_number_of_nodes(spark, monkeypatch):
    import rulewright.llm.jaccard_join as join

    monkeypatch.setattr(join, "BLOCK_NODES", 20, raising=False)
    packed = spark.range(1000).selectExpr("id AS node", "0L AS comp", "array(7L) AS tokens")
    clusters = spark.createDataFrame([], "node long, root long")
    blocks = join.blocks_of(packed, clusters)
    assert blocks.count() == 1000 and blocks.groupBy("block").count().agg({"count": "max"}).first()[0] < 60
