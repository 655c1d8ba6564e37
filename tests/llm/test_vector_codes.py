"""Product codes against a plain version."""

from __future__ import annotations

import hashlib
import math
import random

from rulewright.llm import vector_codes
from rulewright.llm.vector_codes import compress

NAMES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
SHAPE = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    width = -(-max(len(r[1]) for r in rows) // parts)
    whole = [[max(-(2**24), min(2**24, math.floor(256 * x))) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in rows]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [near(v[p], books[p])[1] for v in cut]
            for e in range(len(books[p])):
                mine = [v[p] for v, to in zip(cut, of) if to == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    done = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in x) for x in done]
    labels = {}
    for r, e in zip(rows, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(
        ((r[0], "".join(f"{e:02x}" for _, e in x), error, labels[r[2]], sha) for r, x, error in zip(rows, done, errors)), key=str
    )


def got(frame, **given):
    return sorted((tuple(r) for r in compress(frame, **given).select(NAMES).collect()), key=str)


def made(n=300, size=32):
    rnd = random.Random(7)
    base = [[rnd.gauss(0, 0.3) for _ in range(size)] for _ in range(40)]
    rows = [(k, [x + rnd.gauss(0, 0.05) for x in rnd.choice(base)], rnd.choice([None, 1, 2])) for k in range(n)]
    rows += [(1000 + k, rows[3][1], 1) for k in range(n // 2)]  # one vector a third of all rows
    rows += [(2000, None, 1), (2001, [0.1] * (size - 1) + [None], 1), (2002, [float("nan")] * size, 2), (2003, [float("inf")] * size, 2)]
    rows += [(5, rows[7][1], 2), (5, rows[8][1], None), (None, rows[9][1], 1)]
    rnd.shuffle(rows)
    return rows


def test_codes(spark, monkeypatch):
    rows = made()
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], SHAPE + ", code string, entry int").repartition(5)
    want = plain(rows)
    assert len({r[1] for r in want}) > 50
    assert got(table) == want
    # Several salts, flushes inside a task, and members that migrate more than once.
    monkeypatch.setattr(vector_codes, "MEMBERS", 40)
    monkeypatch.setattr(vector_codes, "CHUNK", 1000)
    assert got(table) == want
    assert got(table, rounds=4) == plain(rows, rounds=4)


def test_odd_vectors(spark):
    few = [(k, [0.5 * k, -0.25], k % 2) for k in range(9)]
    assert got(spark.createDataFrame(few, SHAPE)) == plain(few)
    ties = [(k, [float(k % 3)] * 16, None) for k in range(80)]
    assert got(spark.createDataFrame(ties, SHAPE)) == plain(ties)
    large = [(k, [(-1) ** k * 1e300 / (k + 1), 3.0e4 * k, *[0.0] * 14], 1) for k in range(70)] + [(99, [], 1), (98, [1.0] * 20, 1)]
    assert got(spark.createDataFrame(large, SHAPE)) == plain(large)
    nothing = [(None, [], None), (1, None, 2)]
    assert got(spark.createDataFrame(nothing, SHAPE)) == plain(nothing)
    assert got(spark.createDataFrame([], SHAPE)) == []


def test_only_changed_parts_move(spark, monkeypatch):
    rows = made()
    table = spark.createDataFrame(rows, SHAPE).where(vector_codes.is_kept(vector_codes.F.col("embedding")))
    n = table.count()
    first = vector_codes.first_book(table, 2, 16, 64)
    members = vector_codes.stored(vector_codes.owned(vector_codes.dealt(table, first, 3), 4, 2), "m")
    second = vector_codes.updated(members, first)
    seen = vector_codes.judged(members, second, True).collect()
    assert sum(r.n for r in seen) == 16 * n
    assert 0 < sum(r.n for r in seen if r.moved) < 16 * n / 2
    assert all(len(r.members) == r.n * 8 for r in seen)
