"""Suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from rulewright.llm.suffix_dedup import drop_repeats


def plain(rows, length=400):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (60, 70, 75, 80, 90, 300)]
    rows = []
    for k in range(40):
        parts = [text(rnd.randrange(1, 60))]
        for _ in range(rnd.randrange(0, 4)):
            s = rnd.choice(shared)
            if rnd.random() < 0.5:
                a = rnd.randrange(0, len(s) // 3)
                s = s[a : len(s) - rnd.randrange(0, len(s) // 4)]
            if rnd.random() < 0.4:
                at = rnd.randrange(len(s))
                s = s[:at] + "#" + s[at + 1 :]
            parts += [s, text(rnd.randrange(0, 30))]
        rows.append((k, " ".join(parts)))
    rows += [(100, "a" * 399), (101, "a" * 400), (102, "b" * 401), (103, "ab" * 300), (104, "x " + "abc" * 250), (105, None), (106, "")]
    rows += [(107, rows[0][1]), (107, rows[1][1]), (None, rows[2][1]), (108, "é" * 205), (109, "q" + "é" * 199 + "r"), (110, shared[5][:400]), (111, "z" + shared[5][:399])]
    return rows


def test_repeats(spark, documents):
    rows = made()
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS n_bytes")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in drop_repeats(table).select(names).collect()), key=str) == plain(rows)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = sorted((tuple(r) for r in drop_repeats(documents).select(names).collect()), key=str)
    want = plain(rows)
    assert sum(r[2] for r in want) > 0
    assert got == want


def test_no_documents(spark):
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
