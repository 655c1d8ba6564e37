"""Operators on single documents: edge cases and plain versions."""

from __future__ import annotations

import hashlib
import math
import time
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from rulewright.llm import decontaminate, hmm, line_dedup, packing, quality, shards, url_filter
from rulewright.llm.queries import tokenizer_path

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (None, "no id here"), (5, "twice"), (5, "twice"), (6, "x" * 70_000), (7, "Ünï ↯ 漢字 \n" * 300)]
CLASH = "doc_id long, text string, n_lines int, __importance int, kept string, importance int, key int"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, 4) for r in rows], CLASH)


def nothing(spark):
    return spark.createDataFrame([], CLASH)


def lines_left(rows):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(brute.LOWER)
    seen = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                seen.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in seen.items() if len(v) >= 5}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines(spark):
    shared, short = "A shared LINE of forty code points, or more é", "a short one"
    rows = [*ODD, *((10 + k, f"own {k}\n {shared.swapcase()}\t\n{short}\n{shared}\n") for k in range(6)), (20, "z" * 40), (None, shared)]
    upper = [(i, t and t.replace(shared.swapcase(), shared.upper().replace("É", "é"))) for i, t in rows]
    done = line_dedup.drop_shared_lines(odd(spark, upper))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in done.collect()), key=str)
    assert got == lines_left(upper) and sum(r[2] for r in got) > 8
    assert line_dedup.drop_shared_lines(nothing(spark)).count() == 0


@pytest.fixture(scope="module")
def token_ids():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(pieces, rows, token_ids):
    want = Counter((i, tuple(token_ids(t))) for i, t in rows)
    left, got = {}, Counter()
    for p in pieces:
        left.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for (i, n), parts in left.items():
        full = [ids for (j, ids), k in want.items() if j == i and len(ids) == n for _ in range(k)]
        starts = sorted((p.start, p.length) for p in parts)
        spots = Counter(x for a, m in starts for x in range(a, a + m))
        assert spots == Counter(x for ids in full for x in range(len(ids)))
        for p in parts:
            assert p.ids_crc32 in {zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for ids in full}
        got.update(((i, ids) for ids in full))
    assert got == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    total = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= 2048
        total += end if end & (end - 1) == 0 else 2048
    assert total == sum(len(ids) * k for (_, ids), k in want.items())  # nothing is padded


def test_packing(spark, documents, token_ids):
    signs = [(30, "Don't we've 'S ''t; “a”,b… x!y?z é,è. ×, A.B,C! 12.5 <|endoftext|> <|ENDOFTEXT|> a\u0301, \u00a0b\u2003c \u0130I")]
    rows = [*ODD, *signs]
    check_packing(packing.pack(odd(spark, rows), tokenizer_path()).collect(), rows, token_ids)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    check_packing(packing.pack(documents, tokenizer_path()).collect(), rows, token_ids)
    assert packing.pack(nothing(spark), tokenizer_path()).count() == 0


def test_step_groups_are_full(spark, documents):
    steps = Counter()
    for r in packing.pack(documents, tokenizer_path()).collect():
        steps[r.step_group] += r.length
    assert max(steps.values()) == packing.STEP_TOKENS and sum(v < packing.STEP_TOKENS for v in steps.values()) <= 2


def test_hmm_base_scores(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + ODD
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = [(i, [*brute.words(t), None]) for i, t in rows]
    seen = Counter(w for i, ws in tokens for w in ws if not held[i])
    n, v = sum(seen.values()), len(seen)
    want = sorted(((i, held[i], len(ws), sum(seen[w] > 0 for w in ws), n, round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for i, ws in tokens), key=str)
    found = hmm.score(documents.select("doc_id", "text").union(odd(spark).select("doc_id", "text")), rounds=2).collect()
    assert sorted(((*tuple(r)[:5], round(r.base_score, 4)) for r in found), key=str) == want
    mine = [r for r in found if r.held_out]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)
    assert hmm.score(nothing(spark)).count() == 0


def test_forward_and_expected_counts_by_enumeration():
    rnd = np.random.default_rng(1)
    emit = rnd.random((hmm.CLASSES, hmm.STATES))
    move = rnd.random((hmm.STATES, hmm.STATES))
    model = hmm.Model(np.full(hmm.STATES, 1 / hmm.STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    kinds, sizes = rnd.integers(0, 50, 6), np.array([3, 1, 2])

    def paths(ks):
        out = [((z,), model.start[z] * model.emit[ks[0], z]) for z in range(hmm.STATES)]
        for k in ks[1:]:
            out = [((*p, z), w * model.move[p[-1], z] * model.emit[k, z]) for p, w in out for z in range(hmm.STATES)]
        return out

    parts = np.split(kinds, np.cumsum(sizes)[:-1])
    assert np.allclose(hmm.forward(model, kinds, sizes), [math.log10(sum(w for _, w in paths(p))) for p in parts])
    start, moves, emits = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.CLASSES, hmm.STATES))
    for p in parts:
        whole = paths(p)
        total = sum(w for _, w in whole)
        for path, w in whole:
            start[path[0]] += w / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += w / total
            for z, k in zip(path, p):
                emits[k, z] += w / total
    for got, want in zip(hmm.expected(model, kinds, sizes), (start, moves, emits)):
        assert np.allclose(got, want)


def test_forward_takes_less_time_than_with_a_row_for_each_sequence():
    rnd = np.random.default_rng(4)
    model = hmm.Model.first(rnd.random(hmm.CLASSES))
    kinds, sizes = rnd.integers(0, hmm.CLASSES, 2000 * 150), np.full(2000, 150)

    def by_rows(model, kinds, sizes):
        score, alpha = np.zeros(len(sizes)), np.tile(model.start, (len(sizes), 1))
        first = np.cumsum(sizes) - sizes
        for t in range(sizes[0]):
            alpha = (alpha @ model.move if t else alpha) * model.emit[kinds[first + t]]
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            score += np.log10(scale)
        return score

    def took(f):
        began = time.thread_time()
        f(model, kinds, sizes)
        return time.thread_time() - began

    assert np.allclose(hmm.forward(model, kinds, sizes), by_rows(model, kinds, sizes))
    assert min(took(hmm.forward) for _ in range(7)) < 0.9 * min(took(by_rows) for _ in range(7))


def test_hmm_learns_from_whole_documents(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    rows = [(i, " ".join(rnd.choice(["a", "bb", "ccc", "dddd", "longer"], n))) for i, n in enumerate([200, 64, 65, 1, 130]) if zlib.crc32(str(i).encode()) % 10]
    kept = hmm.blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 4)
    model = hmm.Model.first(rnd.random(hmm.CLASSES))
    whole = kept.first()
    sizes, places, classes = np.frombuffer(whole.sizes, np.int64), np.frombuffer(whole.places, np.int32), np.frombuffer(whole.classes, np.int32)
    kinds = classes[places]
    start, moves, emits = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.CLASSES, hmm.STATES))
    for ks in np.split(kinds, np.cumsum(sizes)[:-1]):
        alphas, betas = [model.start * model.emit[ks[0]]], [np.ones(hmm.STATES)]
        for k in ks[1:]:
            alphas.append(alphas[-1] @ model.move * model.emit[k])
            alphas[-1] /= alphas[-1].sum()
        for k in ks[:0:-1]:
            betas.insert(0, model.move @ (model.emit[k] * betas[0]))
            betas[0] /= betas[0].sum()
        gammas = [a * b / (a * b).sum() for a, b in zip(alphas, betas)]
        start += gammas[0]
        for a, b, k in zip(alphas, betas[1:], ks[1:]):
            both = a[:, None] * model.move * (model.emit[k] * b)
            moves += both / both.sum()
        for k, g in zip(ks, gammas):
            emits[k] += g
    assert np.isclose(moves.sum(), sizes.sum() - len(sizes)) and sizes.max() > 64
    for lot in (hmm.LOT, 7, 64, 201):
        monkeypatch.setattr(hmm, "LOT", lot)
        for got, want in zip(hmm.expected(model, kinds, sizes), (start, moves, emits)):
            assert np.allclose(got, want)
    monkeypatch.undo()
    got, want = hmm.round_of(kept, model), hmm.Model.of_counts(start, moves, emits)
    assert np.allclose(got.start, want.start) and np.allclose(got.move, want.move) and np.allclose(got.emit, want.emit)


def test_contamination(spark, documents):
    items = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "a b"), (4, "a b"), (5, documents.first().text), (None, "q w e r t y")]
    rows = [(r.doc_id, r.text) for r in documents.collect()] + ODD
    rows += [(50, "x One  two three\nfour five six seven eight nine zero ten"), (51, "A b"), (52, "a b c"), (53, "one two three four five six seven eight nine ten " * 9)]
    table = documents.select("doc_id", "text").union(spark.createDataFrame(rows[documents.count():], "doc_id long, text string"))
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).update(brute.shingles(t))
    known = {}
    for i, t in items:
        known.setdefault(i, set()).update(brute.shingles(t))
    want = sorted(((d, i, len(k), len(k & s)) for i, k in known.items() for d, s in sets.items() if k and len(k & s) >= 0.8 * len(k) - 1e-9), key=str)
    found = decontaminate.contamination(table.selectExpr("*", "1 AS hash", "2 AS item_id"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r)[:4] for r in found.collect()), key=str) == want and len(want) > 3
    assert decontaminate.contamination(nothing(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_quality(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(9_000_000 + k, t) for k, (_, t) in enumerate(ODD)], "doc_id long, text string")).selectExpr("*", "1 AS kept", "2 AS key")
    done = quality.judge(table, labels).join(labels, "doc_id", "left").collect()
    assert len(done) == table.count()
    good = [r.kept for r in done if r.quality == 1 and r.toxic == 0]
    poor = [r.kept for r in done if r.quality == 0]
    assert np.mean(good) > 0.9 and np.mean(poor) < 0.3
    assert all(r.kept for r in quality.judge(odd(spark), labels.limit(0)).collect())
    assert quality.judge(nothing(spark), labels).count() == 0
    same = quality.judge(table, labels, clear=True)
    assert same.columns == table.columns and same.count() == sum(r.kept for r in done)


def test_quality_counts_raw_text_of_all_documents(spark):
    rnd = np.random.default_rng(5)
    text = lambda letters: " ".join("".join(rnd.choice(list(letters), 5)) for _ in range(60))
    rows = [(i, text("abcdef" if i % 2 else "uvwxyz")) for i in range(200)]
    # No labelled document holds an n-gram of these.
    rows += [(i, text("hijklm")) for i in range(200, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    done = quality.judge(docs, labels).collect()
    assert all(r.importance < 0 for r in done if r.doc_id >= 200)
    kept = Counter((r.doc_id >= 200, r.doc_id % 2 == 1) for r in done if r.kept)
    assert kept[False, True] > 90 and sum(kept.values()) - kept[False, True] < 10
    counts = quality.gram_counts(docs)
    assert counts.sum() == sum(len(t) - n + 1 for _, t in rows for n in quality.GRAMS)
    alone = [quality.gram_counts(docs.where(f"doc_id % 3 = {k}")) for k in range(3)]
    assert (sum(alone) == counts).all() and not quality.gram_counts(docs.limit(0)).any()


@pytest.mark.parametrize("rare", [0, 1])
def test_quality_keeps_all_when_the_fit_has_one_verdict(spark, documents, rare):
    ids = sorted(r.doc_id for r in documents.select("doc_id").collect())
    only = next(i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0)
    labels = spark.createDataFrame([(i, rare if i == only else 1 - rare, 0) for i in ids], "doc_id long, quality int, toxic int")
    done = quality.judge(documents.select("doc_id", "text"), labels).collect()
    assert len(done) == len(ids) and all(r.kept for r in done)


@pytest.mark.parametrize(
    "importance, good, cut",
    [
        ([0, 0, 0], [True, False, True], -np.inf),
        ([1, 2], [True, False], -np.inf),
        ([1, 2, 3, 4], [True, False, False, True], -np.inf),
        ([1, 2, 3], [True, True, True], -np.inf),
        ([1, 3, 2, 6], [False, False, False, True], 4.5),
        ([1, 2, 3, 4], [False, False, True, False], 2.5),
    ],
)
def test_cut_point_gains_or_keeps_all(importance, good, cut):
    assert quality.cut_point(np.array(importance, float), np.array(good)) == cut


@pytest.mark.parametrize("k", [1, 2, 37, 100, 5000, 5001, 9999, 10_000])
def test_kth_largest(spark, k):
    keys = [math.sin(x) * 10 ** (x % 7) for x in range(9000)] + [3.25] * 1000
    assert quality.kth_largest(spark.createDataFrame([(x,) for x in keys], "key double"), k) == sorted(keys, reverse=True)[k - 1]


def capacity(sizes, n):
    def fits(c):
        used, room = 1, c
        for x in sizes:
            if x > c:
                return False
            if x > room:
                used, room = used + 1, c
            room -= x
        return used <= n

    low, high = max(max(sizes), -(-sum(sizes) // n)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 2, 7, 24])
def test_shards(spark, documents, n):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + ODD
    rows += [(200 + k, "copied " * 40) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS shard")
    done = shards.place(table, n).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in done), key=str) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    slots, used = {}, Counter()
    for r in done:
        assert 0 <= r.shard < n
        slots.setdefault(r.shard, []).append(r.slot)
        used[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    homes = {}
    for r in done:
        homes.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(v) == 1 for v in homes.values())
    marks = shards.sized(table).groupBy("mark").sum("size").orderBy("mark").collect()
    sizes, left, fair = [r[1] for r in marks], n, None
    while left > 1 and max(sizes) * left > sum(sizes):
        sizes.remove(max(sizes))
        left -= 1
    if max(r[1] for r in marks) == max(sizes):
        assert max(used.values()) == capacity(sizes, left)
    assert max(used.values()) <= max(capacity(sizes, left), max(r[1] for r in marks))


def test_no_shards(spark):
    assert shards.place(nothing(spark)).count() == 0


URLS = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"), ("https://EXAMPLE.net/en/1?q#f", "example.net", "/en/1", "example.net/en/", "allow"),
    ("ftp://b.example.com/de/", "b.example.com", "/de/", "example.com/de/", "block"), ("x://org/fr/?a", "org", "/fr/", "org/fr/", "allow"),
    ("http://a.net", "a.net", "", None, None), ("http://anet/x", "anet", "/x", None, None), ("http://a.net?x=/y", "a.net", "", None, None),
    ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://", "", "", None, None),
    ("http://a.net/http://b.org/fr/", "a.net", "/http://b.org/fr/", "net/", "block"), ("http://É.org/fr/#x", "É.org", "/fr/", "org/fr/", "allow"),
]


def test_urls(spark):
    rows = [(k, *u) for k, u in enumerate([*URLS, *URLS])]
    table = spark.createDataFrame([(r[0], r[1], "h") for r in rows], "page_id long, url string, html string").selectExpr("*", "'h' AS host", "1 AS w")
    done = {r.page_id: r for r in url_filter.judge_urls(table).collect()}
    for k, _, host, path, rule, verdict in rows:
        r = done[k]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(table.limit(0)).count() == 0


def test_learned_urls_follow_held_out_rules(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    ruled = url_filter.by_rule(pages)
    taught = url_filter.labelled_urls(ruled, 60)
    model = url_filter.train(taught).first()
    rest = url_filter.with_features(ruled.where("rule IS NOT NULL")).join(taught.select("host", "path"), ["host", "path"], "left_anti").collect()
    score = lambda r: model.bias + sum(model.w[i] for i in r["at"]) / math.sqrt(len(r["at"]))
    assert len(rest) > 500 and np.mean([(score(r) > 0) == (r.verdict == "block") for r in rest]) > 0.95
