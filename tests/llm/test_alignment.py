"""Token alignment against a version that follows the definition byte by byte."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rulewright.llm import alignment
from rulewright.llm.alignment import align

PATHS = tuple(str(public_tokenizers.path(p)) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spans(ids, sizes):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(sizes(i)), i))
        at += len(sizes(i))
    return out


def plain(rows, a, b):
    letters = alignment.byte_letters()
    bytes_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    documents, holds = [], Counter()
    for doc, text in rows:
        left, right = [], []
        if text:
            left = spans(a.encode(" " + text, add_special_tokens=False).ids, bytes_a)
            right = spans(b.encode(text), bytes_b)
            want = (" " + text).encode()
            if b"".join(bytes_a(i) for *_, i in left) != want or b"".join(bytes_b(i) for *_, i in right) != want:
                left, right = [], []
        links, k = [], 0
        for x, y, i in left:
            while k and right[k - 1][1] > x:
                k -= 1
            while k < len(right) and right[k][0] < y:
                if right[k][1] > x:
                    links.append((i, right[k][2]))
                k += 1
        cuts = sorted({y for _, y, _ in left} & {y for _, y, _ in right})
        groups, start = [], 0
        rest = [iter(left), iter(right)]
        for cut in cuts:
            sides = []
            for side in rest:
                ids = []
                for x, y, i in side:
                    ids.append(str(i))
                    if y == cut:
                        break
                sides.append(",".join(ids))
            groups.append("|".join(sides))
        holds.update(set(links))
        documents.append((doc, len(left), len(right), links, groups))
    most = {}
    for (i, _), n in holds.items():
        most[i] = max(most.get(i, 0), n)
    return sorted(
        (
            (doc, n_a, n_b, len(groups), len(links), sum(holds[x] == most[x[0]] for x in links), sum(holds[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for doc, n_a, n_b, links, groups in documents
        ),
        key=str,
    )


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b   c", "a\tb\n\nc d", "x\r\ny z", "\x00a b\x1fc d", "a▁b c", "ab ▁ c",
    "　a 　b　 c", "a  b  c", "a  b", "a\u0085 b c", "ﬁx é é", "naïve café 你好 世界 abc",
    "<s> hi </s> <unk> <|endoftext|> <0x41> x", "aaaa aaaaaaa aa", "don't we'll I'd 's 12345 3,14 a_b", "\U0001f600 \U0001f1e9\U0001f1ea x‍y", "﻿a b",
    "   lead", "trail   ", "a" * 5000, " ", "b ", "the the the the", "The the THE",
]


def made():
    rnd = random.Random(3)
    signs = ["a", "b", " ", " ", "\n", "é", " ", "　", "▁", "中", " ", "'s", "1", "-", "the", " of", "\t", "\U0001f600", "\u0085", "Â"]
    rows = list(enumerate(ODD))
    rows += [(100 + k, "".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 40)))) for k in range(400)]
    return rows + [(1, "a b c"), (1, "a b c"), (None, "the of"), (None, None)]


def test_odd_texts(spark, tokenizers, monkeypatch):
    rows = made()
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, lot string, n_a int").repartition(4)
    want = plain(rows, *tokenizers)
    assert rows_of(align(table, *PATHS)) == want
    # Small lots, a memory that forgets, and counts passed on in between.
    monkeypatch.setattr(alignment, "LOT_BYTES", 200)
    monkeypatch.setattr(alignment, "CHUNK", 50)
    assert rows_of(align(table, *PATHS)) == want


def test_documents(spark, documents, tokenizers):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows.append((9999, " ".join(t for _, t in rows) * 4))  # some megabytes
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(align(table, *PATHS))
    assert got == plain(rows, *tokenizers)
    assert sum(r[3] for r in got) > 10000


def test_a_memory_that_forgets(documents, monkeypatch):
    import numpy as np

    from rulewright.llm.textbytes import slices

    texts = alignment.pa.array([r.text for r in documents.collect()])
    monkeypatch.setattr(alignment, "REMEMBERED", 500)
    known = alignment.Vocabularies(*PATHS)
    sums = np.zeros(4, np.int64)
    for _, _, data, at in slices(texts, 20000):
        where, _ = known.places(data, at)
        sums += known.facts[where].sum(0)
    monkeypatch.setattr(alignment, "REMEMBERED", 10**9)
    fresh = alignment.Vocabularies(*PATHS)
    (_, _, data, at), = slices(texts, 1 << 30)
    where, _ = fresh.places(data, at)
    assert sums.tolist() == fresh.facts[where].sum(0).tolist()
    assert len(fresh.spot) > len(known.spot)


def test_no_documents(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows_of(align(empty, *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
