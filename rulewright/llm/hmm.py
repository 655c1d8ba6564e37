"""Language-model scoring with a hidden Markov model.

A latent state emits the class of the next token, and the class emits the token from its
own counts.  Classes are a fixed number of hashed word shapes (short words whole, longer
words by their first and last two bytes), so the latent part of the model has a fixed
size and is broadcast; token counts have the size of the corpus' vocabulary and stay
distributed.

* Documents are read once and kept as blocks: a vocabulary, and each document as places
  in it.
* Each block's vocabulary meets the others' by class: counts are summed there, and every
  block gets back the corpus counts of its own words.
* Baum-Welch: every round, tasks work out expected counts over all whole training
  documents, in lots of like length; the sums meet in slices of the class table.
* The scaled forward recursion gives the exact probability of each whole document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import lean, stored
from rulewright.llm.textbytes import LOWER, U64, mix, slices, span_hashes, word_spans

STATES = 8
CLASSES = 1 << 14
ROUNDS = 6
#: Tokens whose probabilities are held at once; a longer document is worked out in pieces.
LOT = 1 << 19
BLOCK_BYTES = 1 << 23
ADDED = 0.1
PARTS = 64
END = 0x454E44
BLOCK = "block long, words binary, classes binary, counts binary, doc_ids array<long>, held array<boolean>, sizes binary, places binary"


def classes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The class of each word; a class depends on the word alone."""
    long = ends - starts > 4
    shape = hashes.copy()
    a, b = starts[long], ends[long]
    code = np.zeros(len(a), U64)
    for part in (data[a], data[a + 1], data[b - 2], data[b - 1]):
        code = (code << U64(8)) | part.astype(U64)
    shape[long] = mix(code + U64(1) << U64(8))
    return (shape >> U64(40)).astype(np.int64) % CLASSES


def blocks(docs: DataFrame, parts: int) -> DataFrame:
    """Blocks of about ``BLOCK_BYTES`` of text; their words are ordered by class part, then hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal number
            hashes, kinds = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            sizes, ids, flags = np.concatenate([h[2] for h in held]), [x for h in held for x in h[3]], [x for h in held for x in h[4]]
            words, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            kinds = kinds[first]
            order = np.argsort(kinds % parts, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            train = np.repeat(~np.array(flags, bool), sizes)
            counts = np.bincount(place[back[train]], minlength=len(words))
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1]), *(pa.array([x.tobytes()], pa.binary()) for x in (words[order], kinds[order].astype(np.int32), counts.astype(np.int64))),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())),
                 *(pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype(np.int64), place[back].astype(np.int32)))],
                [f.split()[0] for f in BLOCK.split(", ")],
            )

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, j, data, at in slices(batch.column("text")):
                plain = LOWER[data]
                starts, ends = word_spans(plain, at)
                hashes = span_hashes(plain, starts, ends)
                kinds = classes_of(plain, starts, ends, hashes)
                edge = np.searchsorted(starts, at)
                # One end after the words of each document.
                hashes = np.insert(hashes, edge[1:], U64(END))
                kinds = np.insert(kinds, edge[1:], 0)
                flags = [x is not None and zlib.crc32(str(x).encode()) % 10 == 0 for x in ids[i:j]]
                held.append((hashes, kinds, np.diff(edge) + 1, ids[i:j], flags))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), BLOCK)


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def corpus_counts(kept: DataFrame, parts: int) -> DataFrame:
    """Rows (block, part, counts): corpus counts of a block's words in one part, in their order;
    and rows (class, tokens, types) with block NULL."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, kinds, counts = (_array(batch.column(c)[k], t) for c, t in (("words", U64), ("classes", np.int32), ("counts", np.int64)))
                edge = np.searchsorted(kinds % parts, np.arange(parts + 1))
                some = [p for p in range(parts) if edge[p] < edge[p + 1]]
                cut = lambda x: pa.array([x[edge[p] : edge[p + 1]].tobytes() for p in some], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("block")[k].as_py()] * len(some), pa.int64()), pa.array(some, pa.int32()), cut(words), cut(kinds), cut(counts)],
                    ["block", "part", "words", "classes", "counts"],
                )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "part", "counts", "class", "tokens", "types"]
        rows = [
            (b, p, _array(w, U64), _array(c, np.int32), _array(n, np.int64))
            for batch in batches
            for b, p, w, c, n in zip(batch.column("block").to_pylist(), batch.column("part").to_pylist(), *(batch.column(c) for c in ("words", "classes", "counts")))
        ]
        if not rows:
            return
        words, first, back = np.unique(np.concatenate([r[2] for r in rows]), return_index=True, return_inverse=True)
        kinds = np.concatenate([r[3] for r in rows])[first]
        total = np.bincount(back, np.concatenate([r[4] for r in rows]), len(words)).astype(np.int64)
        at = 0
        for b, p, w, _, _ in rows:
            found = total[back[at : at + len(w)]]
            at += len(w)
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([p], pa.int32()), pa.array([found.tobytes()], pa.binary()), none, none, none], names)
        tokens, types = np.bincount(kinds, total, CLASSES).astype(np.int64), np.bincount(kinds[total > 0], minlength=CLASSES)
        some = np.flatnonzero(tokens)
        n = len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(some), pa.array(tokens[some]), pa.array(types[some])], names
        )

    dealt = kept.select("block", "words", "classes", "counts").mapInArrow(lean(deal), "block long, part int, words binary, classes binary, counts binary")
    return dealt.repartition(parts, "part").mapInArrow(lean(gather), "block long, part int, counts binary, class long, tokens long, types long")


class Model:
    """Start, transition and class emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: class x state

    @classmethod
    def first(cls, tokens: np.ndarray) -> Model:
        rnd = np.random.default_rng(3)
        emit = (tokens[:, None] + 0.01) * np.exp(rnd.normal(size=(CLASSES, STATES)))
        move = np.full((STATES, STATES), 0.1 / STATES) + 0.9 * np.eye(STATES)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + 0.01, move + 0.01, emit + 0.01
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def forward(model: Model, kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each class sequence (``sizes`` tokens each, one or more), by the scaled forward recursion."""
    order = np.argsort(-sizes, kind="stable")
    at = (np.cumsum(sizes) - sizes)[order]
    live = _live(sizes[order], int(sizes.max(initial=0)))
    onward, emitted = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.emit.T)
    score = np.zeros(len(sizes))
    alpha = np.repeat(model.start[:, None], len(sizes), axis=1)
    for t, n in enumerate(live):
        alpha = onward @ alpha[:, :n] if t else alpha
        alpha *= emitted.take(kinds[at[:n] + t], axis=1)
        scale = alpha.sum(axis=0)
        alpha *= 1 / scale
        score[:n] += np.log10(scale)
    out = np.empty(len(sizes))
    out[order] = score
    return out


def _live(falling: np.ndarray, longest: int) -> np.ndarray:
    """How many sequences, longest first, have a token at each place."""
    return np.searchsorted(-falling, -np.arange(longest), "left")


def expected(model: Model, kinds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions over whole sequences of ``sizes`` tokens.

    Of a sequence above ``LOT`` tokens the forward pass keeps what enters each piece; the
    backward pass works the piece out again, so that every move counts.  States are rows and
    sequences columns, so that a step works on long rows.
    """
    start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
    onward, emitted = np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.emit.T)
    offsets = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    until = np.cumsum(sizes[order])
    lot = 0
    while lot < len(order):
        mine = order[lot : max(lot + 1, int(np.searchsorted(until, LOT + (until[lot - 1] if lot else 0), "right")))]
        lot += len(mine)
        at, longest = offsets[mine], int(sizes[mine[0]])
        live = _live(sizes[mine], longest)

        def ahead_of(first: int, alpha: np.ndarray) -> tuple[list, list, list]:
            """Classes, forward probabilities, and emissions by scale of a piece; ``alpha`` is the step before it."""
            seen, alphas, emits = [], [], []
            for t in range(first, min(first + LOT, longest)):
                n = live[t]
                seen.append(kinds[at[:n] + t])
                given = emitted.take(seen[-1], axis=1)
                alpha = onward @ alpha[:, :n] if t else np.repeat(model.start[:, None], n, axis=1)
                alpha *= given
                part = 1 / alpha.sum(axis=0)
                alpha *= part
                given *= part
                alphas.append(alpha)
                emits.append(given)
            return seen, alphas, emits

        pieces, enters = range(0, longest, LOT), [np.zeros((STATES, 0))]
        for first in pieces:
            piece = None
            piece = ahead_of(first, enters[-1])
            enters.append(piece[1][-1])
        ahead = np.zeros((STATES, 0))
        for number in range(len(pieces) - 1, -1, -1):
            first = pieces[number]
            seen, alphas, emits = piece or ahead_of(first, enters[number])
            for t in range(len(seen) - 1, -1, -1):
                n = ahead.shape[1]
                move += alphas[t][:, :n] @ ahead.T
                beta = np.ones(alphas[t].shape)
                beta[:, :n] = model.move @ ahead
                # In the place of the forward probabilities: how much of each state a token is.
                alphas[t] *= beta
                given = emits.pop()
                ahead = np.multiply(given, beta, out=given)
            where, weight = np.concatenate(seen), np.concatenate(alphas, axis=1)
            for k in range(STATES):
                emit[k] += np.bincount(where, weight[k], CLASSES)
            if not number:
                start += alphas[0].sum(axis=1)
            # Nothing of a piece stays while the next one, or the next lot, is worked out.
            piece = seen = alphas = emits = where = weight = None
    return start, model.move * move, np.ascontiguousarray(emit.T)


def round_of(kept: DataFrame, model: Model) -> Model:
    """One Baum-Welch round over all training tokens."""
    known = kept.sparkSession.sparkContext.broadcast(model)
    width = CLASSES // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, any_row = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)), False
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, places, kinds = (_array(batch.column(c)[k], t) for c, t in (("sizes", np.int64), ("places", np.int32), ("classes", np.int32)))
                train = ~np.array(batch.column("held")[k].as_py(), bool)
                if train.any():
                    any_row = True
                    found = expected(known.value, kinds[places[np.repeat(train, sizes)]], sizes[train])
                    start, move, emit = start + found[0], move + found[1], emit + found[2]
        if any_row:
            parts = [*(emit[p * width : (p + 1) * width].tobytes() for p in range(PARTS)), np.concatenate([start, move.ravel()]).tobytes()]
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS + 1), pa.int32()), "sums": pa.array(parts, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, value in zip(batch.column("part").to_pylist(), batch.column("sums")):
                sums[part] = sums.get(part, 0) + _array(value, np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"part": pa.array(sums, pa.int32()), "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    shape = "part int, sums binary"
    rows = kept.select("sizes", "places", "classes", "held").mapInArrow(lean(count), shape).repartition("part").mapInArrow(lean(add), shape).collect()
    sums = {r.part: np.frombuffer(r.sums, np.float64) for r in rows}
    if not sums:
        return model
    ends = sums.pop(PARTS)
    return Model.of_counts(ends[:STATES], ends[STATES:].reshape(STATES, STATES), np.concatenate([sums[p] for p in range(PARTS)]).reshape(CLASSES, STATES))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Tokens are the words (runs without white space, A-Z lower-cased) and one end.  The
    model learns from rows whose crc32(doc_id as text) is not divisible by 10; a row
    without doc_id is one of them.  NULL and empty texts are the end alone.  ``score`` is
    the log10 probability of the whole document: the exact probability of its classes
    under the hidden Markov model times that of its tokens in their classes, where a class
    keeps room for one unknown token.  Rows with one doc_id are scored by themselves.
    Without training rows every known probability is uniform.  Other columns are not
    read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = stored(blocks(docs, parts), "token-blocks")
    counts = stored(corpus_counts(kept, parts), "token-counts")
    # One row per class at most.
    per_class = counts.where("block IS NULL").select("class", "tokens", "types").collect()
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        tokens[r["class"]], types[r["class"]] = r.tokens, r.types
    model = Model.first(tokens)
    for _ in range(rounds):
        model = round_of(kept, model)
    known = spark.sparkContext.broadcast((model, tokens, types))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens, types = known.value
        total, vocabulary = int(tokens.sum()), int(types.sum())
        found: list[np.ndarray] = []
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("found")[k].is_valid:
                    found.append(_array(batch.column("found")[k], np.int64))
                    continue
                c = np.concatenate(found)
                found = []
                kinds, sizes, places = (_array(batch.column(x)[k], t) for x, t in (("classes", np.int32), ("sizes", np.int64), ("places", np.int32)))
                first = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x[places], first)
                base = np.log10((c + ADDED) / (total + ADDED * (vocabulary + 1)))
                inside = np.log10((c + ADDED) / (tokens[kinds] + ADDED * (types[kinds] + 1)))
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[k].values, batch.column("held")[k].values, pa.array(sizes), pa.array(add((c > 0).astype(np.int64))),
                     pa.array(np.full(n, total, np.int64)), pa.array(add(base)), pa.array(forward(model, kinds[places], sizes) + add(inside))],
                    [f.split()[0] for f in SCORES.split(", ")],
                )

    # Words and their counts in the block have done their work.
    needed = [f.split(" ", 1) for f in BLOCK.split(", ")[1:] if f.split()[0] not in ("words", "counts")]
    lookups = counts.where("block IS NOT NULL").selectExpr("block", "part", "counts AS found", *(f"CAST(NULL AS {kind}) AS {name}" for name, kind in needed))
    whole = kept.selectExpr("block", f"{parts} AS part", "CAST(NULL AS BINARY) AS found", *(name for name, _ in needed))
    return lookups.union(whole).repartition("block").sortWithinPartitions("block", "part").mapInArrow(lean(run), SCORES)
