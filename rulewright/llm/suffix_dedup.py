"""Suffix-array dedup: repeated byte strings of a threshold length, by a radix sort of suffixes.

Only equality through the threshold matters, so suffixes are ordered by passes over
ever longer leading digits, hashed, and a group of one leaves the sort after each pass;
the groups left at the full depth are the repeated windows.

1. Digit of 32 bytes.  A window of 400 bytes is known by its anchor, the 32-byte digit
   in it with the smallest hash (the first of equals).  Equal windows have equal anchors
   at equal places, so one suffix per anchor stands for the windows that choose it.
2. Digit of 369 bytes.  The windows of an anchor are put into cells of 32 neighbouring
   starts; a cell goes on if the bytes common to all its windows occur again.
3. Whole cells.  If all bytes of a cell occur again, so do all its windows.
4. Digit of 400 bytes.  Cells that are alike in part are sorted window by window, one
   cell of each kind.

Equal texts are one text from the start (all of it repeats).  Digits are counted with
partial counts before they meet, so a passage in a third of all documents is no hot key.
Hashes that decide have 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import stored
from rulewright.llm.textbytes import U64, _stream, mix, signed, slices

LENGTH = 400
DIGIT = 32
CELL = 32
REACH = LENGTH - DIGIT + 1
CORE = LENGTH - CELL + 1
LADDERS = (_stream(101, 256), _stream(202, 256))
STEPS = (U64(0xDA942042E4DD58B5), U64(0xA0761D6478BD642F))


def ladder(data: np.ndarray, which: int, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (a power of two) from each position on; the last positions are left out."""
    h, n = LADDERS[which][data], 1
    while n < size:
        if len(h) <= n:
            return h[:0]
        h = mix(h[:-n] * STEPS[which] + h[n:])
        n *= 2
    return h


def span_of(h256: np.ndarray, which: int, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` bytes (256 to 512) from the positions ``at`` on."""
    return mix(h256[at] * STEPS[which] + h256[at + (size - 256)] + U64(size))


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor position, first and last window start that choose it, hash of its digit."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(U64)
    h = ladder(data, 0, DIGIT)
    place = np.arange(len(h), dtype=U64)
    keyed = (h & U64(0xFFFFFFFF00000000)) | place
    rows = -(-len(h) // REACH)
    grid = np.full(rows * REACH, np.iinfo(np.uint64).max, U64)
    grid[: len(h)] = keyed
    grid = grid.reshape(rows, REACH)
    up = np.minimum.accumulate(grid, axis=1).ravel()
    down = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - LENGTH + 1
    chosen = (np.minimum(down[:n], up[REACH - 1 : REACH - 1 + n]) & U64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(owner[:n] == owner[LENGTH - 1 :])
    chosen = chosen[starts]
    if not len(starts):
        return none, none, none, none.astype(U64)
    new = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)))
    last = np.append(new[1:], len(starts)) - 1
    return chosen[new], starts[new], starts[last], h[chosen[new]]


def anchor_rows(texts: DataFrame) -> DataFrame:
    """node, spot, first, last, key for the anchors of every text (columns node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.array(batch.column("node"))
            for i, _, data, at in slices(batch.column("text")):
                spot, first, last, key = anchors(data, at)
                row = np.searchsorted(at, spot, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[i + row]), *(pa.array((x - at[row]).astype(np.int32)) for x in (spot, first, last)), pa.array(signed(key))],
                    ["node", "spot", "first", "last", "key"],
                )

    return texts.mapInArrow(run, "node long, spot int, first int, last int, key long")


def cell_rows(texts: DataFrame) -> DataFrame:
    """core, h1, h2, node, start, span for the cells of the given anchors (columns node, text, spots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "h1", "h2", "node", "start", "span"]
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[row].as_py().encode(), np.uint8)
                spots = batch.column("spots")[row].values
                spot, first, last = (np.array(spots.field(k), np.int64) for k in range(3))
                # A cell holds the starts at distances CELL * i to CELL * i + CELL - 1 before the anchor.
                near, far = (spot - last) // CELL, (spot - first) // CELL
                count = far - near + 1
                which = np.repeat(np.arange(len(spot)), count)
                i = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + near[which]
                common = spot[which] - CELL * i
                x0 = np.maximum(first[which], common - CELL + 1)
                x1 = np.minimum(last[which], common)
                out = []
                for k in range(2):
                    h = ladder(data, k, 256)
                    a, b = span_of(h, k, x0, LENGTH), span_of(h, k, x1, LENGTH)
                    out.append(mix(a * STEPS[k] + b + (x1 - x0).astype(U64)))
                    if not k:
                        core = mix(span_of(h, 0, common, CORE) + i.astype(U64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(core)), *(pa.array(signed(x)) for x in out), pa.array(np.full(len(i), batch.column("node")[row].as_py(), np.int64)),
                     pa.array(x0.astype(np.int32)), pa.array((x1 - x0).astype(np.int32))], names,
                )

    return texts.mapInArrow(run, "core long, h1 long, h2 long, node long, start int, span int")


def window_rows(texts: DataFrame) -> DataFrame:
    """f1, f2, h1, h2, bit for each window of the given cells (columns node, text, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column("text")[row].as_py().encode(), np.uint8)
                cells = batch.column("cells")[row].values
                start, span, h1, h2 = (np.array(cells.field(k), np.int64) for k in range(4))
                which = np.repeat(np.arange(len(start)), span + 1)
                bit = np.arange(len(which)) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
                found = [pa.array(signed(span_of(ladder(data, k, 256), k, start[which] + bit, LENGTH))) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*found, pa.array(h1[which]), pa.array(h2[which]), pa.array(bit)], ["f1", "f2", "h1", "h2", "bit"])

    return texts.mapInArrow(run, "f1 long, f2 long, h1 long, h2 long, bit long")


def repeated_cells(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """node, marks (start, span, bits): the windows of distinct texts that start anywhere else too.

    texts: doc_id, node, text.  copies: node, id (the doc_id whose text is read).
    """
    found = stored(anchor_rows(texts.select("node", "text")), "anchors")
    place = F.struct("node", "spot")
    # Written, so that the join reads both sides by shuffle and a common digit can be split.
    again = stored(found.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key"), "repeated-digits")
    spots = (
        found.join(again, "key").groupBy("node", "spot").agg(F.max("first").alias("first"), F.max("last").alias("last"))
        .groupBy("node").agg(F.collect_list(F.struct("spot", "first", "last")).alias("spots"))
    )
    wanted = spots.join(copies, "node").withColumnRenamed("node", "wanted")
    open_texts = stored(
        texts.join(wanted, (F.col("node") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text", "spots"), "open-texts"
    )
    cells = stored(cell_rows(open_texts), "cells")
    whole = F.struct("node", "start", "span")
    kinds = stored(
        cells.groupBy("core", "h1", "h2").agg(F.min(whole).alias("a"), F.max(whole).alias("b"))
        .select("core", "h1", "h2", "a.*", (F.col("a") != F.col("b")).alias("again")),
        "cell-kinds",
    )
    mixed = kinds.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    inner = (
        kinds.join(mixed, "core").groupBy("node").agg(F.collect_list(F.struct("start", "span", "h1", "h2")).alias("cells"))
        .withColumnRenamed("node", "wanted")
    )
    parts = open_texts.select("node", "text").join(inner, F.col("node") == F.col("wanted")).select("node", "text", "cells")
    windows = stored(window_rows(parts).distinct(), "windows")
    kind = F.struct("h1", "h2")
    twice = windows.groupBy("f1", "f2").agg(F.min(kind).alias("a"), F.max(kind).alias("b")).where("a <> b").select("f1", "f2")
    twice = stored(twice, "repeated-windows")
    bits = windows.join(twice, ["f1", "f2"]).groupBy("h1", "h2").agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit AS INT))")).alias("bits"))
    known = stored(
        kinds.where("again").select("h1", "h2", F.lit(-1).cast("long").alias("bits")).union(bits)
        .groupBy("h1", "h2").agg(F.bit_or("bits").alias("bits")),
        "repeated-kinds",
    )
    return (
        cells.join(known, ["h1", "h2"]).groupBy("node", "start", "span").agg(F.bit_or("bits").alias("bits"))
        .groupBy("node").agg(F.collect_list(F.struct("start", "span", "bits")).alias("marks"))
    )


def covered(size: int, marks: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked windows cover."""
    starts = sorted({start + k for start, span, bits in marks for k in range(span + 1) if bits >> k & 1})
    runs: list[list[int]] = []
    for x in starts:
        if runs and x <= runs[-1][1]:
            runs[-1][1] = x + LENGTH
        else:
            runs.append([x, x + LENGTH])
    return [(a, min(b, size)) for a, b in runs]


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), starts and ends of the removed runs.

    Texts are their UTF-8 bytes (NULL: none).  Every byte is removed that lies in a
    400-byte string which also starts elsewhere in any text, the same one included.
    Every row is a document of its own, also with a repeated or NULL doc_id.  Other
    columns are not read.  An empty table gives no rows.
    """
    # NULL and empty texts hold no window; one name will do for both.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    sizes = texts.select("doc_id", "node", F.octet_length("text").alias("n_bytes")).where(F.col("n_bytes") >= LENGTH)
    copies = stored(sizes.groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "text-copies")
    marks = repeated_cells(texts, copies.select("node", "id"))
    facts = (
        copies.where("n > 1").select("node", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<start:int,span:int,bits:bigint>>").alias("marks"))
        .union(marks.select("node", F.lit(False), "marks"))
        .groupBy("node").agg(F.max("whole").alias("whole"), F.first("marks", ignorenulls=True).alias("marks"))
        .select(F.col("node").alias("known"), "whole", F.when(~F.col("whole"), F.col("marks")).alias("marks"))
    )
    facts = stored(facts, "repeat-marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, whole, marks in zip(batch.column("text"), batch.column("whole").to_pylist(), batch.column("marks").to_pylist()):
                body = text.as_py().encode()
                runs = [(0, len(body))] if whole else covered(len(body), [(m["start"], m["span"], m["bits"]) for m in marks or []])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(body[at:a])
                    at = b
                kept = b"".join([*kept, body[at:]])
                out.append((len(body), len(body) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest(), [a for a, _ in runs], [b for _, b in runs]))
            n, gone, spans, kept, sha, starts, ends = zip(*out) if out else ((),) * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(kept, pa.binary()), pa.array(sha, pa.string()),
                 *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "starts", "ends"],
            )

    joined = texts.join(facts, F.col("node") == F.col("known"), "left").select("doc_id", "text", "whole", "marks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, starts array<long>, ends array<long>"
    )
