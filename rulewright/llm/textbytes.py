"""Words, shingles and hashes of Arrow text columns, worked out on whole byte arrays.

Texts come as Arrow batches; a batch is cut into slices of a few megabytes so that
the working arrays stay small whatever the batch.  A text is never cut.  Hashes have
64 bits and depend on the bytes alone, so they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 22
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_CODES = _stream(11, 256)
STEP = U64(0xD1342543DE82EF95)
SHINGLE_STEPS = _stream(23, 5) | U64(1)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row starts with the end) of slices of a text column.

    NULL counts as empty.  A text longer than ``most`` is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, spots, body = column.buffers()
    at = np.frombuffer(spots, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space; no run crosses a text's edge."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes.  Spans are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    powers = np.full(int(lengths.max()), STEP, U64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    codes = BYTE_CODES[data[place + np.repeat(starts, lengths)]] * powers[place]
    return mix(np.add.reduceat(codes, first) + lengths.astype(U64))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and where each text's words begin (with the end)."""
    starts, ends = word_spans(data, at)
    return span_hashes(LOWER[data], starts, ends), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles with the row of each, repeats included.

    A text of one to four words has one shingle, its whole word sequence.
    """
    counts = np.diff(at)
    rows = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(0, U64)
    if len(hashes) >= 5:
        n = len(hashes) - 4
        out = hashes[:n] * SHINGLE_STEPS[0]
        for k in range(1, 5):
            out = out + hashes[k : n + k] * SHINGLE_STEPS[k]
        whole = rows[:n] == rows[4:]
        out, which = mix(out[whole]), rows[:n][whole]
    else:
        which = np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < 5))
    if len(short):
        sums = [
            int(mix(np.array([sum(int(h) * int(m) for h, m in zip(hashes[at[r] : at[r + 1]], SHINGLE_STEPS)) + int(at[r + 1] - at[r]) & (2**64 - 1)], U64))[0])
            for r in short.tolist()
        ]
        out, which = np.concatenate([out, np.array(sums, U64)]), np.concatenate([which, short])
        order = np.argsort(which, kind="stable")
        out, which = out[order], which[order]
    return out, which


def shingle_sets(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    out, which = shingles(*words(data, at))
    bounds = np.searchsorted(which, np.arange(len(at)))
    for i in range(len(at) - 1):
        yield np.unique(out[bounds[i] : bounds[i + 1]])


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's BIGINT."""
    return np.ascontiguousarray(x).view(np.int64)


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
