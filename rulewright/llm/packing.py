"""Hierarchical packing of token sequences into windows of several lengths.

Each document becomes token ids with an end id.  Whole long windows are cut off first;
the rest is routed to the smallest context tier that holds it.  The tiers are packed
from the longest down: every document opens a window of its tier, and the gap is filled
with whole documents of shorter tiers, then with the beginning of one more, whose rest
goes back to its tier.  What is left of a task at the end is cut at powers of two, so no
window is padded.  Windows are dealt to step groups that hold equally many tokens.

All of it happens inside the tasks that read the documents: no shuffle, and memory for
a few thousand documents.  Words are tokenised once per task process, which forgets them
with its next task of another operator (ids of a word never depend on its neighbours, since
the tokenizer splits at white space and drops it).
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rulewright.llm.common import lean, remembered
from rulewright.llm.textbytes import LOWER, SPACE, slices, span_hashes

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 8 * WINDOW
END_ID = 1
#: Documents that a task packs together.
LOT = 4000
#: Words whose ids a task process remembers.
REMEMBERED = 2_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_group long"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True  # not the apostrophe


class WordIds:
    """Token ids of texts, each distinct word worked out once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.spot = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def spans(self, data: np.ndarray, at: np.ndarray, special: bool) -> tuple[np.ndarray, np.ndarray]:
        """Runs without white space, also cut between a Latin letter and a following sign or the
        reverse: places where the tokenizer's own pattern always ends a word.  Where texts may
        hold ``special`` tokens, which consist of both, there are no such cuts."""
        word = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        if len(data) > 2 and not special:
            letter, sign = _LETTER[data], _SIGN[data]
            edge[1:-1] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
            latin = (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
            edge[2:-1] |= latin & sign[2:]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        ends[:-1] &= ~word[1:] | edge[1:-1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        text = data.tobytes()
        new = [text[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(sizes.sum()))
        spot = len(self.ids) + np.cumsum(sizes) - sizes
        all_hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(all_hashes, kind="stable")
        self.hashes = all_hashes[order]
        self.spot = np.concatenate([self.spot, spot])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each text in a slice."""
        special = b"<|" in data.tobytes()
        plain = data if special else LOWER[data]  # special tokens are told by their case
        starts, ends = self.spans(plain, at, special)
        hashes = span_hashes(plain, starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        known = np.searchsorted(self.hashes, distinct)
        missing = np.ones(len(distinct), bool)
        inside = known < len(self.hashes)
        missing[inside] = self.hashes[known[inside]] != distinct[inside]
        if missing.any():
            if len(self.hashes) > REMEMBERED:
                self.forget()
                missing[:] = True
            self.learn(plain, distinct[missing], starts[first[missing]], ends[first[missing]])
            known = np.searchsorted(self.hashes, distinct)
        which = known[back]
        sizes = self.sizes[which]
        total = int(sizes.sum())
        begin = np.cumsum(sizes) - sizes
        flat = self.ids[np.arange(total) + np.repeat(self.spot[which] - begin, sizes)]
        bounds = np.append(begin, total)[np.searchsorted(starts, at)]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield flat[a:b]


class Packer:
    """Documents in, windows out.  A part is (document, first id, number of ids)."""

    def __init__(self) -> None:
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.tiers: dict[int, deque] = {t: deque() for t in TIERS}

    def put(self, doc: int, start: int, length: int) -> None:
        while length >= WINDOW:
            self.windows.append((WINDOW, [(doc, start, WINDOW)]))
            start, length = start + WINDOW, length - WINDOW
        self.route((doc, start, length))

    def route(self, part: tuple[int, int, int]) -> None:
        if part[2]:
            self.tiers[next(t for t in TIERS if part[2] <= t)].append(part)

    def fill(self, gap: int, parts: list, below: tuple[int, ...]) -> int:
        """Whole shorter documents, then the beginning of one more; the gap that is left."""
        for tier in below:
            queue = self.tiers[tier]
            while queue and queue[0][2] <= gap:
                parts.append(queue.popleft())
                gap -= parts[-1][2]
        for tier in below:
            if gap and self.tiers[tier]:
                doc, start, length = self.tiers[tier].popleft()
                taken = min(gap, length)
                parts.append((doc, start, taken))
                self.route((doc, start + taken, length - taken))
                return self.fill(gap - taken, parts, below) if gap > taken else 0
        return gap

    def pack(self, last: bool) -> None:
        """Windows of all tiers.  Without ``last``, what fills no window waits for more documents."""
        for n in reversed(range(len(TIERS))):
            tier, queue = TIERS[n], self.tiers[TIERS[n]]
            while queue:
                parts = [queue.popleft()]
                # The shortest tier fills its windows from itself.
                gap = self.fill(tier - parts[0][2], parts, TIERS[n - 1 :: -1] if n else TIERS[:1])
                if gap and last:
                    self.cut(parts)
                elif gap:
                    for part in parts:
                        self.route(part)
                    break
                else:
                    self.windows.append((tier, parts))

    def cut(self, parts: list[tuple[int, int, int]]) -> None:
        """A last window that nothing fills, as windows of falling powers of two."""
        left = sum(p[2] for p in parts)
        parts = deque(parts)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            window, room = [], size
            while room:
                doc, start, length = parts.popleft()
                taken = min(room, length)
                window.append((doc, start, taken))
                if taken < length:
                    parts.appendleft((doc, start + taken, length - taken))
                room -= taken
            self.windows.append((size, window))


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece of a document: where it starts and how long it is, and where it lies.

    ``window`` is the length of its sequence (a power of two, full to the last id), and
    ``step_group`` holds at most ``STEP_TOKENS`` ids; all groups but the last of each lot
    of documents hold exactly as many.  NULL and empty texts are the end id alone.  Every
    row is a document of its own, also with a repeated or NULL doc_id.  Other columns are
    not read.  An empty table gives no rows.  Sequence and group numbers are distinct but
    not gapless: a task numbers its own.
    """

    key = ("words", tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered(key, lambda: WordIds(tokenizer))
        base = TaskContext.get().partitionId() << 36
        sequences = groups = 0
        packer, ids, names = Packer(), {}, {}
        count = fresh = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups
            packer.pack(last)
            rows, spent = [], 0
            # Powers of two in falling order fill the step groups exactly.
            for window, parts in sorted(packer.windows, key=lambda w: -w[0]):
                if spent == STEP_TOKENS:
                    groups, spent = groups + 1, 0
                offset = 0
                for doc, start, length in parts:
                    crc = zlib.crc32(ids[doc][start : start + length].astype("<u4").tobytes())
                    rows.append((names[doc], start, length, crc, len(ids[doc]), base + sequences, offset, window, base + groups))
                    offset += length
                sequences += 1
                spent += window
            groups += 1
            packer.windows.clear()
            waiting = {p[0] for q in packer.tiers.values() for p in q}
            for doc in [d for d in ids if d not in waiting]:
                del ids[doc], names[doc]
            if rows:
                fields = [f.split()[0] for f in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], fields)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, _, data, at in slices(batch.column("text")):
                for k, found in enumerate(words.encode(data, at)):
                    ids[count], names[count] = np.append(found, END_ID).astype(np.int32), doc_ids[i + k]
                    packer.put(count, 0, len(ids[count]))
                    count += 1
                    fresh += 1
                if fresh >= LOT:
                    fresh = 0
                    yield from flush(False)
        yield from flush(True)

    return docs.select("doc_id", "text").mapInArrow(lean(run, key), PIECES)
