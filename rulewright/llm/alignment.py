"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

The byte offsets where tokens of both end cut a text into groups; tokens of a group that
overlap are linked.  An id pair counts once for each document that holds it linked.

Most groups are one A token and one B token of the same bytes.  An array, worked out
before, gives for each A id the B id of equal bytes; groups that agree with it are
counted in a vector as long as A's vocabulary, one per task, added slice by slice.
Only links of the other groups enter the shuffle of pairs, as counts of whole lots.

Texts are cut before single spaces between visible characters, where tokens of both
end, and each distinct part is tokenised once per task process.  Documents travel in
lots of about ``LOT_BYTES`` of text.  A lot asks once for each of its distinct pairs,
so that neither documents nor tokens meet at a common pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import stored
from rulewright.llm.textbytes import slices

#: Text of the documents that ask for counts together; a longer text is a lot of its own.
LOT_BYTES = 1 << 19
#: Tokens whose parts a task process remembers.
REMEMBERED = 4_000_000
#: Ids in a slice of the vector.
PIECE = 2048
#: Pairs that a task counts before it passes them on.
CHUNK = 1 << 21

# U+2581 stands for a space in B's pieces, <0xHH> for a byte.
SPACE_MARK = "▁"
# Lead bytes of characters that may be white space beyond ASCII.
WIDE_BLANKS = (0xC2, 0xE1, 0xE2, 0xE3)

_BYTE_KIND = np.zeros(256, np.uint8)  # 1: part of a visible character
_BYTE_KIND[33:127] = 1
_BYTE_KIND[128:] = 1
_LEADS = np.zeros(256, bool)
_LEADS[list(WIDE_BLANKS)] = True


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: visible bytes stand for themselves,
    the others for the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabularies:
    """Both tokenizers, the bytes of their tokens, and for each A id the B id of the same bytes (-1: none)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = [bytes(letters[c] for c in self.a.id_to_token(i)) if i not in self.a.get_added_tokens_decoder() else b"" for i in range(self.a.get_vocab_size())]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Of several B ids the one that is no single-byte stand-in, then the smallest.
        known: dict[bytes, int] = {}
        for i in sorted(range(len(self.bytes_b)), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                known.setdefault(self.bytes_b[i], i)
        self.same = np.array([known.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.written = {sign: np.array([f"{i}{sign}" for i in range(most)], object) for sign in ",|;"}
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()

    def forget(self) -> None:
        self.spot: dict[bytes, int] = {}
        self.odd = np.zeros(0, bool)
        self.facts = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.groups: list[str] = []
        self.fast, self.fast_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rest, self.rest_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, parts: list[bytes]) -> None:
        """Tokens, groups and links of parts, each of which begins with a space."""
        texts = [p.decode() for p in parts]
        ids_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
        odd = np.zeros(len(parts), bool)
        lengths, body = np.fromiter(map(len, parts), np.int64, len(parts)), b"".join(parts)
        for ids, spelled, sizes in ((ids_a, self.bytes_a, self.sizes_a), (ids_b, self.bytes_b, self.sizes_b)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = list(chain.from_iterable(ids))
            spelt = np.append(0, np.cumsum(sizes[np.array(flat, np.int64)]))[np.append(0, np.cumsum(n))]
            if (np.diff(spelt) != lengths).any() or b"".join(map(spelled.__getitem__, flat)) != body:
                odd |= np.array([b"".join(map(spelled.__getitem__, x)) != p for p, x in zip(parts, ids)], bool)
        for k in np.flatnonzero(odd).tolist():
            ids_a[k], ids_b[k] = [], []
        sides = []
        for ids, sizes in ((ids_a, self.sizes_a), (ids_b, self.sizes_b)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.array(list(chain.from_iterable(ids)), np.int64)
            ends = np.cumsum(sizes[flat])
            sides.append((flat, ends, ends - sizes[flat], np.repeat(np.arange(len(parts)), n), n))
        (a, end_a, start_a, of_a, n_a), (b, end_b, start_b, _, n_b) = sides
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        of_group = np.zeros(len(cuts), np.int64)
        of_group[group_a] = of_a
        # The B tokens that each A token overlaps lie together.
        low = np.searchsorted(end_b, start_a, "right")
        n_links = np.searchsorted(start_b, end_a, "left") - low
        left = np.repeat(np.arange(len(a)), n_links)
        right = np.arange(len(left)) + np.repeat(low - (np.cumsum(n_links) - n_links), n_links)
        alone = (np.bincount(group_a, minlength=len(cuts)) == 1) & (np.bincount(group_b, minlength=len(cuts)) == 1)
        fast = alone[group_a[left]] & (self.same[a[left]] == b[right])
        where = of_a[left]
        count = lambda of: np.bincount(of, minlength=len(parts)).astype(np.int64)
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, count(of_group), count(where)], 1)])
        self.odd = np.concatenate([self.odd, odd])
        self.groups += self._written(a, b, group_a, group_b, of_group, len(parts))
        self.fast = np.concatenate([self.fast, a[left][fast]])
        self.fast_n = np.concatenate([self.fast_n, count(where[fast])])
        self.rest = np.concatenate([self.rest, a[left][~fast] * len(self.bytes_b) + b[right][~fast]])
        self.rest_n = np.concatenate([self.rest_n, count(where[~fast])])
        for part in parts:
            self.spot[part] = len(self.spot)

    def _written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, of_group: np.ndarray, parts: int) -> list[str]:
        """a1,a2|b1;... of the groups of each part."""
        # Each id is followed by a comma inside its side of a group, else by the sign after that side.
        sides = []
        for ids, group, sign in ((a, group_a, "|"), (b, group_b, ";")):
            inside = np.append(group[1:] == group[:-1], False) if len(ids) else np.zeros(0, bool)
            sides.append(np.where(inside, self.written[","][ids], self.written[sign][ids]))
        group = np.concatenate([group_a, group_b])
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), group))
        pieces = np.concatenate(sides)[order].tolist()
        edges = np.searchsorted(of_group[group[order]], np.arange(parts + 1)).tolist()
        return ["".join(pieces[x:y])[:-1] for x, y in zip(edges[:-1], edges[1:])]

    def places(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which known part each part of a slice of texts is, and where each text's parts begin (with the end)."""
        if len(self.facts) and int(self.facts[:, :2].sum()) > REMEMBERED:
            self.forget()
        kind = _BYTE_KIND[data]
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 4:
            inner = (data[2:-1] == 32) & (kind[1:-2] == 1) & (kind[3:] == 1) & ~_LEADS[data[3:]]
            inner &= ~_LEADS[data[:-3]] | (data[1:-2] < 128)  # not after a two-byte blank
            cut[2:-2] = inner
            inner = cut[3:-2]
            inner &= ~(_LEADS[data[:-4]] & (data[1:-3] >= 128) & (data[2:-2] >= 128))  # nor after a three-byte one
        # A text's last space stays with the word before it.
        cut[np.maximum(at - 1, 0)] = False
        cut[at] = True
        filled = at[:-1] < at[1:]
        starts = np.flatnonzero(cut[:-1])
        first = np.zeros(len(data) + 1, bool)
        first[at[:-1][filled]] = True
        body = data.tobytes()
        ends = np.append(starts[1:], len(data))
        # A text's first part gets the space that both tokenizers put before the text.
        parts = [b" " + body[x:y] if new else body[x:y] for x, y, new in zip(starts.tolist(), ends.tolist(), first[starts].tolist())]
        missing = [p for p in dict.fromkeys(parts) if p not in self.spot]
        if missing:
            self.learn(missing)
        where = np.fromiter(map(self.spot.__getitem__, parts), np.int64, len(parts))
        return where, np.searchsorted(starts, at)


_KNOWN: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    if (path_a, path_b) not in _KNOWN:
        _KNOWN[path_a, path_b] = Vocabularies(path_a, path_b)
    return _KNOWN[path_a, path_b]


def _distinct(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row its distinct values with their numbers: where rows begin (with the end), values, numbers."""
    keys, times = np.unique(rows.astype(np.uint64) << np.uint64(32) | values.astype(np.uint64), return_counts=True)
    return np.searchsorted(keys >> np.uint64(32), np.arange(n + 1)), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), times


def _spread(where: np.ndarray, of: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of ``flat`` that belong to the places ``where``, with the row ``of`` each."""
    n = sizes[where]
    begin = np.cumsum(n) - n
    at = np.arange(int(n.sum())) + np.repeat((np.cumsum(sizes) - sizes)[where] - begin, n)
    return np.repeat(of, n), flat[at]


FACTS = ("n_a", "n_b", "n_groups", "n_links")
LOT = (
    "lot long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in FACTS) + ", groups_sha256 array<string>, "
    "fast_at binary, fast binary, fast_n binary, rest_at binary, rest binary, rest_n binary"
)
KINDS = {"fast_at": "<i8", "fast": "<u2", "fast_n": "<i4", "rest_at": "<i8", "rest": "<u4", "rest_n": "<i4"}


def lots(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of ``LOT``: per document its facts, its distinct ids of fast groups and its other pairs, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabularies(path_a, path_b)
        lot = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, j, data, at in slices(batch.column("text"), LOT_BYTES):
                where, edges = known.places(data, at)
                of = np.repeat(np.arange(j - i), np.diff(edges))
                odd = np.bincount(of, known.odd[where], j - i) > 0
                use = ~odd[of]
                where, of = where[use], of[use]
                edges = np.searchsorted(of, np.arange(j - i + 1))
                facts = [np.bincount(of, known.facts[where, k], j - i).astype(np.int64) for k in range(4)]
                texts = [known.groups[k] for k in where.tolist()]
                sums = [hashlib.sha256(";".join(texts[x:y]).encode()).hexdigest() if x < y else "" for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
                packed = {}
                for name, sizes, flat in (("fast", known.fast_n, known.fast), ("rest", known.rest_n, known.rest)):
                    begin, values, times = _distinct(*_spread(where, of, sizes, flat), j - i)
                    packed |= {f"{name}_at": begin, name: values, f"{name}_n": times}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lot], pa.int64()), pa.array([batch.column("doc_id")[i:j].to_pylist()], pa.list_(pa.int64())),
                     *(pa.array([x], pa.list_(pa.int64())) for x in facts), pa.array([sums], pa.list_(pa.string())),
                     *(pa.array([packed[k].astype(kind).tobytes()], pa.binary()) for k, kind in KINDS.items())],
                    ["lot", "doc_id", *FACTS, "groups_sha256", *KINDS],
                )
                lot += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LOT)


def _read(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    for x in batch.column(name):
        yield np.frombuffer(x.as_buffer(), KINDS[name])


def fast_counts(found: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many documents each A id stands in a group of its own with the B id of the same bytes."""
    pieces = -(-vocabulary // PIECE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(pieces * PIECE, np.int64)
        for batch in batches:
            for ids in _read(batch, "fast"):
                sums += np.bincount(ids, minlength=len(sums))
        yield rows({k: x for k, x in enumerate(sums.reshape(pieces, PIECE)) if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, x in zip(batch.column("piece").to_pylist(), batch.column("sums")):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(x.as_buffer(), "<i8")
        yield rows(sums)

    def rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "sums"])

    shape = "piece int, sums binary"
    total = np.zeros((pieces, PIECE), np.int64)
    for row in found.select("fast").mapInArrow(count, shape).repartition("piece").mapInArrow(add, shape).collect():
        total[row.piece] = np.frombuffer(row.sums, "<i8")
    return total.ravel()[:vocabulary]


def pair_counts(found: DataFrame, same: np.ndarray, size_b: int) -> DataFrame:
    """pair (A id times B's size plus B id), same (of equal bytes), n: documents, besides those that the vector counts."""
    known = found.sparkSession.sparkContext.broadcast(same)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(known.value[pairs // size_b] == pairs % size_b), pa.array(n)], ["pair", "same", "n"])

        for batch in batches:
            columns = (_read(batch, c) for c in ("rest", "rest_at", "fast", "fast_at"))
            for rest, rest_at, fast, fast_at in zip(*columns):
                rest = rest.astype(np.int64)
                # A pair of equal bytes that its document has in a fast group too is counted there.
                doc = np.repeat(np.arange(len(rest_at) - 1), np.diff(rest_at)) << 32
                doc_fast = np.repeat(np.arange(len(fast_at) - 1), np.diff(fast_at)) << 32
                both = (known.value[rest // size_b] == rest % size_b) & np.isin(doc | rest // size_b, doc_fast | fast)
                held.append(rest[~both])
                size += len(held[-1])
                if size >= CHUNK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counted = found.select("rest", "rest_at", "fast", "fast_at").mapInArrow(count, "pair long, same boolean, n long")
    return counted.groupBy("pair", "same").agg(F.sum("n").alias("n"))


def asked_pairs(found: DataFrame, same: np.ndarray, size_b: int) -> DataFrame:
    """lot, pair: the distinct pairs of each lot whose count is not in the vector."""
    known = found.sparkSession.sparkContext.broadcast(same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot, rest in zip(batch.column("lot").to_pylist(), _read(batch, "rest")):
                pairs = np.unique(rest).astype(np.int64)
                pairs = pairs[known.value[pairs // size_b] != pairs % size_b]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), lot)), pa.array(pairs)], ["lot", "pair"])

    return found.select("lot", "rest").mapInArrow(run, "lot long, pair long")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    A reads a space and the text, B the text, before which it puts a space itself.  Texts
    that are NULL or empty, or whose tokens' bytes are not the space and the text, have no
    tokens: zeros and an empty groups_sha256.  Every row is a document of its own, also
    with a repeated or NULL doc_id.  Other columns are not read.  An empty table gives no
    rows.  Texts are read whole; a text without single spaces is tokenised in one piece.
    """
    known = vocabularies(path_a, path_b)
    size_a, size_b, same = len(known.bytes_a), len(known.bytes_b), known.same
    assert size_a <= 1 << 16 and size_a * size_b <= 1 << 32, "larger vocabularies need wider columns"
    found = stored(lots(docs, path_a, path_b), "lots")
    counts = stored(pair_counts(found, same, size_b), "pair-counts")
    # One number per A id each, however many documents there are.
    equal = fast_counts(found, size_a)
    for r in counts.where("same").collect():
        equal[r.pair // size_b] += r.n
    most = equal.copy()
    highest = counts.where("NOT same").groupBy(F.expr(f"pair DIV {size_b}").alias("a")).agg(F.max("n").alias("n"))
    for r in highest.collect():
        most[r.a] = max(most[r.a], r.n)
    vectors = docs.sparkSession.sparkContext.broadcast((same, equal, most))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, equal, most = vectors.value
        for batch in batches:
            told = batch.column("told")
            columns = [_read(batch, c) for c in ("rest_at", "rest", "rest_n", "fast_at", "fast", "fast_n")]
            for k, (rest_at, rest, rest_n, fast_at, fast, fast_n) in enumerate(zip(*columns)):
                rest, rest_n, fast_n = rest.astype(np.int64), rest_n.astype(np.int64), fast_n.astype(np.int64)
                n = equal[rest // size_b].copy()
                other = same[rest // size_b] != rest % size_b
                if other.any():
                    pairs, numbers = (np.asarray(told[k].values.field(f)) for f in range(2))
                    order = np.argsort(pairs)
                    n[other] = numbers[order][np.searchsorted(pairs, rest[other], sorter=order)]
                docs_here = len(rest_at) - 1
                best, total = np.zeros(docs_here, np.int64), np.zeros(docs_here, np.int64)
                for at, ids, held, times in ((rest_at, rest // size_b, n, rest_n), (fast_at, fast, equal[fast], fast_n)):
                    of = np.repeat(np.arange(docs_here), np.diff(at))
                    np.add.at(best, of, times * (held == most[ids]))
                    np.add.at(total, of, times * held)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[k].values, *(batch.column(c)[k].values for c in FACTS), pa.array(best), pa.array(total), batch.column("groups_sha256")[k].values],
                    ["doc_id", *FACTS, "n_best", "count_sum", "groups_sha256"],
                )

    told = (
        asked_pairs(found, same, size_b).join(counts.where("NOT same").select("pair", "n"), "pair")
        .groupBy("lot").agg(F.collect_list(F.struct("pair", "n")).alias("told"))
    )
    joined = found.join(told.withColumnRenamed("lot", "of"), F.col("lot") == F.col("of"), "left").drop("of")
    return joined.mapInArrow(
        finish, "doc_id long, " + ", ".join(f"{c} long" for c in FACTS) + ", n_best long, count_sum long, groups_sha256 string"
    )
