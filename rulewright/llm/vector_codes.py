"""Vector code compression: product codes whose codebooks come from a member-resident Lloyd.

Vectors of whole numbers are cut into equal parts; each part position has a codebook.
A part is a member of one entry.  Members live in blocks, dealt by (position, entry,
salt): the salt splits an entry that many vectors share, so an owner holds at most about
``MEMBERS`` members.  Owners add their members up, and the codebooks follow from these
sums.  With new codebooks every owner judges its members where they are; only those that
change entry migrate through the next shuffle, the others stay in their blocks.

What is broadcast or collected are the codebooks and their sums: ``entries`` times the
vector's length numbers, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import stored
from rulewright.llm.textbytes import U64, mix

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Whole components are kept between the two; distances of parts of up to 4,096 components then fit 64 bits.
LIMIT = 1 << 24
#: Members of one position, entry and salt if all vectors share the entry.
MEMBERS = 250_000
#: Numbers that a task works on at once.
CHUNK = 1 << 21

BLOCK = "position int, entry int, salt int, moved boolean, n long, sums array<long>, members binary"


def is_kept(vector: Column) -> Column:
    """True for vectors without null and non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole_numbers(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, rows x width integers) of slices of a column of vectors.

    Components become floor(256 x), kept within ``LIMIT``; short vectors end with zeros.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    step = max(1, CHUNK // max(width, 1))
    for i in range(0, len(column), step):
        some = column.slice(i, step)
        sizes = np.asarray(some.value_lengths())
        flat = np.clip(np.floor(np.asarray(some.flatten(), np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)
        out = np.zeros((len(some), width), np.int64)
        out[np.arange(width)[None, :] < sizes[:, None]] = flat
        yield i, i + len(some), out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (the lower of equals) and its squared distance, exactly."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max()))
    kind = np.float64 if 4 * x.shape[1] * largest**2 < 1 << 53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    far = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    index = far.argmin(1)
    return index, far[np.arange(len(x)), index].astype(np.int64)


def _blocks(found: Iterable[tuple[int, int, int, bool, np.ndarray]]) -> pa.RecordBatch:
    """Rows of ``BLOCK`` for (position, entry, salt, moved, members)."""
    rows = [(p, e, s, m, len(x), x.sum(0).tolist(), x.astype("<i4").tobytes()) for p, e, s, m, x in found]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    columns = zip(*rows) if rows else ((),) * len(kinds)
    names = ["position", "entry", "salt", "moved", "n", "sums", "members"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _split(x: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of ``x`` with each key."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
        yield int(keys[order[a]]), x[order[a:b]]


def dealt(vectors: DataFrame, book: np.ndarray, salts: int) -> DataFrame:
    """Blocks of the parts of ``vectors`` (vec_id, embedding), assigned to the entries of ``book``."""
    known = vectors.sparkSession.sparkContext.broadcast(book)
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = [], 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            salt = (mix(np.arange(seen - len(x), seen, dtype=U64)) % U64(salts)).astype(np.int64)
            return _blocks(
                (p, key // salts, key % salts, True, some)
                for p in range(parts)
                for key, some in _split(x[:, p], nearest(x[:, p], known.value[p])[0] * salts + salt)
            )

        for batch in batches:
            for _, _, x in whole_numbers(batch.column("embedding"), parts * width):
                held.append(x.reshape(len(x), parts, width))
                seen += len(x)
                if sum(map(len, held)) * parts * max(width, 1) >= CHUNK:
                    yield out()
                    held = []
        if held:
            yield out()

    return vectors.select("embedding").mapInArrow(run, BLOCK)


def owned(blocks: DataFrame, owners: int, width: int) -> DataFrame:
    """Blocks brought to their owners; an owner joins those of one position, entry and salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[np.ndarray]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return _blocks((*key, False, np.concatenate(x)) for key, x in held.items())

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("position", "entry", "salt", "n")))
            for (*key, n), members in zip(keys, batch.column("members")):
                held.setdefault(tuple(key), []).append(np.frombuffer(members.as_buffer(), "<i4").reshape(n, width).astype(np.int64))
                size += n * max(width, 1)
            if size >= CHUNK:
                yield out()
                held, size = {}, 0
        if held:
            yield out()

    return blocks.repartition(owners, "position", "entry", "salt").mapInArrow(run, BLOCK)


def judged(members: DataFrame, book: np.ndarray, keep: bool) -> DataFrame:
    """Blocks after a look at new codebooks: those that stay, and those that move to another entry.

    Without ``keep`` the ones that stay are added up but not carried on.
    """
    known = members.sparkSession.sparkContext.broadcast(book)
    width = book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("position", "entry", "salt", "n")))
            for (p, e, s, n), body in zip(keys, batch.column("members")):
                x = np.frombuffer(body.as_buffer(), "<i4").reshape(n, width).astype(np.int64)
                found += [(p, to, s, to != e, some) for to, some in _split(x, nearest(x, known.value[p])[0])]
            out = _blocks(found)
            if not keep:
                bodies = [x if moved else b"" for x, moved in zip(out.column("members").to_pylist(), out.column("moved").to_pylist())]
                out = pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(bodies, pa.binary())], out.schema.names)
            yield out

    return members.mapInArrow(run, BLOCK)


def updated(members: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks with each entry replaced by floor(sum / count) of its members; unused entries stay."""
    out = book.copy()
    each = members.select("position", "entry", "n", F.posexplode("sums").alias("place", "part"))
    for r in each.groupBy("position", "entry", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total")).collect():
        out[r.position, r.entry, r.place] = r.total // r.n
    return out


def first_book(vectors: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest vec_id (of equal ids the smallest vector)."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    column = pa.array([r.embedding for r in rows], pa.list_(pa.float64()))
    whole = np.concatenate([x for _, _, x in whole_numbers(column, parts * width)])
    return np.ascontiguousarray(whole.reshape(len(rows), parts, width).transpose(1, 0, 2))


def trained(vectors: DataFrame, book: np.ndarray, rows: int, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after ``rounds`` rounds over all vectors."""
    spark = vectors.sparkSession
    parts, entries, width = book.shape
    salts = -(-rows // MEMBERS)
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * parts * max(width, 1) // (4 * CHUNK))
    members = None
    for turn in range(rounds):
        if members is None:
            members = stored(owned(dealt(vectors, book, salts), owners, width), "members")
        else:
            seen = stored(judged(members, book, turn < rounds - 1), "members-judged")
            arrived = stored(owned(seen.where("moved"), owners, width), "members-moved")
            members = seen.where("NOT moved").union(arrived)
        book = updated(members, book)
    return book


def encoded(vectors: DataFrame, book: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of each vector."""
    known = vectors.sparkSession.sparkContext.broadcast(book)
    parts, _, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in whole_numbers(batch.column("embedding"), parts * width):
                x = x.reshape(len(x), parts, width)
                found = [nearest(x[:, p], known.value[p]) for p in range(parts)]
                codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
                errors = sum(far for _, far in found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id")[i:j], batch.column("label")[i:j], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())],
                    ["vec_id", "label", "code", "error"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every vector that is kept.

    A vector that is NULL or holds a NULL or non-finite component is dropped.  Components
    are floor(256 x); beyond +-2^24 they count as that.  Where lengths differ or are no
    multiple of ``parts``, vectors are taken to end with zeros up to the next multiple
    that holds the longest.  Rows that repeat a vec_id are coded each by its own vector,
    and of those the smaller vector comes first in the first codebooks; a NULL vec_id comes
    after all others there.  With fewer rows than ``entries`` there are as many entries as
    rows.  Rows without label count as one label.  Other columns are not read.  An empty
    table gives no rows.  ``entries`` is at most 256.
    """
    vectors = embeddings.where(is_kept(F.col("embedding"))).select("vec_id", "label", "embedding")
    rows, longest = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not rows:
        book = np.zeros((parts, 1, 0), np.int64)
    else:
        width = -(-longest // parts)
        book = trained(vectors, first_book(vectors, width, parts, entries), rows, rounds)
    # Written, so that the join reads both sides by shuffle and a common label can be split.
    codes = stored(encoded(vectors, book), "codes")
    sums = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    sha = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")
    )
