"""Quality classifier: importance resampling with hashed n-gram models.

Two generative models over hashed byte n-grams are fitted, one on the target (labelled
documents that are good and not toxic), one on the raw text of all documents.  The log
of their ratio is the importance of a document; the documents with the largest
importance plus Gumbel noise are the sample.  The importance is the mean per n-gram
times a fixed length, so that long documents are not judged by their length.

The model is a table of ``BUCKETS`` doubles whatever the corpus, so it is broadcast.
Raw counts are one pass over the corpus: a table per task, added in pieces of ``PIECE``
buckets.  Scoring is one pass without a shuffle; the k-th largest key is found by counting in
ever narrower bins, of which the driver sees the counts only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import free_name, lean, stored, with_fields
from rulewright.llm.textbytes import BYTE_CODES, STEP, U64, mix, slices

GRAMS = (4, 5, 6)
BUCKETS = 1 << 20
#: At most so many labelled documents make the target model and the cut, those with the
#: smallest hash of their id; the raw model counts every document.
LABELLED = 40_000
#: N-grams that a document's importance stands for.
LENGTH = 256
BINS = 4096
#: Bytes of text whose n-grams are held at once; each byte has three.
SLICE = 1 << 19
#: Added to every count.
ADDED = 0.2
#: Buckets that are added in one row.
PIECE = 1 << 10


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams inside each text, and the row of each."""
    rows = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    codes = BYTE_CODES[data]
    found, where = [], []
    h = np.zeros(len(data), U64)
    for n in range(1, min(max(GRAMS), len(data)) + 1):
        size = len(data) - n + 1
        h = h[:size] * STEP + codes[n - 1 :]
        if n not in GRAMS:
            continue
        inside = rows[:size] == rows[n - 1 :]
        seed = U64(n * pow(int(STEP), n, 1 << 64) % (1 << 64))
        found.append((mix(h[inside] + seed) >> U64(44)).astype(np.int32))
        where.append(rows[:size][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(where)


def labelled_ids(labels: DataFrame) -> DataFrame:
    """doc_id, good, fold of at most ``LABELLED`` labelled documents; rows without a verdict are left out."""
    once = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    order = F.crc32(F.col("doc_id").cast("string"))
    return (
        once.select("doc_id", ((F.col("quality") > 0) & (F.col("toxic") == 0)).alias("good"), (order % 5).alias("fold"))
        .orderBy(order, "doc_id")
        .limit(LABELLED)
    )


def gram_counts(docs: DataFrame) -> np.ndarray:
    """How many n-grams of all texts of ``docs`` fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_row = np.zeros(BUCKETS, np.int64), False
        for batch in batches:
            for _, _, data, at in slices(batch.column("text"), SLICE):
                any_row = True
                sums += np.bincount(_grams(data, at)[0], minlength=BUCKETS)
        if any_row:
            yield rows(enumerate(sums.reshape(-1, PIECE)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, value in zip(batch.column("part").to_pylist(), batch.column("sums")):
                sums[part] = sums.get(part, 0) + whole(value.as_buffer())
        if sums:
            yield rows(sums.items())

    def rows(sums: Iterable[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        # In the fewest bytes that hold the largest count.
        some = [(part, x.astype(np.min_scalar_type(x.max())).tobytes()) for part, x in sums if x.any()]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["part", "sums"])

    def whole(value) -> np.ndarray:
        return np.frombuffer(value, f"u{len(value) // PIECE}").astype(np.int64)

    shape = "part int, sums binary"
    total = np.zeros((BUCKETS // PIECE, PIECE), np.int64)
    # One row per piece.
    for row in docs.select("text").mapInArrow(lean(count), shape).repartition("part").mapInArrow(lean(add), shape).toLocalIterator():
        total[row.part] = whole(row.sums)
    return total.ravel()


def fit_ratio(target: DataFrame, raw: DataFrame) -> np.ndarray:
    """log(target share / raw share) per bucket of the texts of two tables; zeros without a target."""
    counts = gram_counts(target)
    if not counts.any():
        return np.zeros(BUCKETS)
    counts = np.stack([counts, gram_counts(raw)]) + ADDED
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def with_importance(docs: DataFrame, ratio: np.ndarray, name: str = "importance") -> DataFrame:
    """``docs`` with its log importance in column ``name``; a text too short for an n-gram has 0."""
    names = docs.columns
    at_text = names.index("text")
    model = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, at in slices(batch.column(at_text), SLICE):
                bucket, row = _grams(data, at)
                n = np.bincount(row, minlength=j - i)
                out[i:j] = LENGTH * np.bincount(row, model.value[bucket], j - i) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, name])

    return docs.mapInArrow(lean(score), with_fields(docs, **{name: "double"}))


def cut_point(importance: np.ndarray, good: np.ndarray) -> float:
    """The importance that splits labelled rows best, both verdicts weighing the same; -inf if no split gains."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(importance, kind="stable")
    x, g = importance[order], good[order]
    lost = np.cumsum(g) / g.sum()
    caught = np.cumsum(~g) / (~g).sum()
    gain = np.where(np.append(x[1:] > x[:-1], True), caught - 2 * lost, -np.inf)
    best = int(np.argmax(gain))
    # Past the last row all good ones are lost, so that a split that gains has a row after it.
    return float((x[best] + x[best + 1]) / 2) if gain[best] > 0 else -np.inf


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of a column ``key`` of doubles (1 is the largest)."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return low
    inside, above = keys, 0
    while high > low and n > BINS:
        step = (high - low) / BINS
        cell = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(step)), F.lit(BINS - 1)).cast("int")
        cells = {r.cell: r for r in inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        for c in sorted(cells, reverse=True):
            if above + cells[c].n >= k:
                break
            above += cells[c].n
        low, high, n = cells[c].low, cells[c].high, cells[c].n
        inside = keys.where(F.col("key").between(low, high))
    if high == low:
        return low
    ordered = sorted((r.key for r in inside.select("key").collect()), reverse=True)
    return ordered[k - above - 1]


def judge(docs: DataFrame, labels: DataFrame, seed: int = 8, clear: bool = False) -> DataFrame:
    """``docs`` with ``importance`` (log), ``key`` (importance plus Gumbel noise) and ``kept``.

    As many documents are sampled as have an importance above the cut that best splits
    labelled documents held out from the fit (losing a good one costs twice a bad one);
    they are those with the largest keys, and rows with equal keys share a fate.  Noise
    depends on doc_id and ``seed``; rows without doc_id share one noise.  NULL and empty
    texts have importance 0.  All rows are kept without labels of both verdicts, in the fit
    and held out, and if no cut catches more of the bad than twice the share of the good it
    loses.  Columns of ``docs`` with these three names are replaced.  ``clear`` returns the kept rows with
    the columns they came with.  An empty table gives no rows.
    """
    added = [free_name(docs, "__" + c) for c in ("importance", "key")] if clear else ["importance", "key"]
    named, key = added
    docs = docs if clear else docs.drop(*added, "kept")
    picked = stored(labelled_ids(labels), "labelled")
    # At most LABELLED rows, so the broadcast is bounded.
    labelled = stored(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), "labelled-text")
    ratio = fit_ratio(labelled.where("fold > 0 AND good"), docs)
    held = with_importance(labelled.where("fold = 0").select("text", "good"), ratio).select("importance", "good").collect()
    both = labelled.where("fold > 0").agg(F.count_distinct("good")).first()[0] == 2
    cut = cut_point(np.array([r.importance for r in held]), np.array([r.good for r in held], bool)) if both else -np.inf
    # The sign bit off, half a step up: a fraction strictly between 0 and 1.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    scored = with_importance(docs, ratio, named).withColumn(key, F.col(named) - F.log(-F.log(uniform)))
    keys = stored(scored.select(F.col(key).alias("key"), F.col(named).alias("importance")), "importance")
    k = keys.where(F.col("importance") >= F.lit(cut)).count()
    kept = F.col(key) >= F.lit(kth_largest(keys, k))
    return scored.where(kept).drop(*added) if clear else scored.withColumn("kept", kept)
