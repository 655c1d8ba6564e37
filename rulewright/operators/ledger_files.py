"""The ledger as files: small appends in buckets of time, folded into few large files.

A run appends a row per transition, a tiny file each, below ``bucket=<n>`` of the time
of writing.  ``fold_ledger`` folds all buckets before a point in time, which get no more
rows, into one row per run:

* runs that have ended go to ``<path>.folded/ended/fold=<n>``, written once and never read
  again by a fold, so history is not rewritten;
* the others go to ``<path>.folded/unfinished/fold=<n>``, a snapshot that the next fold
  continues.  Finding stale runs reads that snapshot and the open buckets only;
* a row in ``<path>.folded/folds`` says that the fold is whole.  It is written last: files
  of a fold that died are not read, and the fold can be run again.

The newest row of a run counts, by ``at`` and then by all its columns, so rows that repeat
change nothing.  One fold runs at a time; appends may go on meanwhile.  Open buckets before
the last fold are not read any more and may be removed by the store's retention.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.operators.ledger import LEDGER_SCHEMA, is_terminal, latest_runs
from rulewright.sources.tables import read_or_empty

BUCKET_HOURS = 24


@dataclass(frozen=True)
class LedgerFiles:
    """Where a ledger lies, its columns (id and status among them), how the newest row of
    each run is found, and how many hours make a bucket."""

    path: str
    schema: str = LEDGER_SCHEMA
    newest: Callable[[DataFrame], DataFrame] = latest_runs
    hours: int = BUCKET_HOURS

    def bucket(self, at: Column) -> Column:
        return F.floor(F.unix_micros(at.cast("timestamp")) / (self.hours * 3_600_000_000)).cast("int")

    def folded(self, part: str) -> str:
        return f"{self.path}.folded/{part}"


def append_rows(rows: DataFrame, files: LedgerFiles, at: Column) -> None:
    """Add transitions to the buckets of ``at``, the time at which they are written, which no fold
    may have passed; a row without a time counts as written now."""
    bucket = F.coalesce(files.bucket(at), files.bucket(F.current_timestamp()))
    # Rows of a bucket are brought together, so that a large append writes few files.
    rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(files.path)


def last_fold(spark: SparkSession, files: LedgerFiles) -> int | None:
    """First bucket that is still open; None before the first fold."""
    return read_or_empty(spark, files.folded("folds"), "first_open int").agg(F.max("first_open")).first()[0]


def fold_ledger(spark: SparkSession, files: LedgerFiles, before: datetime) -> bool:
    """Fold the buckets that end at or before ``before``; False if there is nothing new to fold."""
    mark = spark.range(1).select(files.bucket(F.lit(before))).first()[0]
    done = last_fold(spark, files)
    if done is not None and mark <= done:
        return False
    fresh = _open(spark, files, done).where(F.col("bucket") < mark).drop("bucket")
    state = files.newest(_unfinished(spark, files, done).unionByName(fresh))
    ended = F.coalesce(is_terminal(F.col("status")), F.lit(False))
    for part, rows in (("ended", state.where(ended)), ("unfinished", state.where(~ended))):
        rows.write.mode("overwrite").parquet(files.folded(f"{part}/fold={mark}"))
    spark.createDataFrame([(mark,)], "first_open int").write.mode("append").parquet(files.folded("folds"))
    return True


def ledger_rows(spark: SparkSession, files: LedgerFiles, since: Column | None = None) -> DataFrame:
    """Folded and open rows together; ``files.newest`` of them is one row per run.

    With ``since`` runs that were folded as ended before that time are left out: their
    files are pruned, not read.
    """
    done = last_fold(spark, files)
    rows = _open(spark, files, done).drop("bucket")
    if done is None:
        return rows
    ended = read_or_empty(spark, files.folded("ended"), f"{files.schema}, fold int").where(F.col("fold") <= done)
    if since is not None:
        ended = ended.where(F.col("fold") > files.bucket(since))
    return ended.drop("fold").unionByName(_unfinished(spark, files, done)).unionByName(rows)


def unfinished_runs(spark: SparkSession, files: LedgerFiles) -> DataFrame:
    """Runs that have not ended, one row each; the history of ended runs is not read.

    A run that gets new rows after it was folded as ended counts by these rows.
    """
    done = last_fold(spark, files)
    state = files.newest(_unfinished(spark, files, done).unionByName(_open(spark, files, done).drop("bucket")))
    return state.where(~F.coalesce(is_terminal(F.col("status")), F.lit(False)))


def _open(spark: SparkSession, files: LedgerFiles, done: int | None) -> DataFrame:
    rows = read_or_empty(spark, files.path, f"{files.schema}, bucket int")
    return rows if done is None else rows.where(F.col("bucket") >= done)


def _unfinished(spark: SparkSession, files: LedgerFiles, done: int | None) -> DataFrame:
    if done is None:
        return spark.createDataFrame([], files.schema)
    return read_or_empty(spark, files.folded(f"unfinished/fold={done}"), files.schema)
