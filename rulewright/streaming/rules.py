"""Rules over streams: the same projection, written batch by batch.

A rule looks at one row at a time, so there is no state, watermark or shuffle,
and a batch that is run again gives the same rows.

``apply_rule_batches`` also keeps running totals.  A batch's rows go to a folder of its
number and its totals to one of two slots, both replaced if the batch is run again, so a
repeated batch counts once; totals are read from two rows, however long the stream is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rulewright.functions.text import column
from rulewright.operators.results import ROWS_PER_FILE, Totals, totals, write_counted
from rulewright.operators.transform import COUNTER, apply_rule
from rulewright.rule import TextRule
from rulewright.sources.tables import read_or_empty

OBSERVED = "totals"
#: The folders of batches; a hidden column of the result.
BATCH = "__batch"
SLOTS = 2
RUNNING_SCHEMA = "batch bigint, rows bigint, matched bigint, all_rows bigint, all_matched bigint, slot int"


def apply_rule_stream(
    stream: DataFrame,
    rule: TextRule,
    targets: Sequence[str],
    value: str = "",
    *,
    output: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start writing the rule's result as Parquet; each row arrives once.

    By default everything available is processed and the query ends; pass for
    instance ``trigger={"processingTime": "1 minute"}`` to keep it going.
    """
    outcome = apply_rule(stream, rule, targets, value)
    watched = outcome.frame.observe(
        OBSERVED,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(column(COUNTER)), F.lit(0)).alias("matched"),
    )
    return (
        watched.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def apply_rule_batches(
    stream: DataFrame,
    rule: TextRule,
    targets: Sequence[str],
    value: str = "",
    *,
    output: str,
    running: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """As apply_rule_stream, with running totals at ``running``, which belongs to the checkpoint.

    The result has the batch's number in the hidden column ``__batch``.
    """
    outcome = apply_rule(stream, rule, targets, value)

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, output=output, running=running)

    return (
        outcome.frame.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def write_batch(batch: DataFrame, number: int, *, output: str, running: str) -> None:
    """Write one batch and its totals; running it again replaces both.

    Slot ``number % 2`` is replaced, while the other keeps the batch before, from which the
    totals go on.  Batch 0 starts a table anew.
    """
    spark = batch.sparkSession
    got = write_counted(batch, f"{output}/{BATCH}={number}")
    before = None
    if number:
        before = read_or_empty(spark, running, RUNNING_SCHEMA).where(F.col("batch") == number - 1).first()
        if before is None:
            raise RuntimeError(f"the totals at {running} do not hold batch {number - 1}: they are of another checkpoint")
    known = Totals(before["all_rows"], before["all_matched"]) if before else Totals(0, 0)
    row = (number, got.rows, got.matched, known.rows + got.rows, known.matched + got.matched)
    line = spark.createDataFrame([row], RUNNING_SCHEMA.rsplit(",", 1)[0]).coalesce(1)
    if number:
        line.write.mode("overwrite").parquet(f"{running}/slot={number % SLOTS}")
    else:
        line.withColumn("slot", F.lit(0)).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("slot").parquet(running)


def running_totals(spark: SparkSession, running: str) -> Totals:
    """Counts of everything that apply_rule_batches has written, 0 before the first batch; the output is not read."""
    last = read_or_empty(spark, running, RUNNING_SCHEMA).orderBy(F.col("batch").desc()).first()
    return Totals(last["all_rows"], last["all_matched"]) if last else Totals(0, 0)


def stream_totals(spark: SparkSession, output: str) -> Totals:
    """Counts of everything a stream has written, from the counter column of its output."""
    row = totals(spark.read.parquet(output)).first()
    return Totals(row["total_rows"], row["matched_cells"])


def batch_totals(query: StreamingQuery) -> list[Totals]:
    """Counts of the latest batches, oldest first: those that Spark still remembers, 100
    by default.  For a whole stream see stream_totals."""
    seen = [p.observedMetrics.get(OBSERVED) for p in query.recentProgress]
    return [Totals(m["rows"], m["matched"]) for m in seen if m is not None]
