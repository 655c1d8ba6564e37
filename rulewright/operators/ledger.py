"""The table of runs: states, reports and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.text import MESSAGE_CLIP, TYPE_CLIP, clip, seconds_between

# The states of a run, which of them end it, and defaults.
STATES = ("QUEUED", "RUNNING", "SUCCESS", "FAILED", "CANCELLED")
TERMINAL = ("SUCCESS", "FAILED", "CANCELLED")
STALE_HOURS = 6
STALE_TYPE = "StaleJob"
LIST_SIZE = 20
LIST_CEILING = 500

LEDGER_SCHEMA = (
    "id string, status string, progress int, phase string, attempt int, source_key string, "
    "sheet_name string, operation string, natural_language string, replacement_value string, "
    "target_columns array<string>, force_refresh boolean, regex_pattern string, "
    "regex_case_insensitive boolean, replacement_template string, extract_group int, "
    "llm_provider string, llm_model string, llm_explanation string, llm_confidence double, "
    "llm_cached boolean, llm_warnings array<string>, self_test_passed boolean, output_path string, "
    "index_path string, result_columns array<string>, total_rows bigint, matched_cells bigint, "
    "added_columns array<string>, error_message string, error_type string, "
    "created_at timestamp, started_at timestamp, finished_at timestamp"
)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def with_status(ledger: DataFrame, status: str) -> DataFrame:
    """Runs in one state, given in any case."""
    return ledger.where(F.col("status") == F.upper(F.lit(status)))


def duration_seconds(now: Column) -> Column:
    """Seconds a run took, or has taken so far; NULL before it starts."""
    return seconds_between(F.col("started_at"), F.coalesce(F.col("finished_at"), now))


def queue_wait_seconds() -> Column:
    return seconds_between(F.col("created_at"), F.col("started_at"))


def is_stale(now: Column, hours: int = STALE_HOURS) -> Column:
    """Still running after more than ``hours``."""
    age = F.unix_micros(now) - F.unix_micros("started_at")
    return (F.col("status") == "RUNNING") & (age > hours * 3_600_000_000)


def stale_runs(ledger: DataFrame, now: Column, hours: int = STALE_HOURS) -> DataFrame:
    return ledger.where(is_stale(now, hours))


def fail_stale(ledger: DataFrame, now: Column, hours: int = STALE_HOURS) -> DataFrame:
    """The ledger with stale runs marked FAILED."""
    stale = is_stale(now, hours)
    message = clip(F.lit(f"still running after {hours}h; taken for dead"), MESSAGE_CLIP)
    changed = {
        "status": F.lit("FAILED"),
        "phase": F.lit("failed"),
        "finished_at": now,
        "error_message": message,
        "error_type": clip(F.lit(STALE_TYPE), TYPE_CLIP),
    }
    marked = ledger.withColumn("__stale", F.coalesce(stale, F.lit(False)))
    present = {n: F.when(F.col("__stale"), v).otherwise(F.col(n)) for n, v in changed.items() if n in ledger.columns}
    return marked.withColumns(present).drop("__stale")


def current_state(transitions: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Latest state per run from its transitions (id, at, status, progress, phase).

    ``live`` (id, at, progress, phase) holds fresher progress, which counts until
    the run has ended.  Both are folded per id where they are read, so a run with
    very many rows moves as one row per task.
    """
    stored = _latest(transitions, "status", "progress", "phase")
    if live is None:
        return stored
    fresher = _latest(live, "progress", "phase").select(
        "id", F.col("progress").alias("live_progress"), F.col("phase").alias("live_phase")
    )
    ended = is_terminal(F.col("status"))
    prefer = lambda name: F.when(ended, F.col(name)).otherwise(
        F.coalesce(f"live_{name}", name)
    )
    return stored.join(fresher, "id", "left").select(
        "id", "status", prefer("progress").alias("progress"), prefer("phase").alias("phase")
    )


def _latest(rows: DataFrame, *names: str) -> DataFrame:
    # The whole row orders rows of the same instant, so the choice never varies.
    newest = F.max(F.struct("at", *names)).alias("last")
    return rows.groupBy("id").agg(newest).select("id", *[F.col(f"last.{n}").alias(n) for n in names])


def status_counts(ledger: DataFrame) -> DataFrame:
    """Runs per state, states without runs included; one pass, nothing joined."""
    counted = ledger.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATES])
    pairs = [F.struct(F.lit(s).alias("status"), F.col(s).alias("runs")) for s in STATES]
    return counted.select(F.inline(F.array(*pairs)))


def run_metrics(ledger: DataFrame) -> DataFrame:
    """One row of totals: all runs, the work of the successful ones, remembered rules."""
    done = F.col("status") == "SUCCESS"
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows, cells = F.when(done, F.col("total_rows")), F.when(done, F.col("matched_cells"))
    confidence = F.avg(F.when(done, F.col("llm_confidence")))
    return ledger.agg(
        F.count(F.lit(1)).alias("jobs_total"),
        zero(F.sum(rows)).alias("rows_processed_total"),
        zero(F.sum(cells)).alias("cells_matched_total"),
        zero(F.max(rows)).alias("largest_job_rows"),
        F.bround(F.coalesce(confidence, F.lit(0.0)), 3).alias("avg_llm_confidence"),
        F.count_if("llm_cached").alias("cache_hit_jobs"),
    )


def full_view(ledger: DataFrame, now: Column) -> DataFrame:
    """Whole run with the rule's fields nested under ``regex``."""
    regex = {
        "pattern": "regex_pattern",
        "case_insensitive": "regex_case_insensitive",
        "replacement_template": "replacement_template",
        "group": "extract_group",
        "provider": "llm_provider",
        "model": "llm_model",
        "explanation": "llm_explanation",
        "confidence": "llm_confidence",
        "cached": "llm_cached",
        "warnings": "llm_warnings",
        "self_test_passed": "self_test_passed",
    }
    before = (
        "id status progress phase source_key sheet_name operation natural_language "
        "replacement_value target_columns"
    ).split()
    after = (
        "result_columns added_columns total_rows matched_cells error_message error_type "
        "attempt created_at started_at finished_at"
    ).split()
    return ledger.select(
        *before,
        F.struct(*[F.col(c).alias(n) for n, c in regex.items()]).alias("regex"),
        *after,
        duration_seconds(now).alias("duration_seconds"),
        queue_wait_seconds().alias("queue_wait_seconds"),
    )


def summary_view(ledger: DataFrame, now: Column) -> DataFrame:
    """Compact run for a list."""
    names = (
        "id status progress operation source_key natural_language total_rows matched_cells created_at"
    ).split()
    return ledger.select(*names, duration_seconds(now).alias("duration_seconds"))


def newest_first(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.col("created_at").desc(), F.col("id").desc())


def latest_runs(ledger: DataFrame) -> DataFrame:
    """One row per run of a ledger that holds a row per transition: the ended or else newest one."""
    ended = F.struct(is_terminal(F.col("status")).alias("ended"), F.coalesce("finished_at", "started_at", "created_at").alias("at"))
    last = F.max(F.struct(ended.alias("order"), F.struct(*ledger.columns).alias("run"))).alias("last")
    return ledger.groupBy("id").agg(last).select("last.run.*")


def runs_after(ledger: DataFrame, created_at: Column, run_id: Column, size: int = LIST_SIZE) -> DataFrame:
    """The page of runs after the one named, newest first.

    Pages by the last seen run, so a task holds one page however deep it lies.
    """
    older = (F.col("created_at") < created_at) | ((F.col("created_at") == created_at) & (F.col("id") < run_id))
    return list_page(ledger.where(older), 1, size)


def list_page(ledger: DataFrame, page: int = 1, size: int = LIST_SIZE) -> DataFrame:
    """One page of runs, newest first; a size below 1 is the usual size, one above 500 is 500.

    For deep pages see runs_after.
    """
    taken = min(size, LIST_CEILING) if size >= 1 else LIST_SIZE
    return newest_first(ledger).offset((max(page, 1) - 1) * taken).limit(taken)
