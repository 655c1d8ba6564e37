"""One run, from source to ledger row."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.errors import RuleError, SourceError
from rulewright.functions.text import MESSAGE_CLIP, TYPE_CLIP
from rulewright.operators.ledger import LEDGER_SCHEMA
from rulewright.operators.ledger_files import LedgerFiles, append_rows
from rulewright.operators.lint import lint_rules
from rulewright.operators.paging import PAGE_SIZE, PAGE_SIZE_CEILING, open_index, page_index, read_page, save_index
from rulewright.operators.requests import gate_requests, payloads
from rulewright.operators.resolve import judge_answers, keyed, live_entries, open_memory, remember, resolve
from rulewright.operators.results import write_counted
from rulewright.operators.transform import apply_rule, resolve_targets
from rulewright.rule import REPLACE, TextRule, rules_table
from rulewright.sources.preview import sample_values
from rulewright.sources.tables import read_table, resolve_uri

GATE_SCHEMA = (
    "source_key string, sheet_name string, operation string, natural_language string, "
    "replacement_value string, target_columns array<string>"
)
ASK_SCHEMA = (
    "request_id string, operation string, description string, replacement_value string, "
    "force_refresh boolean, columns array<string>, samples array<string>"
)

# The progress told when the rule is settled and when the result is written.
RULE_SETTLED = 24
RESULT_WRITTEN = 78


@dataclass
class RunRequest:
    """What to do with one source."""

    source_key: str
    target_columns: list[str]
    natural_language: str
    operation: str = REPLACE
    replacement_value: str = ""
    sheet_name: str = ""
    force_refresh: bool = False
    id: str = field(default_factory=lambda: str(uuid.uuid4()))


@dataclass
class RuleSource:
    """Where a run gets its rule: given, remembered, or read from answers.

    ``memory`` has key, rule, stored_at; ``answers`` has key, operation, attempt,
    answer (see operators.resolve).  With ``memory_path`` memory is the Parquet table
    there, empty if there is none yet, and a rule that was accepted from an answer is
    added to it.
    """

    rule: TextRule | None = None
    memory: DataFrame | None = None
    answers: DataFrame | None = None
    provider: str = ""
    model: str = ""
    memory_path: str = ""

    def remembered(self, spark: SparkSession) -> DataFrame | None:
        return open_memory(spark, self.memory_path) if self.memory_path else self.memory


def _now() -> datetime:
    return datetime.now(timezone.utc)


def ask(spark: SparkSession, request: RunRequest, frame: DataFrame, rules: RuleSource) -> DataFrame:
    """The request as one row with its key and model payload."""
    targets = resolve_targets(frame, request.target_columns)
    samples = [r["sample"] for r in sample_values(frame, targets).collect()]
    row = (
        request.id,
        request.operation,
        request.natural_language,
        request.replacement_value,
        request.force_refresh,
        targets,
        samples,
    )
    return payloads(keyed(spark.createDataFrame([row], ASK_SCHEMA), rules.provider, rules.model))


def settle_rule(
    spark: SparkSession, request: RunRequest, frame: DataFrame, rules: RuleSource
) -> tuple[TextRule, dict]:
    """The vetted rule and the ledger fields that describe it."""
    if rules.rule is not None:
        row = lint_rules(rules_table(spark, [rules.rule])).first()
        if not row["accepted"]:
            raise RuleError(row["reason"])
        cached = False
    else:
        memory = rules.remembered(spark)
        if memory is None or rules.answers is None:
            raise RuleError("give a rule, or both memory and answers")
        asked = ask(spark, request, frame, rules)
        # One request: its key, as a value, reaches the scans of both tables.
        own = F.col("key") == asked.first()["key"]
        live = live_entries(memory.where(own), F.current_timestamp())
        verdicts = judge_answers(rules.answers.where(own))
        outcome = resolve(asked, live, verdicts).first()
        if outcome["rule"] is None:
            raise RuleError(outcome["reason"] or "no answer has come in for this description")
        row, cached = outcome["rule"], outcome["was_cached"]
        if rules.memory_path and not cached:
            # One row; readers of memory take the newest of a key.
            remember(memory.limit(0), verdicts, F.current_timestamp()).write.mode("append").parquet(rules.memory_path)

    given = row.asDict()
    given.update(operation=request.operation)
    given.setdefault("provider", rules.provider)
    given.setdefault("model", rules.model)
    if rules.rule is not None:
        given["requires"] = rules.rule.requires
    rule = TextRule.from_row(given)
    return rule, {
        "regex_pattern": rule.pattern,
        "regex_case_insensitive": rule.case_insensitive,
        "replacement_template": rule.replacement_template,
        "extract_group": rule.group,
        "llm_provider": rule.provider,
        "llm_model": rule.model,
        "llm_explanation": rule.explanation,
        "llm_confidence": float(rule.confidence),
        "llm_cached": cached,
        "llm_warnings": list(given.get("warnings") or []),
        "self_test_passed": given.get("self_test_passed"),
    }


def run_request(
    spark: SparkSession,
    request: RunRequest,
    rules: RuleSource,
    *,
    results: str,
    ledger: str,
    base: str = "",
    attempt: int = 1,
) -> DataFrame:
    """Run one request; the ledger gets a row when it starts, when its rule is settled, when its
    result is written and when it ends.

    A run that dies in the work has therefore left its rule.  The last row is returned.  The rows
    go to buckets of time (see ledger_files, which folds and reads them); ledger.latest_runs makes
    one row per run of them.
    The run uses the request as the gate cleaned it, and the ledger tells the same.  With
    ``base`` a key is relative to it, so leading slashes go; without, a key is a whole URI
    or path and keeps them.  The result goes to ``results``/<id>, its page index to
    ``results``/<id>.index.  Problems with the request, rule or source end in a FAILED
    row, and so do all other errors, which are raised as well.
    """
    request, problems = _gated(spark, request, base)
    created = _now()
    row = {
        "id": request.id,
        "status": "RUNNING",
        "progress": 1,
        "phase": "starting",
        "attempt": attempt,
        "source_key": request.source_key,
        "sheet_name": request.sheet_name,
        "operation": request.operation,
        "natural_language": request.natural_language,
        "replacement_value": request.replacement_value,
        "target_columns": list(request.target_columns),
        "force_refresh": request.force_refresh,
        "created_at": created,
        "started_at": created,
    }
    _append(spark, row, ledger)
    try:
        if problems:
            raise RuleError("; ".join(problems))
        _run(spark, request, rules, results.rstrip("/"), base, row, ledger)
        row.update(status="SUCCESS", progress=100, phase="done")
    except (RuleError, SourceError) as problem:
        row.update(_failure(problem))
    except BaseException as problem:
        _append(spark, row | _failure(problem) | {"finished_at": _now()}, ledger)
        raise
    return _append(spark, row | {"finished_at": _now()}, ledger)


def _gated(spark: SparkSession, request: RunRequest, base: str) -> tuple[RunRequest, list[str]]:
    """The request as the gate cleaned it, and what the gate has against it."""
    gate = [
        (
            request.source_key,
            request.sheet_name,
            request.operation,
            request.natural_language,
            request.replacement_value,
            list(request.target_columns),
        )
    ]
    clean = gate_requests(spark.createDataFrame(gate, GATE_SCHEMA)).first()
    names = ("sheet_name", "operation", "natural_language", "replacement_value", "target_columns")
    key = clean["source_key"] if base else request.source_key.strip()
    return replace(request, source_key=key, **{n: clean[n] for n in names}), clean["problems"]


def _run(spark, request: RunRequest, rules: RuleSource, results: str, base: str, row: dict, ledger: str) -> None:
    """The work of a run; ``row`` is filled in as it goes, and written to the ledger in between."""
    frame = read_table(spark, resolve_uri(request.source_key, base))
    resolve_targets(frame, request.target_columns)
    rule, told = settle_rule(spark, request, frame, rules)
    outcome = apply_rule(frame, rule, request.target_columns, request.replacement_value)
    output, index = f"{results}/{request.id}", f"{results}/{request.id}.index"
    row.update(told, output_path=output, result_columns=outcome.visible_columns, added_columns=outcome.added_columns)
    row.update(progress=RULE_SETTLED, phase="transforming")
    _append(spark, row, ledger)
    totals = write_counted(outcome.frame, output)
    row.update(total_rows=totals.rows, matched_cells=totals.matched, progress=RESULT_WRITTEN, phase="indexing")
    _append(spark, row, ledger)
    save_index(page_index(spark, output), index)
    row.update(index_path=index)


@dataclass(frozen=True)
class ResultPage:
    """A page of a finished run with all that is shown around it."""

    frame: DataFrame
    columns: list[str]
    added_columns: list[str]
    page: int
    page_size: int
    total_rows: int
    matched_cells: int
    total_pages: int
    has_next: bool
    has_previous: bool
    row_offset: int


def result_page(spark: SparkSession, run, page: int = 1, page_size: int | None = None, columns: list[str] | None = None) -> ResultPage:
    """One page of a run (a row of latest_runs), its columns and counters, and where it stands.

    A size that is missing is the usual one; others count as the nearest allowed.  Pages
    below 1 are page 1, pages past the end are empty.  A run that has not succeeded has none.
    """
    told = run.asDict()
    if told["status"] != "SUCCESS":
        raise RuleError(f"the run has no result: it is {told['status']}")
    size = PAGE_SIZE if page_size is None else max(1, min(page_size, PAGE_SIZE_CEILING))
    page = max(page, 1)
    frame = read_page(spark, open_index(spark, told["index_path"]), page, size, columns)
    total = -(-told["total_rows"] // size)
    return ResultPage(
        frame=frame,
        columns=frame.columns,
        added_columns=list(told["added_columns"] or []),
        page=page,
        page_size=size,
        total_rows=told["total_rows"],
        matched_cells=told["matched_cells"],
        total_pages=total,
        has_next=page < total,
        has_previous=page > 1,
        row_offset=(page - 1) * size,
    )


def _failure(problem: Exception) -> dict:
    return {
        "status": "FAILED",
        "phase": "failed",
        "error_message": str(problem)[:MESSAGE_CLIP],
        "error_type": type(problem).__name__[:TYPE_CLIP],
    }


def _append(spark: SparkSession, row: dict, ledger: str) -> DataFrame:
    line = spark.createDataFrame([row], LEDGER_SCHEMA)
    append_rows(line.coalesce(1), LedgerFiles(ledger), F.lit(_now()))
    return line
