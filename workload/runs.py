"""Queries over the ledger of runs, whole runs, and streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from rulewright import MASK, VALIDATE, RuleSource, RunRequest, TextRule, apply_rule_stream, known_rule, read_page, run_request
from rulewright.operators.ledger import (
    LEDGER_SCHEMA,
    STATES,
    current_state,
    fail_stale,
    full_view,
    is_terminal,
    latest_runs,
    list_page,
    run_metrics,
    runs_after,
    stale_runs,
    status_counts,
    summary_view,
    with_status,
)
from rulewright.operators.ledger_files import LedgerFiles, append_rows, fold_ledger, ledger_rows, unfinished_runs
from rulewright.operators.paging import open_index
from rulewright.operators.resolve import MEMORY_SCHEMA, keyed
from rulewright.plans.run import result_page
from rulewright.session import scratch_path
from rulewright.streaming.rules import BATCH, apply_rule_batches, running_totals, write_batch
from workload.registry import both, choose, derive, query, table, text
from workload.rules import EMAIL, counter, found
from workload.tables import delimited

NOW = "1998-08-02 12:00:00"
# A run per order.  Times are whole hundredths of a second off half steps.
_SPARK_RUNS, _SQL_RUNS = both(
    f"""lpad(CAST(o_orderkey AS {{text}}), 12, '0') AS id, {choose(list(STATES), 'o_custkey')} AS status,
    CAST(o_orderkey % 101 AS INTEGER) AS progress, concat('phase ', o_orderstatus) AS phase,
    CAST(o_orderkey % 3 AS INTEGER) AS attempt, concat('raw/', o_orderpriority, '.csv') AS source_key,
    '' AS sheet_name, {choose(['REPLACE', 'MASK', 'EXTRACT', 'VALIDATE'], 'o_orderkey')} AS operation,
    concat('find ', o_orderpriority) AS natural_language, 'x' AS replacement_value,
    {{list}}(o_orderstatus) AS target_columns, concat('[', o_orderstatus, ']') AS regex_pattern,
    o_orderkey % 2 = 0 AS regex_case_insensitive, '' AS replacement_template,
    CAST(o_orderkey % 4 AS INTEGER) AS extract_group, 'batch' AS llm_provider, 'm-1' AS llm_model,
    'why' AS llm_explanation, (o_orderkey % 1000) / 1000.0e0 AS llm_confidence, o_custkey % 3 = 0 AS llm_cached,
    {{list}}('w') AS llm_warnings, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 1 END AS self_test_passed,
    {{list}}(o_orderstatus) AS result_columns, {{list}}('new') AS added_columns,
    o_orderkey * 7 AS total_rows, o_orderkey % 1009 AS matched_cells,
    '' AS error_message, '' AS error_type,
    {{stamp}}({{micros}}(o_orderdate) + o_orderkey * 1000000) AS created_at,
    CASE WHEN o_custkey % 5 > 0 THEN {{stamp}}({{micros}}(o_orderdate) + o_orderkey * 1000000
      + (o_orderkey % 977) * 10000 + 3000) END AS started_at,
    CASE WHEN o_custkey % 5 > 1 THEN {{stamp}}({{micros}}(o_orderdate) + o_orderkey * 1000000
      + (o_orderkey % 977) * 20000 + 7000) END AS finished_at"""
)
RUNS = f"runs AS (SELECT {_SQL_RUNS} FROM orders)"


def runs_of_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return derive(orders, _SPARK_RUNS)


def now():
    return F.lit(NOW).cast("timestamp")


_DURATION = f"""CASE WHEN started_at IS NOT NULL THEN
    round_even((epoch_us(coalesce(finished_at, TIMESTAMP '{NOW}')) - epoch_us(started_at)) / 1e6, 2) END"""
_WAIT = "round_even((epoch_us(started_at) - epoch_us(created_at)) / 1e6, 2)"


@query(
    "runs_full",
    f"""WITH {RUNS} SELECT id, status, progress, phase, operation, natural_language,
    target_columns[1] AS target, regex_pattern AS pattern, regex_case_insensitive AS case_insensitive,
    extract_group AS group_no, llm_confidence AS confidence, llm_cached AS cached, self_test_passed,
    total_rows, matched_cells, attempt, {_DURATION} AS duration_seconds, {_WAIT} AS queue_wait_seconds FROM runs""",
)
def runs_full(spark, sf_dir):
    """Whole runs; the nested rule is laid out flat to be compared."""
    view = full_view(runs_of_orders(spark, sf_dir), now())
    return view.select(
        "id", "status", "progress", "phase", "operation", "natural_language",
        F.col("target_columns")[0].alias("target"), "regex.pattern", "regex.case_insensitive",
        F.col("regex.group").alias("group_no"), "regex.confidence", "regex.cached", "regex.self_test_passed",
        "total_rows", "matched_cells", "attempt", "duration_seconds", "queue_wait_seconds",
    )


@query(
    "runs_summary",
    f"""WITH {RUNS} SELECT id, status, progress, operation, source_key, natural_language, total_rows, matched_cells,
    {_DURATION} AS duration_seconds FROM runs""",
)
def runs_summary(spark, sf_dir):
    return summary_view(runs_of_orders(spark, sf_dir), now()).drop("created_at")


@query("runs_with_status", f"WITH {RUNS} SELECT id, status FROM runs WHERE status = 'FAILED'")
def runs_with_status(spark, sf_dir):
    return with_status(runs_of_orders(spark, sf_dir), "failed").select("id", "status")


@query(
    "runs_ended",
    f"WITH {RUNS} SELECT id, status IN ('SUCCESS', 'FAILED', 'CANCELLED') AS ended FROM runs",
)
def runs_ended(spark, sf_dir):
    return runs_of_orders(spark, sf_dir).select("id", is_terminal(F.col("status")).alias("ended"))


STALE = f"status = 'RUNNING' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 6 HOUR"


@query("runs_stale", f"WITH {RUNS} SELECT id FROM runs WHERE {STALE}")
def runs_stale(spark, sf_dir):
    return stale_runs(runs_of_orders(spark, sf_dir), now()).select("id")


@query(
    "runs_after_sweep",
    f"""WITH {RUNS} SELECT id, CASE WHEN {STALE} THEN 'FAILED' ELSE status END AS status,
    CASE WHEN {STALE} THEN 'failed' ELSE phase END AS phase,
    CASE WHEN {STALE} THEN 'still running after 6h; taken for dead' ELSE error_message END AS error_message,
    CASE WHEN {STALE} THEN 'StaleJob' ELSE error_type END AS error_type,
    epoch_us(CASE WHEN {STALE} THEN TIMESTAMP '{NOW}' ELSE finished_at END) AS finished_us FROM runs""",
)
def runs_after_sweep(spark, sf_dir):
    """The ledger with stale runs failed."""
    swept = fail_stale(runs_of_orders(spark, sf_dir), now())
    return swept.select(
        "id", "status", "phase", "error_message", "error_type", F.unix_micros("finished_at").alias("finished_us")
    )


@query(
    "runs_by_status",
    f"""WITH {RUNS}
    SELECT s AS status, (SELECT count(*) FROM runs WHERE status = s) AS runs
    FROM (VALUES ('QUEUED'), ('RUNNING'), ('SUCCESS'), ('FAILED'), ('CANCELLED')) AS v(s)""",
)
def runs_by_status(spark, sf_dir):
    return status_counts(runs_of_orders(spark, sf_dir))


@query(
    "run_metrics",
    f"""WITH {RUNS} SELECT count(*) AS jobs_total,
    CAST(coalesce(sum(total_rows) FILTER (status = 'SUCCESS'), 0) AS BIGINT) AS rows_processed_total,
    CAST(coalesce(sum(matched_cells) FILTER (status = 'SUCCESS'), 0) AS BIGINT) AS cells_matched_total,
    coalesce(max(total_rows) FILTER (status = 'SUCCESS'), 0) AS largest_job_rows,
    round_even(coalesce(avg(llm_confidence) FILTER (status = 'SUCCESS'), 0), 3) AS avg_llm_confidence,
    count(*) FILTER (llm_cached) AS cache_hit_jobs FROM runs""",
)
def metrics(spark, sf_dir):
    return run_metrics(runs_of_orders(spark, sf_dir))


@query(
    "run_metrics_empty",
    """SELECT CAST(0 AS BIGINT) AS jobs_total, CAST(0 AS BIGINT) AS rows_processed_total,
    CAST(0 AS BIGINT) AS cells_matched_total, CAST(0 AS BIGINT) AS largest_job_rows,
    CAST(0 AS DOUBLE) AS avg_llm_confidence, count(*) AS cache_hit_jobs FROM orders WHERE o_orderstatus = 'none'""",
)
def metrics_empty(spark, sf_dir):
    return run_metrics(runs_of_orders(spark, sf_dir).where("phase = 'phase none'"))


@query(
    "runs_after",
    f"""WITH {RUNS}, place AS (SELECT id, created_at FROM runs ORDER BY created_at DESC, id DESC LIMIT 1 OFFSET 59)
    SELECT id, status FROM runs WHERE (created_at, id) < (SELECT (created_at, id) FROM place)
    ORDER BY created_at DESC, id DESC LIMIT 20""",
)
def runs_after_place(spark, sf_dir):
    """The page after a run that was seen last; one page is the feature."""
    runs = runs_of_orders(spark, sf_dir)
    place = list_page(runs, page=3).orderBy("created_at", "id").first()
    return runs_after(runs, F.lit(place["created_at"]), F.lit(place["id"])).select("id", "status")


@query(
    "runs_list_page",
    f"""WITH {RUNS} SELECT id, status, epoch_us(created_at) AS created_us FROM runs
    ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40""",
)
def runs_list_page(spark, sf_dir):
    """Third page of the newest runs; one page is the feature."""
    page = list_page(runs_of_orders(spark, sf_dir), page=3)
    return page.select("id", "status", F.unix_micros("created_at").alias("created_us"))


# A transition per event; a user is a run, and some users have most of the events.
_STEP = f"""user_id AS id, {choose(list(STATES), 'event_id')} AS status,
    CAST(event_id % 101 AS INTEGER) AS progress, concat('phase ', event_type) AS phase"""


def steps_of_events(spark, sf_dir):
    return derive(table(spark, sf_dir, "events"), _STEP + ", ts AS at")


@query(
    "run_states",
    f"""WITH steps AS (SELECT {_STEP}, ts AS "at" FROM events) SELECT id, status, progress, phase FROM steps
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC, status DESC, progress DESC, phase DESC) = 1""",
)
def run_states(spark, sf_dir):
    """Latest state of every run from its transitions."""
    return current_state(steps_of_events(spark, sf_dir))


@query(
    "run_states_live",
    f"""WITH steps AS (SELECT {_STEP}, ts AS "at" FROM events), stored AS (SELECT * FROM steps
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC, status DESC, progress DESC, phase DESC) = 1),
    live AS (SELECT *, progress // 2 AS p, concat('live ', phase) AS f FROM steps WHERE id % 3 > 0
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC, progress // 2 DESC, concat('live ', phase) DESC) = 1)
    SELECT s.id, s.status,
      CASE WHEN s.status IN ('SUCCESS', 'FAILED', 'CANCELLED') THEN s.progress ELSE coalesce(p, s.progress) END AS progress,
      CASE WHEN s.status IN ('SUCCESS', 'FAILED', 'CANCELLED') THEN s.phase ELSE coalesce(f, s.phase) END AS phase
    FROM stored s LEFT JOIN live ON live.id = s.id""",
)
def run_states_live(spark, sf_dir):
    """Fresher progress counts for the runs that have not ended."""
    steps = steps_of_events(spark, sf_dir)
    live = steps.where("id % 3 > 0").selectExpr(
        "id", "at", "CAST(progress div 2 AS INTEGER) AS progress", "concat('live ', phase) AS phase"
    )
    return current_state(steps, live)


def moment(*day: int) -> datetime:
    return datetime(*day, tzinfo=timezone.utc)


@query(
    "run_states_folded",
    f"""WITH steps AS (SELECT {_STEP}, ts AS "at" FROM events) SELECT id, status, progress, phase FROM steps
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at" DESC, status DESC, progress DESC, phase DESC) = 1""",
)
def run_states_folded(spark, sf_dir):
    """Latest state of every run from a ledger folded twice while it grew, and its open buckets."""
    steps = steps_of_events(spark, sf_dir)
    newest = lambda rows: rows.groupBy("id").agg(F.max(F.struct("at", "status", "progress", "phase")).alias("s")).select("id", "s.*")
    files = LedgerFiles(scratch_path(spark, "ledger"), "id bigint, at timestamp, status string, progress int, phase string", newest)
    for start, end in ((1, 12), (12, 21), (21, 32)):
        days = steps.select("id", "at", "status", "progress", "phase").where(f"day(at) >= {start} AND day(at) < {end}")
        append_rows(days, files, F.col("at"))
        if end < 32:
            fold_ledger(spark, files, moment(2024, 1, end))
    return current_state(ledger_rows(spark, files))


def _folded_runs(spark, sf_dir) -> LedgerFiles:
    """The runs of the orders, appended by when they were created and folded up to 1998."""
    runs = runs_of_orders(spark, sf_dir)
    names = [f.split()[0] for f in LEDGER_SCHEMA.split(", ")]
    typed = dict(f.split() for f in LEDGER_SCHEMA.split(", "))
    whole = runs.select(*[(F.col(n) if n in runs.columns else F.lit(None)).cast(typed[n]).alias(n) for n in names])
    files = LedgerFiles(scratch_path(spark, "ledger"), hours=24 * 90)
    append_rows(whole, files, F.col("created_at"))
    for year in (1996, 1998):
        fold_ledger(spark, files, moment(year, 1, 1))
    return files


@query("runs_stale_folded", f"WITH {RUNS} SELECT id FROM runs WHERE {STALE}")
def runs_stale_folded(spark, sf_dir):
    """Stale runs, found in the snapshot of unfinished runs and the open buckets alone."""
    return stale_runs(unfinished_runs(spark, _folded_runs(spark, sf_dir)), now()).select("id")


@query("runs_ended_since", f"WITH {RUNS} SELECT id, status FROM runs WHERE created_at >= TIMESTAMP '1997-06-01'")
def runs_ended_since(spark, sf_dir):
    """Runs since a day: folds of runs that ended before are pruned."""
    day = F.lit("1997-06-01").cast("timestamp")
    rows = ledger_rows(spark, _folded_runs(spark, sf_dir), since=day)
    return latest_runs(rows).where(F.col("created_at") >= day).select("id", "status")


# ---------------------------------------------------------------- whole runs
def people_csv(spark, sf_dir):
    """Documents as CSV, one line each."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS ID",
        r"regexp_replace(text, '[\\r\\n\\\\]', ' ') AS Body",
        "source AS Source",
    )
    return delimited(spark, docs, ",", ".csv")


_BODY = r"nullif(regexp_replace(text, '[\r\n\\]', ' ', 'g'), '')"


@query(
    "whole_run",
    f"""SELECT 'SUCCESS' AS status, 100 AS progress, 'REPLACE' AS operation, 'ID,Body,Source' AS result_columns,
    count(*) AS total_rows, CAST(sum({found(f"coalesce({_BODY}, '')", EMAIL.pattern)}) AS BIGINT) AS matched_cells,
    false AS llm_cached, true AS self_test_passed FROM documents""",
)
def whole_run(spark, sf_dir):
    """Read, vet, rewrite, count and index one source; the ledger row."""
    request = RunRequest(people_csv(spark, sf_dir), ["body"], "find e-mail addresses", replacement_value="GONE")
    root = scratch_path(spark, "runs")
    row = run_request(
        spark, request, RuleSource(rule=known_rule("email")), results=f"{root}/results", ledger=f"{root}/ledger"
    )
    return row.select(
        "status", "progress", "operation", F.array_join("result_columns", ",").alias("result_columns"),
        "total_rows", "matched_cells", "llm_cached", "self_test_passed",
    )


@query(
    "whole_run_from_answer",
    f"""SELECT CAST(doc_id AS VARCHAR) AS "ID",
    regexp_replace({_BODY}, {text(EMAIL.mask[0])}, '\\1***\\2', 'g') AS "Body", source AS "Source",
    {found(f"coalesce({_BODY}, '')", EMAIL.mask[0])} AS matched FROM documents""",
)
def whole_run_from_answer(spark, sf_dir):
    """A run whose rule comes from a model's answer; its result, read back."""
    request = RunRequest(people_csv(spark, sf_dir), ["Body"], "Mask the e-mail  addresses", operation=MASK)
    asked = spark.createDataFrame([(MASK, request.natural_language)], "operation string, description string")
    answer = F.to_json(
        F.struct(
            F.lit(EMAIL.mask[0]).alias("pattern"),
            F.lit(EMAIL.mask[1]).alias("replacement_template"),
            F.lit(0.9).alias("confidence"),
        )
    )
    answers = keyed(asked, "batch", "m-1").select(
        "key", "operation", F.lit(1).alias("attempt"), answer.alias("answer")
    )
    memory = spark.createDataFrame([], MEMORY_SCHEMA)
    root = scratch_path(spark, "runs")
    row = run_request(
        spark,
        request,
        RuleSource(memory=memory, answers=answers, provider="batch", model="m-1"),
        results=f"{root}/results",
        ledger=f"{root}/ledger",
    ).first()
    return counter(spark.read.parquet(row["output_path"]))


@query(
    "run_result_page",
    r"""SELECT l_orderkey, l_linenumber, regexp_replace(l_returnflag, '[AN]', '-', 'g') AS l_returnflag, CAST(3 AS BIGINT) AS page, CAST(40 AS BIGINT) AS page_size,
    (SELECT count(*) FROM lineitem) AS total_rows, (SELECT count(*) FROM lineitem WHERE l_returnflag IN ('A', 'N')) AS matched_cells,
    (SELECT (count(*) + 39) // 40 FROM lineitem) AS total_pages, true AS has_next, true AS has_previous, CAST(80 AS BIGINT) AS row_offset
    FROM lineitem LIMIT 40 OFFSET 80""",
)
def run_result_page(spark, sf_dir):
    """Rows, counters and position of one page of a finished run, in one call; one page is the feature."""
    root = scratch_path(spark, "runs")
    request = RunRequest("lineitem.parquet", ["l_returnflag"], "hide the flags", replacement_value="-")
    run_request(spark, request, RuleSource(rule=TextRule("[AN]")), results=f"{root}/results", ledger=f"{root}/ledger", base=sf_dir)
    run = latest_runs(spark.read.parquet(f"{root}/ledger")).first()
    got = result_page(spark, run, 3, 40, ["l_orderkey", "l_linenumber", "l_returnflag"])
    told = {n: getattr(got, n) for n in ("page", "page_size", "total_rows", "matched_cells", "total_pages", "has_next", "has_previous", "row_offset")}
    return got.frame.withColumns({n: F.lit(v).cast("boolean" if isinstance(v, bool) else "bigint") for n, v in told.items()})


@query(
    "run_rule_recorded",
    """SELECT progress, phase, progress >= 24 AS has_rule, progress >= 78 AS has_totals, CASE WHEN progress >= 78 THEN
    (SELECT count(*) FROM orders) END AS total_rows FROM (VALUES (1, 'starting'), (24, 'transforming'), (78, 'indexing'), (100, 'done')) AS v(progress, phase)""",
)
def run_rule_recorded(spark, sf_dir):
    """The transitions of a run over the orders: the rule is known before the work, the totals before the index."""
    root = scratch_path(spark, "runs")
    request = RunRequest("orders.parquet", ["o_orderpriority"], "urgent orders", operation=VALIDATE)
    run_request(spark, request, RuleSource(rule=TextRule("^[12]-", VALIDATE)), results=f"{root}/results", ledger=f"{root}/ledger", base=sf_dir)
    rows = spark.read.parquet(f"{root}/ledger")
    return rows.select(
        "progress", "phase", F.col("regex_pattern").isNotNull().alias("has_rule"), F.col("total_rows").isNotNull().alias("has_totals"), "total_rows"
    )


# ---------------------------------------------------------------- streams
def stream_of(spark, sf_dir, name):
    """A table as a stream, be it one file or a folder of files: a stream takes a file only by a pattern."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{{{name}}}.parquet")


@query(
    "streamed_replace",
    f"""SELECT doc_id, regexp_replace(text, {text(EMAIL.pattern)}, 'REDACTED', 'g') AS text,
    {found('text', EMAIL.pattern)} AS matched FROM documents""",
)
def streamed_replace(spark, sf_dir):
    """The documents as a stream, written by micro-batches and read back."""
    root = scratch_path(spark, "stream")
    running = apply_rule_stream(
        stream_of(spark, sf_dir, "documents").select("doc_id", "text"),
        known_rule("email"),
        ["text"],
        "REDACTED",
        output=f"{root}/out",
        checkpoint=f"{root}/checkpoint",
    )
    running.awaitTermination()
    return counter(spark.read.parquet(f"{root}/out"))


@query(
    "streamed_mask",
    r"""SELECT page_id, regexp_replace(url, '(https?://[^/\s]+)/[^\s]*', '\1/***', 'g') AS url,
    CAST(regexp_matches(url, '(https?://[^/\s]+)/[^\s]*') AS INTEGER) AS matched FROM pages""",
)
def streamed_mask(spark, sf_dir):
    root = scratch_path(spark, "stream")
    running = apply_rule_stream(
        stream_of(spark, sf_dir, "pages").select("page_id", "url"),
        known_rule("url", MASK),
        ["url"],
        output=f"{root}/out",
        checkpoint=f"{root}/checkpoint",
    )
    running.awaitTermination()
    return counter(spark.read.parquet(f"{root}/out"))


@query(
    "streamed_totals",
    f"""SELECT count(*) AS all_rows, CAST(sum({found('text', EMAIL.pattern)}) AS BIGINT) AS all_matched, count(*) AS written_rows, 5 AS batches FROM documents""",
)
def streamed_totals(spark, sf_dir):
    """Running totals of the documents streamed in batches, the last of which is run twice."""
    root = scratch_path(spark, "stream")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.repartition(5, "doc_id").write.parquet(f"{root}/in")
    places = {"output": f"{root}/out", "running": f"{root}/running"}
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    apply_rule_batches(source, known_rule("email"), ["text"], "REDACTED", checkpoint=f"{root}/checkpoint", **places).awaitTermination()
    written = spark.read.parquet(places["output"])
    last = written.agg(F.max(BATCH)).first()[0]
    written.where(F.col(BATCH) == last).drop(BATCH).write.parquet(f"{root}/again")
    write_batch(spark.read.parquet(f"{root}/again"), last, **places)
    told = running_totals(spark, places["running"])
    counted = spark.read.parquet(places["output"]).agg(F.count(F.lit(1)).alias("written_rows"), F.count_distinct(BATCH).cast("int").alias("batches"))
    return counted.select(F.lit(told.rows).cast("bigint").alias("all_rows"), F.lit(told.matched).cast("bigint").alias("all_matched"), "written_rows", "batches")


@query(
    "second_run_is_remembered",
    """SELECT n AS run, n = 2 AS llm_cached, 'SUCCESS' AS status, (SELECT count(*) FROM documents) AS total_rows, 4 AS transitions
    FROM (VALUES (1), (2)) AS v(n)""",
)
def second_run_is_remembered(spark, sf_dir):
    """The same request twice: the first takes a rule from an answer, the second from memory."""
    root, source = scratch_path(spark, "runs"), people_csv(spark, sf_dir)
    asked = spark.createDataFrame([(MASK, "Mask the e-mail addresses")], "operation string, description string")
    answer = F.to_json(F.struct(F.lit(EMAIL.mask[0]).alias("pattern"), F.lit(EMAIL.mask[1]).alias("replacement_template")))
    answers = keyed(asked, "batch", "m-1").select("key", "operation", F.lit(1).alias("attempt"), answer.alias("answer"))
    rules = RuleSource(answers=answers, provider="batch", model="m-1", memory_path=f"{root}/memory")
    for n in (1, 2):
        request = RunRequest(source, ["Body"], " mask the  E-mail addresses ", operation=MASK, id=str(n))
        run_request(spark, request, rules, results=f"{root}/results", ledger=f"{root}/ledger")
        rules.answers = answers.limit(0)
    ledger = spark.read.parquet(f"{root}/ledger")
    steps = ledger.groupBy("id").agg(F.count("*").cast("int").alias("transitions"))
    return latest_runs(ledger).join(steps, "id").select(
        F.col("id").cast("int").alias("run"), "llm_cached", "status", "total_rows", "transitions"
    )


@query("run_page", None)
def run_page(spark, sf_dir):
    """First page of a finished run through its saved index.

    The order of a CSV file's lines is that of its writer, which SQL does not know.
    """
    request = RunRequest(people_csv(spark, sf_dir), ["Body"], "find e-mail addresses", replacement_value="GONE")
    root = scratch_path(spark, "runs")
    run_request(
        spark, request, RuleSource(rule=known_rule("email")), results=f"{root}/results", ledger=f"{root}/ledger"
    )
    return read_page(spark, open_index(spark, f"{root}/results/{request.id}.index"), 1, 50)
