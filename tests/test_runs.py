from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rulewright import MASK, RuleSource, RunRequest, TextRule, apply_rule_stream, known_rule, read_page, run_request
from rulewright.errors import RuleError
from rulewright.operators.resolve import open_memory
from rulewright.plans.run import result_page
from rulewright.operators.ledger import (
    LEDGER_SCHEMA,
    current_state,
    fail_stale,
    full_view,
    latest_runs,
    list_page,
    run_metrics,
    stale_runs,
    status_counts,
    summary_view,
    with_status,
)
from rulewright.operators.resolve import judge_answers, keyed
from rulewright.plans.run import ask
from rulewright.session import scratch_path, scratch_root
from rulewright.operators.ledger_files import LedgerFiles, append_rows, fold_ledger, last_fold, ledger_rows, unfinished_runs
from rulewright.streaming.rules import BATCH, apply_rule_batches, batch_totals, running_totals, stream_totals, write_batch
from rulewright.sources.tables import read_table
from tests.test_resolve import ANSWERS, MEMORY, rule
from workload.runs import streamed_mask, streamed_replace



def now():
    return F.lit("2024-01-01 12:00:00").cast("timestamp")


def ledger(spark, *rows):
    names = [f.split()[0] for f in LEDGER_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**dict.fromkeys(names), **r}.values()) for r in rows], LEDGER_SCHEMA)


def at(hour, minute=0, second=0, micro=0):
    return dt.datetime(2024, 1, 1, hour, minute, second, micro, tzinfo=dt.timezone.utc)


def test_status_counts_and_metrics(spark):
    runs = ledger(
        spark,
        {"status": "SUCCESS", "total_rows": 10, "matched_cells": 3, "llm_confidence": 0.5, "llm_cached": True},
        {"status": "SUCCESS", "total_rows": 30, "matched_cells": 4, "llm_confidence": 0.8, "llm_cached": False},
        {"status": "FAILED", "total_rows": 99, "llm_cached": True},
    )
    assert {r["status"]: r["runs"] for r in status_counts(runs).collect()} == {
        "QUEUED": 0, "RUNNING": 0, "SUCCESS": 2, "FAILED": 1, "CANCELLED": 0,
    }
    assert tuple(run_metrics(runs).first()) == (3, 40, 7, 30, 0.65, 2)
    assert tuple(run_metrics(runs.limit(0)).first()) == (0, 0, 0, 0, 0.0, 0)
    assert with_status(runs, "failed").count() == 1


def test_stale_runs(spark):
    runs = ledger(
        spark,
        {"id": "old", "status": "RUNNING", "started_at": at(3)},
        {"id": "edge", "status": "RUNNING", "started_at": at(6)},
        {"id": "done", "status": "SUCCESS", "started_at": at(1)},
        {"id": "waiting", "status": "RUNNING"},
    )
    assert [r["id"] for r in stale_runs(runs, now()).collect()] == ["old"]
    swept = {r["id"]: r for r in fail_stale(runs, now()).collect()}
    assert [swept[i]["status"] for i in ("old", "edge", "done", "waiting")] == ["FAILED", "RUNNING", "SUCCESS", "RUNNING"]
    assert swept["old"]["error_type"] == "StaleJob" and swept["old"]["finished_at"] is not None
    assert swept["edge"]["error_type"] is None


def test_views(spark):
    runs = ledger(
        spark,
        {"id": "a", "created_at": at(10), "started_at": at(10, 0, 1, 500000), "finished_at": at(10, 1), "regex_pattern": "p", "extract_group": 2},
        {"id": "b", "created_at": at(11), "started_at": at(11)},
        {"id": "c", "created_at": at(9)},
        {"id": "d", "created_at": at(8), "started_at": at(8, 0, 0, 125000), "finished_at": at(8, 0, 0, 500000)},
    )
    rows = {r["id"]: r for r in full_view(runs, now()).collect()}
    assert rows["a"]["duration_seconds"] == 58.5 and rows["a"]["queue_wait_seconds"] == 1.5
    assert rows["b"]["duration_seconds"] == 3600.0 and rows["c"]["duration_seconds"] is None
    assert (rows["d"]["queue_wait_seconds"], rows["d"]["duration_seconds"]) == (0.12, 0.38)
    assert rows["a"]["regex"]["pattern"] == "p" and rows["a"]["regex"]["group"] == 2
    assert len(full_view(runs, now()).columns) == 23 and len(summary_view(runs, now()).columns) == 10
    assert [r["id"] for r in list_page(runs).collect()] == ["b", "a", "c", "d"]
    assert [r["id"] for r in list_page(runs, page=2, size=2).collect()] == ["c", "d"]
    assert list_page(runs, page=0, size=0).count() == 4


def test_current_state(spark):
    steps = spark.createDataFrame(
        [("a", at(1), "QUEUED", 0, "queued"), ("a", at(2), "RUNNING", 1, "starting"), ("b", at(1), "RUNNING", 1, "starting"),
         ("b", at(3), "SUCCESS", 100, "done"), ("c", at(1), "RUNNING", 7, "x")],
        "id string, at timestamp, status string, progress int, phase string",
    )
    live = spark.createDataFrame(
        [("a", at(2), 40, "writing"), ("a", at(3), 60, "counting"), ("b", at(2), 50, "writing")],
        "id string, at timestamp, progress int, phase string",
    )
    got = {r["id"]: tuple(r)[1:] for r in current_state(steps, live).collect()}
    assert got == {"a": ("RUNNING", 60, "counting"), "b": ("SUCCESS", 100, "done"), "c": ("RUNNING", 7, "x")}
    assert {r["id"]: r["progress"] for r in current_state(steps).collect()} == {"a": 1, "b": 100, "c": 7}


@pytest.fixture
def places(spark):
    root = scratch_path(spark, "runs")
    return {"results": f"{root}/results", "ledger": f"{root}/ledger"}


def test_run_with_a_given_rule(spark, people_csv, places):
    request = RunRequest(people_csv, ["email"], "find e-mail", replacement_value="GONE")
    row = run_request(spark, request, RuleSource(rule=known_rule("email")), **places).first()
    assert (row["status"], row["total_rows"], row["matched_cells"]) == ("SUCCESS", 5, 3)
    assert row["result_columns"] == ["ID", "Name", "Email", "Notes"] and row["self_test_passed"] is True
    assert row["finished_at"] >= row["started_at"]
    page = read_page(spark, spark.read.parquet(row["index_path"]), 1, 3)
    assert [r["Email"] for r in page.collect()] == ["GONE", "GONE", "GONE"]
    steps = spark.read.parquet(places["ledger"]).orderBy("progress").collect()
    assert [(r["status"], r["progress"]) for r in steps] == [("RUNNING", 1), ("RUNNING", 24), ("RUNNING", 78), ("SUCCESS", 100)]
    assert [r["regex_pattern"] is not None for r in steps] == [False, True, True, True]


def test_a_run_uses_the_cleaned_request(spark, people_csv, places):
    request = RunRequest(f" {people_csv} ", [" email ", "EMAIL"], "  find e-mail ", replacement_value=" GONE ")
    row = run_request(spark, request, RuleSource(rule=known_rule("email")), **places).first()
    assert (row["source_key"], row["natural_language"], row["replacement_value"]) == (people_csv, "find e-mail", "GONE")
    assert spark.read.parquet(row["output_path"]).where("ID = '1'").first()["Email"] == "GONE"


def test_any_error_ends_the_run(spark, people_csv, places, monkeypatch):
    monkeypatch.setattr("rulewright.plans.run.write_counted", lambda *_: 1 / 0)
    request = RunRequest(people_csv, ["Email"], "find e-mail", replacement_value="x")
    with pytest.raises(ZeroDivisionError):
        run_request(spark, request, RuleSource(rule=known_rule("email")), **places)
    rows = spark.read.parquet(places["ledger"])
    assert latest_runs(rows).first()["error_type"] == "ZeroDivisionError" and rows.where("status = 'RUNNING'").count() == 2
    # What it was about to do is known.
    assert latest_runs(rows.where("status = 'RUNNING'")).first()["regex_pattern"] == known_rule("email").pattern


@pytest.mark.parametrize("change, word", [
    ({"target_columns": ["Emial"]}, "in the table, which has"),
    ({"source_key": "/x/y.txt"}, "unsupported file type"),
    ({"replacement_value": ""}, "required for REPLACE"),
])
def test_a_bad_request_is_recorded(spark, people_csv, places, change, word):
    base = {"source_key": people_csv, "target_columns": ["Email"], "natural_language": "find it", "replacement_value": "x"}
    row = run_request(spark, RunRequest(**{**base, **change}), RuleSource(rule=TextRule("a")), **places).first()
    assert row["status"] == "FAILED" and word in row["error_message"] and row["error_type"] == "RuleError"
    assert latest_runs(spark.read.parquet(places["ledger"])).first()["status"] == "FAILED"


def test_an_unsafe_rule_is_refused_before_the_data_is_read(spark, people_csv, places):
    request = RunRequest(people_csv, ["Email"], "find it", replacement_value="x")
    row = run_request(spark, request, RuleSource(rule=TextRule("(a+)+")), **places).first()
    assert "runaway" in row["error_message"] and row["output_path"] is None


def test_a_missing_source_is_recorded_and_raised(spark, places):
    request = RunRequest("/nowhere/at/all.csv", ["Email"], "find it", replacement_value="x")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        run_request(spark, request, RuleSource(rule=TextRule("a")), **places)
    assert latest_runs(spark.read.parquet(places["ledger"])).first()["error_type"] == "AnalysisException"


def test_run_from_an_answer_then_from_memory(spark, people_csv, places):
    request = RunRequest(people_csv, ["Email"], "hide the names", operation=MASK)
    source = RuleSource(provider="p", model="m")
    asked = ask(spark, request, read_table(spark, people_csv), source)
    row = asked.first()
    assert '"operation":"MASK"' in row["payload"] and "ada.abel@example.org" in row["payload"]
    answer = '{"pattern": "^[^@]+(@.*)$", "replacement_template": "***$1", "confidence": 0.8}'
    source.answers = spark.createDataFrame([(row["key"], MASK, 1, answer)], ANSWERS)
    source.memory = spark.createDataFrame([], MEMORY)
    first = run_request(spark, request, source, **places).first()
    assert (first["matched_cells"], first["llm_cached"], first["llm_confidence"]) == (3, False, 0.8)
    masked = spark.read.parquet(first["output_path"]).where("ID = '1'").first()["Email"]
    assert masked == "***@example.org"

    known = judge_answers(source.answers).select("key", "rule", F.current_timestamp().alias("stored_at"))
    again = RunRequest(people_csv, ["Notes"], " Hide the  NAMES", operation=MASK)
    source.memory, source.answers = known, source.answers.limit(0)
    second = run_request(spark, again, source, **places).first()
    assert second["llm_cached"] and second["regex_pattern"] == first["regex_pattern"]

    other = RunRequest(people_csv, ["Notes"], "something else", operation=MASK)
    third = run_request(spark, other, source, **places).first()
    assert third["status"] == "FAILED" and "no answer" in third["error_message"]
    assert latest_runs(spark.read.parquet(places["ledger"])).count() == 3


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(i, f"u{i}@example.org" if i % 2 else "none") for i in range(20)], "id int, t string").repartition(
        4
    ).write.parquet(source)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        stream = spark.readStream.schema("id int, t string").option("maxFilesPerTrigger", 1).parquet(source)
        query = apply_rule_stream(stream, known_rule("email"), ["t"], "x", output=out, checkpoint=checkpoint)
        query.awaitTermination()
        return batch_totals(query)

    counts = run()
    assert len(counts) >= 2 and sum(c.rows for c in counts) == 20 and sum(c.matched for c in counts) == 10
    assert spark.read.parquet(out).where("t = 'x'").count() == 10
    spark.createDataFrame([(99, "z@example.org")], "id int, t string").write.mode("append").parquet(source)
    assert sum(c.rows for c in run()) == 1
    whole = stream_totals(spark, out)
    assert (whole.rows, whole.matched) == (21, 11)


def test_a_folder_of_files_is_streamed_and_masked(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://h{i}.example/a/{i}" if i % 2 else None) for i in range(8)], "page_id long, url string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    pages.write.parquet(str(tmp_path / "other-pages.parquet"))
    got = sorted(tuple(r) for r in streamed_mask(spark, str(tmp_path)).select("page_id", "url", "matched").collect())
    assert got == [(i, f"https://h{i}.example/***" if i % 2 else None, i % 2) for i in range(8)]


def test_a_folder_of_files_is_streamed_and_replaced(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"to u{i}@example.org" if i % 2 else None) for i in range(8)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in streamed_replace(spark, str(tmp_path)).select("doc_id", "text", "matched").collect())
    assert got == [(i, "to REDACTED" if i % 2 else None, i % 2) for i in range(8)]


def test_a_replayed_batch_counts_once(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), tmp_path / "checkpoint"
    places = {"output": str(tmp_path / "out"), "running": str(tmp_path / "running")}
    rows = spark.createDataFrame([(i, f"u{i}@example.org" if i % 2 else "none") for i in range(20)], "id int, t string")
    rows.repartition(4).write.parquet(source)

    def run():
        stream = spark.readStream.schema("id int, t string").option("maxFilesPerTrigger", 1).parquet(source)
        apply_rule_batches(stream, known_rule("email"), ["t"], "x", checkpoint=str(checkpoint), **places).awaitTermination()
        told, out = running_totals(spark, places["running"]), spark.read.parquet(places["output"])
        return (told.rows, told.matched), (out.count(), out.where("t = 'x'").count()), out.select(BATCH).distinct().count()

    first = run()
    assert first == ((20, 10), (20, 10), 4)
    # The last batch is not known to be done, so Spark runs it again.
    for name in ("3", ".3.crc"):
        (checkpoint / "commits" / name).unlink(missing_ok=True)
    assert run() == first
    rows.limit(1).write.mode("append").parquet(source)
    assert run()[0][0] == 21
    none = str(tmp_path / "none")
    assert running_totals(spark, none).rows == 0
    with pytest.raises(RuntimeError, match="another checkpoint"):
        write_batch(rows.withColumn("__matched", F.lit(0)), 4, output=str(tmp_path / "other"), running=none)


def step(run_id, status, day, progress=0):
    return {"id": run_id, "status": status, "progress": progress, "started_at": at(day), "finished_at": at(day) if status == "SUCCESS" else None}


def test_a_folded_ledger_tells_what_its_rows_tell(spark, tmp_path):
    files = LedgerFiles(str(tmp_path / "ledger"), hours=1)
    assert ledger_rows(spark, files).count() == 0 and unfinished_runs(spark, files).count() == 0 and last_fold(spark, files) is None
    rows = [
        step("a", "RUNNING", 1), step("a", "SUCCESS", 2), step("b", "RUNNING", 1), step("c", "RUNNING", 3), step("b", "RUNNING", 4, 50),
        step("c", "SUCCESS", 5), step("d", "RUNNING", 5), step("a", "RUNNING", 1),
    ]
    whole = ledger(spark, *rows)
    expected = sorted(map(str, latest_runs(whole).collect()))
    running = sorted(r["id"] for r in latest_runs(whole).where("status = 'RUNNING'").collect())
    assert running == ["b", "d"]

    def told():
        return sorted(map(str, latest_runs(ledger_rows(spark, files)).collect())), sorted(r["id"] for r in unfinished_runs(spark, files).collect())

    append_rows(whole, files, F.coalesce("finished_at", "started_at"))
    assert told() == (expected, running)
    assert fold_ledger(spark, files, at(3)) and told() == (expected, running)
    assert not fold_ledger(spark, files, at(3)) and not fold_ledger(spark, files, at(2))
    # A fold that died left files and no record: they are not read, and it can be run again.
    done = last_fold(spark, files)
    whole.limit(1).write.parquet(files.folded(f"ended/fold={done + 2}"))
    assert told() == (expected, running)
    assert fold_ledger(spark, files, at(5)) and last_fold(spark, files) == done + 2 and told() == (expected, running)
    ended = spark.read.schema(files.schema + ", fold int").parquet(files.folded("ended"))
    assert sorted((r["id"], r["fold"] - done) for r in ended.collect()) == [("a", 0)]
    assert fold_ledger(spark, files, at(23)) and told() == (expected, running)
    assert sorted(r["id"] for r in ended.collect()) == ["a"] and spark.read.parquet(files.folded("unfinished/fold=" + str(last_fold(spark, files)))).count() == 2
    assert {r["id"] for r in ledger_rows(spark, files, since=F.lit(at(5))).collect()} == {"b", "c", "d"}
    plan = ledger_rows(spark, files, since=F.lit(at(5)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan and "isnotnull(bucket" in plan


def test_scratch_folder_is_the_session_s(spark):
    assert scratch_path(spark, "x").startswith(scratch_root(spark))
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert judge_answers is not None and keyed is not None and rule("a")[0] == "a"


def test_a_page_with_all_around_it(spark, people_csv, places):
    request = RunRequest(people_csv, ["Email", "Notes"], "find e-mail", operation="EXTRACT")
    run_request(spark, request, RuleSource(rule=known_rule("email", "EXTRACT")), **places)
    run = latest_runs(spark.read.parquet(places["ledger"])).first()
    got = result_page(spark, run, 2, 2)
    assert [r["ID"] for r in got.frame.collect()] == ["3", "4"]
    assert got.columns == ["ID", "Name", "Email", "Notes", "Email_extracted", "Notes_extracted"]
    assert got.added_columns == ["Email_extracted", "Notes_extracted"]
    assert (got.total_rows, got.matched_cells, got.total_pages, got.has_next, got.has_previous, got.row_offset) == (5, 4, 3, True, True, 2)
    assert result_page(spark, run).page_size == 50 and result_page(spark, run, -1, 9999).page_size == 500
    past = result_page(spark, run, 9, 2)
    assert past.frame.count() == 0 and not past.has_next
    failed = run_request(spark, RunRequest(people_csv, ["Emial"], "find it", replacement_value="x"), RuleSource(rule=TextRule("a")), **places)
    with pytest.raises(RuleError, match="FAILED"):
        result_page(spark, failed.first())


def test_memory_may_start_empty(spark, tmp_path):
    assert open_memory(spark, str(tmp_path / "none")).count() == 0
    assert open_memory(spark, str(tmp_path / "none")).columns == ["key", "rule", "stored_at"]
