from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rulewright.functions.text import squeeze
from rulewright.operators.resolve import (
    RULE_FIELDS,
    judge_answers,
    keyed,
    hits_of,
    keys_to_ask,
    live_entries,
    parse_answers,
    remember,
    resolve,
    reuse_stats,
)

ANSWERS = "key string, operation string, attempt int, answer string"
REQUESTS = "request_id string, operation string, description string, force_refresh boolean"
MEMORY = (
    "key string, rule struct<pattern:string,case_insensitive:boolean,explanation:string,confidence:double,"
    "should_match:array<string>,should_not_match:array<string>,replacement_template:string,group:int,"
    "warnings:array<string>,self_test_passed:boolean>, stored_at timestamp"
)


def now():
    return F.lit("2024-01-10").cast("timestamp")


def parsed(spark, answer):
    return parse_answers(spark.createDataFrame([("k", "REPLACE", 1, answer)], ANSWERS)).first()


@pytest.mark.parametrize("answer, word", [
    ("", "empty"), (None, "empty"), ("  \n ", "empty"), ("I think /foo/", "not JSON"), ("[1]", "not a JSON object"),
    ('"x"', "not a JSON object"), ("{}", "no pattern"), ('{"pattern": " "}', "no pattern"), ('{"pattern": null}', "no pattern"),
    ('{"pattern": "a"', "not JSON"),
])
def test_bad_answers(spark, answer, word):
    assert word in parsed(spark, answer)["reason"]


@pytest.mark.parametrize("answer", ['{"pattern": "a"}', '```json\n{"pattern": "a"}\n```', '```\n{"pattern": "a"}```', ' \n{"pattern": " a "} '])
def test_good_answers(spark, answer):
    row = parsed(spark, answer)
    assert row["reason"] is None and row["pattern"] == "a"


@pytest.mark.parametrize("field, given, got", [
    ("confidence", 0.5, 0.5), ("confidence", "0.25", 0.25), ("confidence", 7, 1.0), ("confidence", -1, 0.0),
    ("confidence", "high", 0.0), ("confidence", None, 0.0), ("confidence", True, 1.0), ("confidence", [1], 0.0),
    ("group", 2, 2), ("group", "3", 3), ("group", 1.9, 1), ("group", "1.9", 0), ("group", None, 0), ("group", {}, 0),
    ("case_insensitive", True, True), ("case_insensitive", 0, False), ("case_insensitive", "no", True),
    ("case_insensitive", "", False), ("case_insensitive", None, False), ("case_insensitive", [], False),
    ("explanation", " why ", "why"), ("explanation", None, ""), ("explanation", 5, "5"),
    ("replacement_template", "$1*", "$1*"), ("replacement_template", None, ""),
    ("should_match", ["a", 1, 2.5, True, None, ["x"], {"y": 1}], ["a", "1", "2.5", "True"]),
    ("should_match", [str(i) for i in range(12)], [str(i) for i in range(8)]),
    ("should_not_match", "abc", []),
])
def test_fields_are_tamed(spark, field, given, got):
    assert parsed(spark, json.dumps({"pattern": "a", field: given}))[field] == got


def test_judging(spark):
    good, bad = '{"pattern": "a"}', '{"pattern": "(a+)+"}'
    rows = [
        ("one", 1, good), ("two", 1, bad), ("two", 2, good), ("wait", 1, bad), ("never", 1, bad), ("never", 2, '{"pattern": "["}'),
        ("junk", 1, "hm"), ("junk", 2, good), ("late", 1, bad), ("late", 2, "hm"), ("third", 1, bad), ("third", 2, bad), ("third", 3, good),
    ]
    df = spark.createDataFrame([(k, "REPLACE", n, a) for k, n, a in rows], ANSWERS)
    got = {r["key"]: (r["status"], r["rule"] is not None, r["attempts"]) for r in judge_answers(df).collect()}
    assert got == {
        "one": ("ACCEPTED", True, 1), "two": ("ACCEPTED", True, 2), "wait": ("REPAIR", False, 1), "never": ("REJECTED", False, 2),
        "junk": ("UNREADABLE", False, 1), "late": ("UNREADABLE", False, 2), "third": ("REJECTED", False, 2),
    }
    reasons = {r["key"]: r["reason"] for r in judge_answers(df).collect()}
    assert reasons["never"] == "does-not-compile" and "nested" in reasons["wait"] and reasons["two"] is None


def rule(pattern):
    return (pattern, False, "", 0.5, [], [], "", 0, [], None)


def test_keys_fold_case_and_blanks_only(spark):
    df = spark.createDataFrame(
        [("1", "REPLACE", "Find  X", False), ("2", "REPLACE", " find\tx ", False), ("3", "MASK", "find x", False)], REQUESTS
    )
    keys = [r["key"] for r in keyed(df, "p", "m").orderBy("request_id").collect()]
    assert keys[0] == keys[1] != keys[2] and keys[0].startswith("llm:regex:") and len(keys[0]) == 74
    assert [r["key"] for r in keyed(df, "p", "other").orderBy("request_id").collect()][0] != keys[0]
    assert spark.range(1).select(squeeze(F.lit(" A  b\n"))).first()[0] == "a b"


@pytest.fixture
def scene(spark):
    requests = keyed(
        spark.createDataFrame(
            [("1", "REPLACE", "known", False), ("2", "REPLACE", "known", True), ("3", "REPLACE", "old", False), ("4", "REPLACE", "new", False)],
            REQUESTS,
        ),
        "p",
        "m",
    )
    keys = {r["description"]: r["key"] for r in requests.collect()}
    day = lambda n: __import__("datetime").datetime(2024, 1, n)
    memory = spark.createDataFrame(
        [(keys["known"], rule("k1"), day(4)), (keys["known"], rule("k2"), day(5)), (keys["old"], rule("o"), day(1))], MEMORY
    )
    return requests, keys, memory


def test_resolution(spark, scene):
    requests, keys, memory = scene
    live = live_entries(memory, now())
    assert {r["key"] for r in live.collect()} == {keys["known"]}
    asked = {r["key"]: r["description"] for r in keys_to_ask(requests, live).collect()}
    assert asked == {keys["known"]: "known", keys["old"]: "old", keys["new"]: "new"}
    answers = spark.createDataFrame([(keys["old"], "REPLACE", 1, '{"pattern": "o2"}')], ANSWERS)
    verdicts = judge_answers(answers)
    done = {r["request_id"]: r for r in resolve(requests, live, verdicts).collect()}
    assert [done[i]["status"] for i in "1234"] == ["HIT", "ASK", "ACCEPTED", "ASK"]
    assert done["1"]["rule"]["pattern"] == "k2" and done["3"]["rule"]["pattern"] == "o2"
    assert tuple(reuse_stats(resolve(requests, live, verdicts)).first()) == (1, 3, 1, 25.0)
    kept = {r["key"]: r["rule"]["pattern"] for r in remember(memory, verdicts, now()).collect()}
    assert kept == {keys["known"]: "k2", keys["old"]: "o2"}


def test_expiry_is_exact(spark):
    memory = spark.createDataFrame([], MEMORY).unionByName(
        spark.sql("SELECT 'a' AS key, timestamp'2024-01-03' AS stored_at UNION SELECT 'b', timestamp'2024-01-02 23:59:59.999999'")
        .selectExpr("key", "stored_at")
        .withColumn("rule", F.lit(None).cast(spark.createDataFrame([], MEMORY).schema["rule"].dataType)),
    )
    assert [r["key"] for r in live_entries(memory, now()).collect()] == ["a"]


def test_no_requests_no_rate(spark):
    empty = spark.createDataFrame([], "key string, was_cached boolean, attempts int")
    assert tuple(reuse_stats(empty).first()) == (0, 0, 0, 0.0)
    assert len(RULE_FIELDS) == 10


def test_ties_do_not_depend_on_row_order(spark, scene):
    _, keys, _ = scene
    stored = __import__("datetime").datetime(2024, 1, 5)
    rows = [(keys["known"], rule(p), stored) for p in ("b", "c", "a")]
    told = [(keys["old"], "REPLACE", 1, f'{{"pattern": "{p}"}}') for p in ("y", "x", "z")]
    for turn in range(3):
        memory = spark.createDataFrame(rows[turn:] + rows[:turn], MEMORY)
        answers = spark.createDataFrame(told[turn:] + told[:turn], ANSWERS)
        assert live_entries(memory, now()).first()["rule"]["pattern"] == "c"
        assert judge_answers(answers).first()["rule"]["pattern"] == "x"
        kept = remember(memory, judge_answers(answers), now())
        assert {r["rule"]["pattern"] for r in kept.collect()} == {"c", "x"}


def test_an_answer_without_a_number_is_unreadable(spark, scene):
    _, keys, _ = scene
    answers = spark.createDataFrame([(keys["old"], "REPLACE", None, '{"pattern": "x"}')], ANSWERS)
    got = judge_answers(answers).first()
    assert (got["status"], got["attempts"]) == ("UNREADABLE", 1) and "attempt number" in got["reason"]


def test_a_key_that_many_requests_share_is_one_call(spark):
    many = keyed(spark.range(1000).selectExpr("CAST(id AS STRING) AS request_id", "'REPLACE' AS operation", "'same' AS description", "false AS force_refresh"), "p", "m")
    answers = spark.createDataFrame([(many.first()["key"], "REPLACE", 1, '{"pattern": "x"}')], ANSWERS)
    got = reuse_stats(resolve(many, spark.createDataFrame([], MEMORY), judge_answers(answers))).first()
    assert tuple(got) == (0, 1000, 1, 0.0)


def test_each_table_is_read_once(spark, scene, tmp_path):
    requests, _, memory = scene
    requests.write.parquet(f"{tmp_path}/requests")
    memory.write.parquet(f"{tmp_path}/memory")
    asked, live = spark.read.parquet(f"{tmp_path}/requests"), live_entries(spark.read.parquet(f"{tmp_path}/memory"), now())
    for frame in (keys_to_ask(asked, live), hits_of(asked, live)):
        assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
