"""From requests in words to vetted rules: remembered ones first, then answers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions.answers import answer_reason, bare_json, parts, rule_fields
from rulewright.functions.text import squeeze
from rulewright.operators.lint import lint_rules

# Key format, days an entry is remembered, answers tried per request.
KEY_VERSION = "v3"
KEY_PREFIX = "llm:regex:"
KEEP_DAYS = 7
ATTEMPTS = 2

#: Fields of a remembered rule, in order.
RULE_FIELDS = (
    "pattern",
    "case_insensitive",
    "explanation",
    "confidence",
    "should_match",
    "should_not_match",
    "replacement_template",
    "group",
    "warnings",
    "self_test_passed",
)

MEMORY_SCHEMA = (
    "key string, rule struct<pattern:string,case_insensitive:boolean,explanation:string,confidence:double,"
    "should_match:array<string>,should_not_match:array<string>,replacement_template:string,group:int,"
    "warnings:array<string>,self_test_passed:boolean>, stored_at timestamp"
)


def open_memory(spark: SparkSession, path: str) -> DataFrame:
    """The remembered rules at a path; none where nothing has been remembered yet."""
    try:
        return spark.read.schema(MEMORY_SCHEMA).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MEMORY_SCHEMA)


def request_key(provider: Column, model: Column, operation: Column, description: Column) -> Column:
    """Key under which the rule for a description is remembered."""
    parts = F.concat_ws("|", F.lit(KEY_VERSION), provider, model, operation, squeeze(description))
    return F.concat(F.lit(KEY_PREFIX), F.sha2(parts, 256))


def keyed(requests: DataFrame, provider: str, model: str) -> DataFrame:
    """Requests (operation, description) with their ``key``."""
    key = request_key(F.lit(provider), F.lit(model), F.col("operation"), F.col("description"))
    return requests.withColumn("key", key)


def live_entries(memory: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """The newest entry of each key (key, rule, stored_at) that has not expired."""
    age = F.unix_micros(now) - F.unix_micros("stored_at")
    return _newest(memory.where(age <= days * 86_400_000_000))


def _newest(memory: DataFrame) -> DataFrame:
    """One entry per key: the newest, and of entries stored at one time the largest rule."""
    last = F.max(F.struct("stored_at", "rule")).alias("last")
    return memory.groupBy("key").agg(last).select("key", "last.rule", "last.stored_at")


def hits_of(requests: DataFrame, live: DataFrame) -> DataFrame:
    """Keyed requests answered from memory, with the remembered ``rule``."""
    return requests.where(~F.col("force_refresh")).join(live.select("key", "rule"), "key")


def keys_to_ask(requests: DataFrame, live: DataFrame) -> DataFrame:
    """Each operation and description still needing a model, once per key.

    Requests are folded per key before anything is joined, so a description that
    most requests share is one row from the first shuffle on.
    """
    folded = requests.groupBy("key").agg(
        F.min(F.struct("operation", "description")).alias("ask"),
        F.bool_or("force_refresh").alias("force_refresh"),
    )
    known = live.select("key", F.lit(True).alias("known"))
    open_keys = folded.join(known, "key", "left").where(F.col("force_refresh") | F.col("known").isNull())
    return open_keys.select("key", "ask.operation", "ask.description")


def parse_answers(answers: DataFrame) -> DataFrame:
    """Answers (answer) with the fields of a rule, or ``reason`` why there are none."""
    body, payload = F.col("__body"), F.col("__payload")
    opened = answers.withColumn("__body", bare_json(F.col("answer")))
    opened = opened.withColumn("__payload", F.try_parse_json(body))
    marked = opened.withColumn("reason", answer_reason(body, payload))
    whole = parts(F.when(F.col("reason").isNull(), payload))
    out = marked.withColumns(whole).withColumns(rule_fields())
    return out.drop("__body", "__payload", *whole)


def judge_answers(answers: DataFrame, strict: bool = False) -> DataFrame:
    """One verdict per key from its answers (key, operation, attempt, answer).

    status is ACCEPTED with the rule of the first good attempt, UNREADABLE when an
    answer could not be read (no repair is tried), REJECTED when vetting refused
    the last attempt allowed, or REPAIR when another answer may be given; reason
    says what was wrong.  An answer without an attempt number cannot be placed: it
    counts as an unreadable first one.  Of several answers with one number the
    smallest rule and reason count, in any order of the rows.
    """
    placed = F.coalesce("attempt", F.lit(1))
    parsed = parse_answers(answers.withColumn("__lost", F.col("attempt").isNull()).withColumn("attempt", placed).where(placed <= ATTEMPTS))
    unreadable = F.when(F.col("__lost"), "the answer has no attempt number").otherwise(F.col("reason"))
    parsed = parsed.withColumn("__unreadable", unreadable).drop("reason", "__lost")
    vetted = lint_rules(parsed, strict=strict)
    good = F.col("__unreadable").isNull() & F.col("accepted")
    rule = F.struct(*[F.col(f) for f in RULE_FIELDS])
    lined = vetted.select(
        "key",
        "attempt",
        F.when(good, rule).alias("rule"),
        F.coalesce("__unreadable", "reason").alias("reason"),
        F.col("__unreadable").isNotNull().alias("unreadable"),
    )
    stop = F.col("rule").isNotNull() | F.col("unreadable")
    told = F.struct((-F.col("attempt")).alias("late"), "reason")
    folded = lined.groupBy("key").agg(
        F.min(F.when(F.col("rule").isNotNull(), F.struct("attempt", "rule"))).alias("good"),
        F.min(F.when(F.col("unreadable"), F.struct("attempt", "reason"))).alias("broken"),
        F.min(told).alias("last"),
        F.max("attempt").alias("attempts"),
        F.min(F.when(stop, F.col("attempt"))).alias("stopped_at"),
    ).select(
        "key", "attempts", "stopped_at", F.col("good.rule").alias("rule"), F.col("good.attempt").alias("good_at"),
        F.col("broken.attempt").alias("broken_at"), F.col("broken.reason").alias("broken_reason"),
        F.col("last.reason").alias("last_reason"),
    )
    accepted = F.col("good_at").isNotNull() & (F.col("good_at") == F.col("stopped_at"))
    broken = F.col("broken_at").isNotNull() & (F.col("broken_at") == F.col("stopped_at"))
    status = (
        F.when(accepted, "ACCEPTED")
        .when(broken, "UNREADABLE")
        .when(F.col("attempts") >= ATTEMPTS, "REJECTED")
        .otherwise("REPAIR")
    )
    return folded.select(
        "key",
        status.alias("status"),
        F.when(accepted, F.col("rule")).alias("rule"),
        F.when(accepted, F.lit(None).cast("string"))
        .when(broken, F.col("broken_reason"))
        .otherwise(F.col("last_reason"))
        .alias("reason"),
        F.coalesce("stopped_at", "attempts").alias("attempts"),
    )


def repairs_to_ask(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What to ask again (key, operation, description), with the reason as ``hint``."""
    again = verdicts.where("status = 'REPAIR'").select("key", F.col("reason").alias("hint"))
    return asked.select("key", "operation", "description").join(again, "key")


def resolve(requests: DataFrame, live: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every keyed request with its outcome.

    Adds status (HIT, ACCEPTED, UNREADABLE, REJECTED, REPAIR, or ASK when no
    answer has come in), rule, reason, attempts and was_cached.  Memory and
    verdicts are folded into one row per key, so requests are joined once.
    """
    remembered = live.select("key", F.col("rule").alias("kept"))
    known = remembered.join(verdicts, "key", "full_outer")
    # Adaptive execution splits a key that most requests share.
    joined = requests.join(known, "key", "left")
    hit = ~F.col("force_refresh") & F.col("kept").isNotNull()
    return joined.select(
        *[F.col(c) for c in requests.columns],
        F.when(hit, "HIT").otherwise(F.coalesce("status", F.lit("ASK"))).alias("status"),
        F.when(hit, F.col("kept")).otherwise(F.col("rule")).alias("rule"),
        F.when(~hit, F.col("reason")).alias("reason"),
        F.when(hit, F.lit(0)).otherwise(F.coalesce("attempts", F.lit(0))).alias("attempts"),
        hit.alias("was_cached"),
    )


def remember(memory: DataFrame, verdicts: DataFrame, now: Column) -> DataFrame:
    """Memory with the accepted rules added; a newer entry replaces an older one."""
    new = verdicts.where("status = 'ACCEPTED'").select("key", "rule", now.alias("stored_at"))
    return _newest(memory.select("key", "rule", "stored_at").unionByName(new))


def reuse_stats(resolved: DataFrame) -> DataFrame:
    """One row: cache_hits, cache_misses, provider_calls, hit_rate_percent.

    A key is asked once however many requests share it, so its attempts are its calls.
    """
    per_key = resolved.groupBy("key").agg(
        F.count_if("was_cached").alias("hits"), F.count(F.lit(1)).alias("n"), F.max("attempts").alias("calls")
    )
    hits, rows = F.coalesce(F.sum("hits"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    return per_key.agg(
        hits.alias("cache_hits"),
        (rows - hits).alias("cache_misses"),
        F.coalesce(F.sum("calls").cast("bigint"), F.lit(0)).alias("provider_calls"),
        F.when(rows > 0, F.bround(100.0 * hits / rows, 1)).otherwise(F.lit(0.0)).alias("hit_rate_percent"),
    )
