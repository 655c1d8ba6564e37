"""Tables of requests: the gate before a run, and the payload for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.text import distinct_texts, extension_of
from rulewright.rule import OPERATIONS, REPLACE
from rulewright.sources.tables import EXTENSIONS

# Limits of a request.
KEY_LENGTH = 1024
SHEET_LENGTH = 255
WORDS_MIN = 3
WORDS_MAX = 2000
VALUE_LENGTH = 1024
TARGETS_MAX = 50
TARGET_LENGTH = 255
# Columns and samples that go into a payload.
PAYLOAD_COLUMNS = 20
PAYLOAD_SAMPLES = 5


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def gate_requests(requests: DataFrame) -> DataFrame:
    """Requests cleaned, with every reason against running them in ``problems``.

    Needs source_key, sheet_name, operation, natural_language, replacement_value
    and target_columns; ``accepted`` is true when there is no problem.
    """
    none = F.array().cast("array<string>")
    trimmed = F.transform(F.coalesce(F.col("target_columns"), none), _strip)
    cleaned = requests.withColumns(
        {
            "source_key": F.regexp_replace(_strip(F.col("source_key")), "^/+", ""),
            "sheet_name": _strip(F.col("sheet_name")),
            "operation": F.coalesce("operation", F.lit(REPLACE)),
            "natural_language": _strip(F.col("natural_language")),
            "replacement_value": _strip(F.col("replacement_value")),
            "__names": trimmed,
            "target_columns": distinct_texts(F.filter(trimmed, lambda t: t != "")),
        }
    )
    key, words = F.col("source_key"), F.col("natural_language")
    names, value = F.col("__names"), F.col("replacement_value")
    tests = {
        "source_key: may not be blank": key == "",
        f"source_key: longer than {KEY_LENGTH}": F.length(key) > KEY_LENGTH,
        "source_key: invalid key": key.contains(".."),
        "source_key: unsupported file type": (key != "") & ~extension_of(key).isin(*EXTENSIONS),
        f"sheet_name: longer than {SHEET_LENGTH}": F.length("sheet_name") > SHEET_LENGTH,
        "operation: not one of the four kinds": ~F.col("operation").isin(*OPERATIONS),
        f"natural_language: fewer than {WORDS_MIN} characters": F.length(words) < WORDS_MIN,
        f"natural_language: longer than {WORDS_MAX}": F.length(words) > WORDS_MAX,
        f"replacement_value: longer than {VALUE_LENGTH}": F.length(value) > VALUE_LENGTH,
        "replacement_value: required for REPLACE": (F.col("operation") == REPLACE) & (value == ""),
        "target_columns: none is named": F.size("target_columns") == 0,
        f"target_columns: more than {TARGETS_MAX}": F.size(names) > TARGETS_MAX,
        "target_columns: a name is blank": F.exists(names, lambda t: t == ""),
        f"target_columns: a name is longer than {TARGET_LENGTH}": F.exists(
            names, lambda t: F.length(t) > TARGET_LENGTH
        ),
    }
    problems = F.array_compact(F.array(*[F.when(test, F.lit(text)) for text, test in tests.items()]))
    judged = cleaned.withColumn("problems", problems).drop("__names")
    return judged.withColumn("accepted", F.size("problems") == 0)


def payloads(requests: DataFrame) -> DataFrame:
    """Requests with ``payload``, the JSON a batch model job needs.

    Needs operation, description, columns, samples and replacement_value.  The
    value goes in for REPLACE alone; absent parts are left out.
    """
    samples = F.slice("samples", 1, PAYLOAD_SAMPLES)
    value = F.when(F.col("operation") == REPLACE, F.nullif("replacement_value", F.lit("")))
    body = F.struct(
        F.col("operation"),
        F.col("description").alias("user_description"),
        F.slice("columns", 1, PAYLOAD_COLUMNS).alias("target_columns"),
        F.when(F.size(samples) > 0, samples).alias("sample_values_from_those_columns"),
        value.alias("literal_replacement_value"),
    )
    return requests.withColumn("payload", F.to_json(body))
