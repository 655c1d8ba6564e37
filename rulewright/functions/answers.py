"""Reading a model's answer: JSON text to the fields of a rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Examples kept per list; characters of a bad answer shown.
EXAMPLES_KEPT = 8
ANSWER_SHOWN = 200
# The fields of an answer.
SCALARS = ("pattern", "case_insensitive", "explanation", "confidence", "replacement_template", "group")
LISTS = ("should_match", "should_not_match")


def bare_json(answer: Column) -> Column:
    """Answer without surrounding blanks and code fence."""
    trimmed = F.regexp_replace(answer, r"^\s+|\s+$", "")
    unfenced = F.regexp_replace(trimmed, r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.when(trimmed.startswith("```"), unfenced).otherwise(trimmed)


def kind_of(value: Column) -> Column:
    """Type of a variant's value: OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, …"""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)


def parts(payload: Column) -> dict[str, Column]:
    """Each field of an answer as its kind and its text, and the two lists whole."""
    value = lambda name, kind: F.try_variant_get(payload, f"$.{name}", kind)
    out = {f"__{n}_kind": kind_of(value(n, "variant")) for n in SCALARS}
    out.update({f"__{n}_text": value(n, "string") for n in SCALARS})
    out.update({f"__{n}": value(n, "array<variant>") for n in LISTS})
    return out


def _part(name: str) -> tuple[Column, Column]:
    return F.col(f"__{name}_kind"), F.col(f"__{name}_text")


def _truthy(name: str) -> Column:
    """False for a missing or null value, zero, and empty text, list or object."""
    kind, text = _part(name)
    return (
        F.when(kind.isNull() | kind.isin("VOID", ""), F.lit(False))
        .when(kind == "BOOLEAN", text == "true")
        .when(kind == "STRING", text != "")
        .when(kind.isin("ARRAY", "OBJECT"), ~text.isin("[]", "{}"))
        .otherwise(text.try_cast("double") != 0)
    )


def _number(name: str) -> Column:
    """Numbers, booleans and texts that are numbers, as a double."""
    kind, text = _part(name)
    return (
        F.when(kind == "BOOLEAN", (text == "true").cast("double"))
        .when(kind.isin("ARRAY", "OBJECT", "VOID"), F.lit(None).cast("double"))
        .otherwise(F.trim(text).try_cast("double"))
    )


def _whole(name: str) -> Column:
    """As _number, cut to an integer; text must already be one."""
    kind, text = _part(name)
    number = F.when((kind != "STRING") | text.rlike(r"^\s*[+-]?\d+\s*$"), _number(name))
    return F.when(F.abs(number) < 2147483648, number.cast("int"))


def _text(name: str) -> Column:
    return F.when(_truthy(name), _part(name)[1]).otherwise(F.lit(""))


def _texts(name: str) -> Column:
    """Texts, numbers and booleans of a list, the first few, as text."""
    scalar = lambda v: v.isNotNull() & ~kind_of(v).isin("ARRAY", "OBJECT", "VOID")
    shown = lambda v: F.when(
        kind_of(v) == "BOOLEAN", F.initcap(v.try_cast("string"))
    ).otherwise(v.try_cast("string"))
    kept = F.slice(F.transform(F.filter(f"__{name}", scalar), shown), 1, EXAMPLES_KEPT)
    return F.coalesce(kept, F.array().cast("array<string>"))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def answer_reason(body: Column, payload: Column) -> Column:
    """Why an answer cannot be read; NULL when it can."""
    given = F.try_variant_get(payload, "$.pattern", "variant")
    pattern = F.when(kind_of(given) == "STRING", _strip(given.try_cast("string")))
    return (
        F.when(F.coalesce(body, F.lit("")) == "", F.lit("the answer is empty"))
        .when(payload.isNull(), F.concat(F.lit("the answer is not JSON: "), F.substring(body, 1, ANSWER_SHOWN)))
        .when(kind_of(payload) != "OBJECT", F.lit("the answer is not a JSON object"))
        .when(F.coalesce(pattern, F.lit("")) == "", F.lit("the answer has no pattern"))
    )


def rule_fields() -> dict[str, Column]:
    """Fields of a rule from the columns of parts(), with out-of-range values tamed."""
    kind, pattern = _part("pattern")
    confidence = F.coalesce(_number("confidence"), F.lit(0.0))
    return {
        "pattern": F.when(kind == "STRING", _strip(pattern)),
        "case_insensitive": _truthy("case_insensitive"),
        "explanation": _strip(_text("explanation")),
        "confidence": F.greatest(F.lit(0.0), F.least(confidence, F.lit(1.0))),
        "should_match": _texts("should_match"),
        "should_not_match": _texts("should_not_match"),
        "replacement_template": _text("replacement_template"),
        "group": F.coalesce(_whole("group"), F.lit(0)),
    }
