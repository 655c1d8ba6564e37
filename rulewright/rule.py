"""The rule: a Java regular expression plus the few parameters a run needs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The four rule kinds.
REPLACE = "REPLACE"
MASK = "MASK"
EXTRACT = "EXTRACT"
VALIDATE = "VALIDATE"
OPERATIONS = (REPLACE, MASK, EXTRACT, VALIDATE)

#: One row of a rules table.  Columns beyond the pattern are all optional.
RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("case_insensitive", T.BooleanType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("should_match", T.ArrayType(T.StringType())),
        T.StructField("should_not_match", T.ArrayType(T.StringType())),
        T.StructField("replacement_template", T.StringType()),
        T.StructField("group", T.IntegerType()),
        T.StructField("provider", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("self_test_passed", T.BooleanType()),
        T.StructField("requires", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class TextRule:
    """One rule, ready to be turned into column expressions.

    ``requires`` is an optional speed hint: literals of which every match contains
    at least one ("@" for e-mail, the ten digits for a number).  Cells with none of
    them skip the regex engine, which is a search over raw bytes.  It never changes
    a result as long as the claim holds; vetting holds it against the examples.
    """

    pattern: str
    operation: str = REPLACE
    case_insensitive: bool = False
    replacement_template: str = ""
    group: int = 0
    explanation: str = ""
    confidence: float = 0.0
    should_match: tuple[str, ...] = ()
    should_not_match: tuple[str, ...] = ()
    provider: str = ""
    model: str = ""
    rule_id: str = ""
    requires: tuple[str, ...] = ()

    @property
    def effective_pattern(self) -> str:
        """The pattern with the case switch written into it."""
        if not self.case_insensitive or self.pattern.startswith("(?i)"):
            return self.pattern
        return "(?i)" + self.pattern

    @classmethod
    def from_row(cls, row) -> "TextRule":
        """Build a rule from one row of a rules table; unknown fields are ignored."""
        given = row.asDict() if hasattr(row, "asDict") else dict(row)
        kept = {k: v for k, v in given.items() if k in cls.__dataclass_fields__ and v is not None}
        for listed in ("should_match", "should_not_match", "requires"):
            if listed in kept:
                kept[listed] = tuple(kept[listed])
        return cls(**kept)

    def as_row(self) -> tuple:
        return (
            self.rule_id,
            self.pattern,
            self.operation,
            self.case_insensitive,
            self.explanation,
            float(self.confidence),
            list(self.should_match),
            list(self.should_not_match),
            self.replacement_template,
            self.group,
            self.provider,
            self.model,
            [],
            None,
            list(self.requires),
        )


def rules_table(spark: SparkSession, rules: Iterable[TextRule]) -> DataFrame:
    """Hand-written rules as a rules table."""
    return spark.createDataFrame([r.as_row() for r in rules], RULE_SCHEMA)
