"""Counts over a table: per column, per rule, and several rules in a row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.errors import RuleError
from rulewright.functions.text import column, text_or_blank
from rulewright.operators.transform import (
    COUNTER,
    RuleOutcome,
    apply_rule,
    resolve_targets,
    visible,
)
from rulewright.rule import VALIDATE, TextRule


#: Rules whose hits share one whole number.
WORD = 62


def _bits(number: int) -> Column:
    return F.lit(number).cast("bigint")


def _any_of(text: Column, literals: Sequence[str]) -> Column:
    return reduce(or_, [text.contains(literal) for literal in literals])


def _hits(text: Column, rules: Sequence[TextRule]) -> Column:
    """The rules found in a cell, as bits.

    A cell without any literal of the hinted rules runs none of them; the others run the
    rules of those hints that it holds.
    """
    by_hint: dict[tuple[str, ...], list[Column]] = {}
    for k, rule in enumerate(rules):
        hint = () if rule.case_insensitive else tuple(rule.requires)
        hit = F.when(text.rlike(rule.effective_pattern), _bits(1 << k)).otherwise(_bits(0))
        by_hint.setdefault(hint, []).append(hit)
    found = reduce(add, by_hint.pop((), []), _bits(0))
    if by_hint:
        hinted = reduce(add, [F.when(_any_of(text, hint), reduce(add, hits)).otherwise(_bits(0)) for hint, hits in by_hint.items()])
        literals = list(dict.fromkeys(literal for hint in by_hint for literal in hint))
        found = found + F.when(_any_of(text, literals), hinted).otherwise(_bits(0))
    return found


def profile(df: DataFrame, rules: Sequence[TextRule], columns: Sequence[str] | None = None) -> DataFrame:
    """Every rule against every column in one scan.

    One row per rule and column: affected_cells, total_rows, rate, and
    affected_rows, the rows in which the rule affects any of the columns.

    The cells of a row are an array, on which the rules are written once, so the plan grows
    with the rules and not with the columns.  Cells in which nothing is found are not
    counted one by one.  Counters are partial sums in the scan's own tasks; a row per
    column with hits and task is shuffled.
    """
    if not rules:
        raise RuleError("name at least one rule")
    chosen = resolve_targets(df, columns or visible(df.columns))
    width, words = len(chosen), [rules[i : i + WORD] for i in range(0, len(rules), WORD)]
    cells = df.select(F.array(*[text_or_blank(column(name)) for name in chosen]).alias("cells"))
    found = cells.select(*[F.transform("cells", lambda text: _hits(text, word)).alias(f"w{i}") for i, word in enumerate(words)])
    # After the cells of a word: what any cell of the row holds, and what all hold.  Last, the row itself.
    stride = width + 2
    anywhere = lambda bits: F.aggregate(bits, _bits(0), lambda a, b: a.bitwiseOR(b))
    everywhere = lambda bits: F.aggregate(bits, _bits(-1), lambda a, b: a.bitwiseAND(b))
    marks = [part for i in range(len(words)) for part in (F.col(f"w{i}"), F.array(anywhere(f"w{i}"), everywhere(f"w{i}")))]
    lines = found.select(F.posexplode(F.concat(*marks, F.array(_bits(1)))).alias("at", "bits")).where("bits <> 0")
    seen = [F.count_if(F.col("bits").bitwiseAND(_bits(1 << k)) != 0) for k in range(min(len(rules), WORD))]
    by_place = lines.groupBy("at").agg(F.array(*seen).alias("seen"))
    counted = by_place.agg(F.map_from_entries(F.collect_list(F.struct("at", "seen"))).alias("counts"))

    # One row of counts per place from here on.
    pairs = F.explode(F.sequence(F.lit(0), F.lit(len(rules) * width - 1))).alias("pair")
    rule_at, cell_at = (F.col("pair") / width).cast("int"), F.col("pair") % width
    word_at, bit_at = (rule_at / WORD).cast("int"), rule_at % WORD

    def count(place: Column, bit: Column) -> Column:
        return F.coalesce(F.try_element_at(F.try_element_at("counts", place.cast("int")), bit + 1), _bits(0))

    n = count(F.lit(len(words) * stride), F.lit(0))
    fails = F.lit([rule.operation == VALIDATE for rule in rules])[rule_at]
    hit_cells, hit_rows, full_rows = (count(word_at * stride + at, bit_at) for at in (cell_at, width, width + 1))
    return counted.select("counts", pairs).select(
        F.lit([rule.rule_id for rule in rules])[rule_at].alias("rule_id"),
        F.lit(chosen)[cell_at].alias("column_name"),
        F.when(fails, n - hit_cells).otherwise(hit_cells).alias("affected_cells"),
        F.when(fails, n - full_rows).otherwise(hit_rows).alias("affected_rows"),
        n.alias("total_rows"),
    ).withColumn("rate", F.when(F.col("total_rows") > 0, F.round(F.col("affected_cells") / F.col("total_rows"), 4)).otherwise(F.lit(0.0)))


def column_counts(df: DataFrame, rule: TextRule, targets: Sequence[str]) -> DataFrame:
    """Affected cells and their share, per target column of one rule."""
    return profile(df, [rule], targets).select("column_name", "affected_cells", "total_rows", "rate")


def apply_rules(
    df: DataFrame, steps: Sequence[tuple[TextRule, Sequence[str], str]]
) -> RuleOutcome:
    """Several rules one after the other, each on the output of the one before.

    Step k leaves its counter in ``__matched_k``; ``__matched`` is their sum.
    The steps stay in one stage.
    """
    frame, added, done = df, [], ()
    names = [f"{COUNTER}_{k}" for k in range(1, len(steps) + 1)]
    for name, (rule, targets, value) in zip(names, steps):
        outcome = apply_rule(frame, rule, targets, value, counter=name)
        frame = outcome.frame
        added += outcome.added_columns
        done += outcome.steps
    frame = frame.withColumn(COUNTER, reduce(add, [column(n) for n in names], F.lit(0)))
    return RuleOutcome(frame, visible(frame.columns), added, done)
