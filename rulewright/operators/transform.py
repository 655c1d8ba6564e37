"""Apply one rule to the chosen columns of a table, in one projection.

The whole run is a single ``select`` of built-in expressions: no shuffle, no
Python worker, streaming or batch alike.  A cell that the rule does not find is
passed through without running the replacement, so the common case costs one
regex scan, and none where the rule's ``requires`` literals are absent.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.errors import RuleError
from rulewright.functions.text import as_text, column, quote_replacement, text_or_blank
from rulewright.rule import EXTRACT, MASK, OPERATIONS, REPLACE, VALIDATE, TextRule

# The per-row counter and the prefix of columns never shown.
COUNTER = "__matched"
HIDDEN_PREFIX = "__"
NAMES_IN_MESSAGE = 25


class RuleStep(NamedTuple):
    """What one rule did: its kind and pattern, where it looked and where it wrote."""

    operation: str
    pattern: str
    targets: tuple[str, ...]
    outputs: tuple[str, ...]


@dataclass(frozen=True)
class RuleOutcome:
    """A lazy result: the table and what a caller needs to know about it."""

    frame: DataFrame
    visible_columns: list[str] = field(default_factory=list)
    added_columns: list[str] = field(default_factory=list)
    steps: tuple[RuleStep, ...] = ()


def visible(names: Sequence[str]) -> list[str]:
    return [n for n in names if not n.startswith(HIDDEN_PREFIX)]


def hide_internal(df: DataFrame) -> DataFrame:
    """Drop the bookkeeping columns."""
    return df.select(*[column(n) for n in visible(df.columns)])


def resolve_targets(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Match wanted names to the schema: trimmed, case-blind, first-seen order."""
    if not wanted:
        raise RuleError("name at least one target column")
    by_folded: dict[str, list[str]] = {}
    for name in df.columns:
        by_folded.setdefault(name.lower(), []).append(name)

    found = {str(w): by_folded.get(str(w).strip().lower(), []) for w in wanted}
    missing = [w for w, names in found.items() if not names]
    if missing:
        raise RuleError(
            f"no column(s) {missing} in the table, which has {df.columns[:NAMES_IN_MESSAGE]}"
        )
    unclear = sorted({n for names in found.values() if len(names) > 1 for n in names})
    if unclear:
        raise RuleError(f"columns {unclear} differ only by case; rename one of them")
    return list(dict.fromkeys(names[0] for names in found.values()))


def free_name(stem: str, taken: Sequence[str]) -> str:
    """``stem``, or the first of stem_2, stem_3, … not taken (ignoring case)."""
    used = {t.lower() for t in taken}
    name, n = stem, 1
    while name.lower() in used:
        n += 1
        name = f"{stem}_{n}"
    return name


def may_hold(text: Column, rule: TextRule) -> Column | None:
    """True where a match is possible by the rule's ``requires``; None without a hint."""
    if not rule.requires or rule.case_insensitive:
        return None
    return reduce(or_, [text.contains(literal) for literal in rule.requires])


def found_in(cell: Column, rule: TextRule) -> Column:
    """True where the rule is found; NULL is searched as the empty string."""
    text = text_or_blank(cell)
    possible, hit = may_hold(text, rule), text.rlike(rule.effective_pattern)
    return hit if possible is None else possible & hit


def affected_flag(hit: Column, rule: TextRule) -> Column:
    """1 for an affected cell, else 0.  VALIDATE counts the cells that fail."""
    return (~hit if rule.operation == VALIDATE else hit).cast("int")


def rewritten(cell: Column, hit: Column, rule: TextRule, replacement: str) -> Column:
    """Cell with every match replaced; NULL stays NULL."""
    text = as_text(cell)
    swapped = F.regexp_replace(text, F.lit(rule.effective_pattern), F.lit(replacement))
    return F.when(hit, swapped).otherwise(text)


def extracted(cell: Column, hit: Column, rule: TextRule) -> Column:
    """First match's group; empty when there is no match or the group took no part."""
    got = F.regexp_extract(text_or_blank(cell), rule.effective_pattern, rule.group)
    return F.when(hit, got).otherwise(F.lit(""))


def apply_rule(
    df: DataFrame,
    rule: TextRule,
    targets: Sequence[str],
    value: str = "",
    *,
    raw_template: bool = False,
    counter: str = COUNTER,
) -> RuleOutcome:
    """Plan ``rule`` over ``targets``; nothing runs until the frame is used.

    ``value`` is what REPLACE writes, taken literally; with ``raw_template`` its
    ``$1`` references are honoured.
    """
    if rule.operation not in OPERATIONS:
        raise RuleError(f"unsupported operation: {rule.operation}")
    chosen = resolve_targets(df, targets)
    if counter.lower() in {c.lower() for c in df.columns}:
        raise RuleError(f"the table already has a column named {counter}")

    kept = {name: column(name) for name in df.columns}
    hits = {n: found_in(kept[n], rule) for n in chosen}
    added: dict[str, Column] = {}

    if rule.operation in (REPLACE, MASK):
        if rule.operation == MASK:
            new_text, literal = rule.replacement_template, False
        else:
            new_text, literal = value, not raw_template
        template = quote_replacement(new_text) if literal else new_text
        kept.update({n: rewritten(kept[n], hits[n], rule, template).alias(n) for n in chosen})
    elif rule.operation == EXTRACT:
        for n in chosen:
            name = free_name(f"{n}_extracted", [*df.columns, *added])
            added[name] = extracted(kept[n], hits[n], rule).alias(name)
    else:
        for n in chosen:
            name = free_name(f"{n}_valid", [*df.columns, *added])
            added[name] = hits[n].alias(name)

    total = reduce(add, [affected_flag(hit, rule) for hit in hits.values()])
    out = df.select(*kept.values(), *added.values(), total.alias(counter))
    step = RuleStep(rule.operation, rule.effective_pattern, tuple(chosen), tuple(added) or tuple(chosen))
    return RuleOutcome(out, visible(out.columns), list(added), (step,))
