"""Pattern structure: runaway loops, bounded tries, literals of every match."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from rulewright import TextRule, apply_rule
from rulewright.operators.lint import lint_rules
from rulewright.operators.rulebook import CATALOGUE, catalogue_rules
from rulewright.operators.shape import derive_hints, holds, pattern_shape
from rulewright.rule import MASK, rules_table

from conftest import total

RUNAWAY = {
    r"((a+)b?)*$": "loose-end", r"(?:a|aa)+$": "overlapping-choice", r"(x(a+)?)*": "loose-end", r"(?:(?:a+)?b?)*": "loose-end",
    r"(?:(?:\s|\d+)b*)+": "loose-end", r"(?:x|.)+": "overlapping-choice", r"((((a*))))*": "loose-end", r"(?:[)]|[)]b)+": "overlapping-choice",
    r"(?:(?:(?:ab|c)d+)e?){2,}": "loose-end", r"(?:\Qa)\E+)+": "loose-end",
}
CALM = [
    r"(?:foo|bar)+", r"(?:[A-Za-z0-9-]+\.)+[a-z]{2,}", r"(?>a+b?)*", r"(?:a++)*", r"((\d{1,3})\.){3}", r"(?:(?:a+)b)*", r"\(a+\)*", r"[(a+)]*",
    r"(?:ab(?=c+))*", "", "a", r"(?:(a+)b)*c", r"(?:a+){3}",
]


def shapes(spark, patterns):
    table = spark.createDataFrame([(p,) for p in patterns], "p string").select("p", pattern_shape("p").alias("s"))
    return {r.p: r.s for r in table.collect()}


def test_runaway_structures(spark):
    got = shapes(spark, [*RUNAWAY, *CALM])
    assert {p: got[p].reason for p in RUNAWAY} == {p: f"runaway:{code}" for p, code in RUNAWAY.items()}
    assert [p for p in CALM if got[p].reason] == []
    verdicts = {r.pattern: r.reason for r in lint_rules(rules_table(spark, [TextRule(p) for p in [*RUNAWAY, *CALM[:-1]]])).collect()}
    assert all(verdicts[p].startswith("runaway:") for p in RUNAWAY)
    assert verdicts[r"(?:foo|bar)+"] is None and verdicts[r"(?:(a+)b)*c"] is None


def test_hints_hold_in_every_match(spark):
    """Texts that match by another engine hold a member of each set."""
    samples = {
        r"ab|cd": ["ab", "xcd"], r"a(?:b|c)d": ["abd", "acd"], r"\d{2}x?": ["12", "34x"], r"(?:\d|[a-c])z": ["1z", "bz"], r"a?b*c+": ["c", "abcc"],
        r"\Qa.b\E": ["a.b"], r"[\d.-]+@": ["1@", ".-@"], r"https?://xy": ["http://xy", "https://xy"], r"(?:ab){2}": ["abab"], r"^\$[^a]$": ["$b"],
        r"a\.b\|c": ["a.b|c"], r"(a|)b": ["ab", "b"], r"(?=a)b?a": ["a"], r"x(?:\d{4}-)?y": ["xy", "x1234-y"], r"\d{4}-\d|\d/\d": ["1234-5", "1/2"],
    }
    got = shapes(spark, samples)
    for pattern, texts in samples.items():
        for text in texts:
            assert re.search(pattern.replace(r"\Q", "").replace(r"\E", "").replace("a.b", r"a\.b"), text)
            for members in got[pattern].sets:
                assert any(m in text for m in members), (pattern, text, members)
    assert got["ab|cd"].hint == ["ab", "cd"] and got[r"https?://xy"].hint == ["://xy"] and got[r"\Qa.b\E"].hint == ["a.b"]
    assert ["http"] in got[r"https?://xy"].sets
    nothing = shapes(spark, [r"(?i)abc", r"\w+", r"a?", r"a|\w", r"[^a]", r"(?:abc)?", r"(?i:abc)", r"\x41", ""])
    assert all(s.hint is None for s in nothing.values())


def test_catalogue_hints(spark):
    named = {k.name: k for k in CATALOGUE}
    claims = spark.createDataFrame([(k.name, k.pattern, list(k.requires)) for k in CATALOGUE], "name string, p string, r array<string>")
    proved = {r.name: r.ok for r in claims.select("name", holds(pattern_shape("p"), F.col("r")).alias("ok")).collect()}
    assert [n for n, ok in proved.items() if named[n].requires and not ok] == []
    bare = [TextRule(**{**r.__dict__, "requires": ()}) for kind in ("REPLACE", MASK, "EXTRACT") for r in catalogue_rules(kind)]
    found = {(r.rule_id, r.operation): r.requires for r in derive_hints(rules_table(spark, bare)).collect()}
    without = {n for (n, kind), hint in found.items() if kind == "REPLACE" and not hint}
    assert len(named) == 14 and without == {"whitespace", "non_ascii"}


def test_results_do_not_change_with_derived_hints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    tickets = docs.unionByName(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(("a@b.org 1.2.3.4", "$5 <b>", "2024-01-02 and 3/4/25", ""))], docs.schema))
    for row in derive_hints(rules_table(spark, [TextRule(**{**r.__dict__, "requires": ()}) for r in catalogue_rules()])).collect():
        with_hint, without = (apply_rule(tickets, TextRule(row.pattern, requires=tuple(h)), ["text"], "#").frame for h in (row.requires, ()))
        assert total(with_hint) == total(without)
        assert with_hint.exceptAll(without).count() == 0


def test_long_examples_are_not_tried(spark):
    slow = TextRule(r"\w+\s*\w+!", should_match=("a b!",), should_not_match=("x" * 5000,))
    row = lint_rules(rules_table(spark, [slow])).first()
    assert (row.accepted, row.untested, row.self_test_passed, row.warnings) == (True, 1, None, ["not-tested:1"])
    # References are not placed: only short examples are tried.
    back = TextRule(r"(a+)b\1", should_match=("aba", "c" * 40), should_not_match=("ab",))
    row = lint_rules(rules_table(spark, [back])).first()
    assert (row.untested, row.self_test_passed, row.missed) == (1, None, [])
    wrong = TextRule(r"(a+)b\1", should_match=("ac", "c" * 40))
    row = lint_rules(rules_table(spark, [wrong])).first()
    assert (row.untested, row.self_test_passed, row.missed) == (1, False, ["ac"])
    plain = TextRule(r"\d+", should_match=("1" * 9000,))
    assert lint_rules(rules_table(spark, [plain])).first().untested == 0
