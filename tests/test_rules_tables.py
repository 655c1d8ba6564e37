from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulewright import (
    EXTRACT,
    MASK,
    OPERATIONS,
    REPLACE,
    VALIDATE,
    RuleError,
    TextRule,
    catalogue_rules,
    known_rule,
    rules_table,
    suggest_rules,
)
from rulewright.operators.lint import group_count, lint_rules, self_test_totals, to_java
from rulewright.operators.requests import gate_requests, payloads
from rulewright.operators.rulebook import CATALOGUE, keyword_table, match_words


def verdict(spark, rule, **options):
    return lint_rules(rules_table(spark, [rule]), **options).first()


EMAIL = known_rule("email").pattern


@pytest.mark.parametrize("pattern, reason", [
    (EMAIL, None),
    ("   ", "blank"),
    ("", "blank"),
    ("[a-z", "does-not-compile"),
    ("(a+)+$", "runaway:nested-repeat"),
    ("(?:x+)+y", "runaway:nested-repeat-noncapturing"),
    (".*.*=.*", "runaway:any-any-star"),
    ("a.+.+b", "runaway:any-any-plus"),
    ("(a|a)*b", "runaway:repeated-choice"),
    ("a{5000}", "runaway:huge-count"),
    (r"^(\w+\s?)*$", "runaway:optional-tail"),
    ("a" * 2001, "too-long"),
    ("[[:alpha:]]+", "not-java:posix-class"),
    ("foo(?#note)bar", "not-java:inline-comment"),
    ("(?P>x)", "not-java:recursive-group"),
    (r"\p{Alpha}+", None),
    (r"(?<=a)b(?!c)", None),
])
def test_verdicts(spark, pattern, reason):
    row = verdict(spark, TextRule(pattern))
    assert row["accepted"] == (reason is None)
    assert row["reason"] == reason


def test_length_limit_is_a_parameter(spark):
    row = verdict(spark, TextRule("a" * 21), max_pattern=20)
    assert (row["reason"], row["reason_args"]) == ("too-long", {"length": "21", "limit": "20"})


def test_python_spellings_are_rewritten(spark):
    row = verdict(spark, TextRule(r"(?P<user>\w+)@(?P<host>\w+)-(?P=user)"))
    assert row["pattern"] == r"(?<user>\w+)@(?<host>\w+)-\k<user>"
    assert row["accepted"] and len(row["warnings"]) == 2
    assert verdict(spark, TextRule("(?P<a>[[:alpha:]])"))["pattern"] == "(?<a>[[:alpha:]])"


def test_self_test(spark):
    row = verdict(spark, TextRule(r"^\d{3}$", should_match=("123", "abc"), should_not_match=("999",)))
    assert row["accepted"] and row["self_test_passed"] is False and len(row["warnings"]) == 2
    assert (row["missed"], row["false_hits"]) == (["abc"], ["999"])
    strict = verdict(spark, TextRule(r"^\d{3}$", should_match=("abc",)), strict=True)
    assert not strict["accepted"] and strict["reason"] == "self-test"
    good = verdict(spark, TextRule(EMAIL, should_match=("a@b.com",), should_not_match=("nope", "a@b")))
    assert good["self_test_passed"] is True and good["warnings"] == []
    assert verdict(spark, TextRule("a"))["self_test_passed"] is None
    assert verdict(spark, TextRule("ABC", case_insensitive=True, should_match=("abc",)))["self_test_passed"]
    many = verdict(spark, TextRule("x", should_match=("a", "b", "c", "d")))
    assert "['a', 'b', 'c']" in many["warnings"][0]


@pytest.mark.parametrize("template, pattern, words", [
    ("$1***$3", "(a)(b)", ("template:number", {"wants": "3", "has": "2"})),
    ("", "(a)", ("template:missing", None)),
    ("${m}", "(?<n>a)", ("template:name", {"wants": "m"})),
    ("$1***$2", "(a)(b)", None),
    ("${n}", "(?<n>a)", None),
    (r"\$9", "(a)", None),
])
def test_templates(spark, template, pattern, words):
    row = verdict(spark, TextRule(pattern, MASK, replacement_template=template))
    assert row["accepted"] == (words is None)
    assert words is None or (row["reason"], row["reason_args"]) == words


def test_template_without_reference_is_a_warning(spark):
    row = verdict(spark, TextRule("(a)", MASK, replacement_template="***"))
    assert row["accepted"] and row["warnings"] == ["template-keeps-no-group"]


def test_a_hint_is_held_against_the_examples(spark):
    assert verdict(spark, TextRule(r"\d+", requires=("@",), should_match=("12",)))["reason"] == "requires-contradicted"
    assert verdict(spark, TextRule(r"\d+", requires=("1", "2"), should_match=("12",)))["reason"] == "requires-unproved"
    assert verdict(spark, TextRule(r"\d+", requires=("@",)))["reason"] == "requires-unproved"
    assert verdict(spark, TextRule(r"\d+", requires=("@",), case_insensitive=True))["accepted"]
    assert verdict(spark, TextRule(r"\d+", requires=tuple("0123456789"), should_match=("12",)))["accepted"]


@pytest.mark.parametrize("group, fine", [(0, True), (2, True), (5, False), (-1, False)])
def test_extract_group(spark, group, fine):
    assert verdict(spark, TextRule(r"(\w+)@(\w+)", EXTRACT, group=group))["accepted"] is fine


def test_self_test_totals(spark):
    rules = [TextRule("a", should_match=("a",)), TextRule("b", should_match=("x", "y")), TextRule("c"), TextRule("(")]
    row = self_test_totals(lint_rules(rules_table(spark, rules))).first()
    assert tuple(row) == (1, 1, 2, 2, 0)


pieces = st.sampled_from(["(", ")", "(?:", "(?P<n>", r"\(", "[(]", "[^)(]", "a", r"\\", "|", "(?=", "(?<!", "*"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(pieces, max_size=8), min_size=30, max_size=60))
def test_group_count_agrees_with_another_engine(spark, made):
    patterns = []
    for parts in made:
        pattern = "".join(parts)
        try:
            patterns.append((pattern, re.compile(pattern).groups))
        except re.error:
            continue
    if patterns:
        df = spark.createDataFrame(patterns, "p string, n int")
        wrong = df.where(group_count(to_java(F.col("p"))) != F.col("n")).collect()
        assert wrong == []


@pytest.mark.parametrize("operation", OPERATIONS)
def test_catalogue_passes_vetting(spark, operation):
    rows = lint_rules(rules_table(spark, catalogue_rules(operation))).collect()
    assert [r["rule_id"] for r in rows if not r["accepted"]] == []
    if operation == REPLACE:
        assert len(rows) == 14 and all(r["self_test_passed"] for r in rows)


def test_required_literals_hold_for_the_examples():
    for known in CATALOGUE:
        for text in known.should_match if known.requires else ():
            assert any(r in text for r in known.requires)


def asked(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, description string, operation string")


def test_suggestions(spark):
    rows = suggest_rules(asked(
        spark,
        ("Find E-MAIL addresses", REPLACE),
        ("mask the   mail\taddress", MASK),
        ("ip address", EXTRACT),
        ("html please", VALIDATE),
        ("uuid", MASK),
        ("gibberish", REPLACE),
        ("Starting with 'A.b(c)'", REPLACE),
        ('cells ending with "x y"', VALIDATE),
        ("holding 'q'", None),
        ("email", "DROP"),
    )).orderBy("id").collect()
    assert [r["pattern"] for r in rows[:4]] == [
        EMAIL,
        known_rule("email", MASK).pattern,
        known_rule("ipv4", EXTRACT).pattern,
        "^" + known_rule("tag").pattern + "$",
    ]
    assert rows[1]["replacement_template"] == "$1***$2" and rows[2]["group"] == 1
    assert "no mask" in rows[4]["reason"] and "no pattern" in rows[5]["reason"]
    assert [rows[i]["pattern"] for i in (6, 7, 8)] == [r"^a\.b\(c\)", r"^x\ y$$", "q"]
    assert rows[6]["should_match"] == ["a.b(c)"] and rows[6]["should_not_match"] == []
    assert rows[9]["reason"] == "unsupported operation: DROP"
    assert all(r["confidence"] == 0.55 for r in rows)


def test_first_entry_wins_and_words_are_stricter(spark):
    df = asked(spark, ("validate the company number", REPLACE), ("mobile number", REPLACE), ("an IP, and a zip", REPLACE))
    by_text = {r["id"]: r["explanation"] for r in suggest_rules(df).collect()}
    assert by_text[0] == known_rule("card").explanation  # "pan" in "company"
    words = {r["id"]: r["name"] for r in match_words(df, keyword_table(spark), "id").collect()}
    assert words == {0: "digits", 1: "phone", 2: "ipv4"}
    named = df.join(match_words(df, keyword_table(spark), "id"), "id")
    assert suggest_rules(named, F.col("name")).where("id = 0").first()["pattern"] == r"\d+"


def test_keywords_of_any_length(spark):
    keywords = spark.createDataFrame(
        [("social security card number", "long", 0), ("card", "short", 1), ("card", "other", 1)], "phrase string, name string, priority int"
    )
    df = asked(spark, ("my social security card number", REPLACE), ("my social security card", REPLACE), ("nothing", REPLACE), ("", REPLACE), (None, REPLACE))
    got = {r["id"]: r["name"] for r in match_words(df, keywords, "id").collect()}
    assert got == {0: "long", 1: "other", 2: None, 3: None, 4: None}


def test_a_known_rule_without_mask(spark):
    with pytest.raises(RuleError, match="no mask"):
        known_rule("uuid", MASK)
    assert known_rule("tag", VALIDATE).pattern.startswith("^")


GATE = "source_key string, sheet_name string, operation string, natural_language string, replacement_value string, target_columns array<string>"


@pytest.mark.parametrize("change, word", [
    ({}, None),
    ({"source_key": "raw/../a.csv"}, "invalid key"),
    ({"source_key": "a.txt"}, "unsupported file type"),
    ({"source_key": " "}, "blank"),
    ({"operation": "DROP"}, "four kinds"),
    ({"operation": None}, None),
    ({"natural_language": " ab "}, "fewer than 3"),
    ({"natural_language": "x" * 2001}, "longer than 2000"),
    ({"replacement_value": ""}, "required for REPLACE"),
    ({"replacement_value": "", "operation": "MASK"}, None),
    ({"target_columns": []}, "none is named"),
    ({"target_columns": ["a"] * 51}, "more than 50"),
    ({"target_columns": ["a", " "]}, "blank"),
    ({"target_columns": ["a" * 256]}, "longer than 255"),
])
def test_request_gate(spark, change, word):
    base = {
        "source_key": "/raw/a.CSV", "sheet_name": "", "operation": "REPLACE", "natural_language": "find it",
        "replacement_value": "x", "target_columns": [" a", "b", "a"],
    }
    row = gate_requests(spark.createDataFrame([tuple({**base, **change}.values())], GATE)).first()
    assert row["accepted"] == (word is None)
    assert word is None or any(word in p for p in row["problems"])
    if not change:
        assert row["source_key"] == "raw/a.CSV" and row["target_columns"] == ["a", "b"]


def test_payloads(spark):
    df = spark.createDataFrame(
        [(REPLACE, 'say "hi"', [f"c{i}" for i in range(30)], list("abcdefg"), "v"), (MASK, "d", ["c"], [], "v")],
        "operation string, description string, columns array<string>, samples array<string>, replacement_value string",
    )
    import json

    one, two = (json.loads(r["payload"]) for r in payloads(df).collect())
    assert one["user_description"] == 'say "hi"' and len(one["target_columns"]) == 20
    assert one["sample_values_from_those_columns"] == list("abcde") and one["literal_replacement_value"] == "v"
    assert set(two) == {"operation", "user_description", "target_columns"}
