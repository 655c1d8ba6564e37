"""Queries over tables of rules, requests and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulewright.functions.text import distinct_texts, effective_pattern, extension_of, squeeze
from rulewright.operators.lint import group_count, lint_rules, self_test_totals, to_java
from rulewright.operators.requests import gate_requests, payloads
from rulewright.operators.resolve import (
    RULE_FIELDS,
    hits_of,
    judge_answers,
    keyed,
    keys_to_ask,
    live_entries,
    parse_answers,
    remember,
    repairs_to_ask,
    resolve,
    reuse_stats,
)
from rulewright.operators.rulebook import (
    CATALOGUE,
    keyword_table,
    match_words,
    name_by_substring,
    suggest_rules,
)
from workload.registry import choose, derive, query, spark_text, table, text

# ---------------------------------------------------------------- rules, one per part
SHAPES = [
    r"[A-Za-z]+#\d+",
    "   ",
    "[a-z",
    r"(a+)+",
    r"(?:x+)+y",
    r".*.*=",
    r".+.+",
    r"(a|b)*c",
    r"a{5000}",
    r"[[:alpha:]]+",
    r"foo(?#note)bar",
    r"(?P<u>[a-z]+)-(?P=u)",
    r"(\w+)#(\d)",
    r"^\d{3}$",
    r"(?P>x)",
    r"(unclosed",
    r"\(not a group\)[(]?",
    r"(?<word>[A-Z])[a-z]+",
    r"BRAND",
    r"((a+)b?)*$",
    r"(?:a|aa)+$",
    r"(?:foo|bar)+x",
    r"(?:(?:\d+)-)+",
    r"(?:(?:ab|c)d+){2,}",
]
OPS = ["REPLACE", "MASK", "EXTRACT", "VALIDATE"]
TEMPLATES = ["$1-x", "$3", "plain", "", r"\$9 $1", "$2 and $1"]


def _rules(quote, kind: str) -> str:
    shape = choose(SHAPES, "p_partkey", quote)
    template = choose(TEMPLATES, "(p_partkey // 4)" if kind == "VARCHAR" else "(p_partkey div 4)", quote)
    arrays = "list_value" if kind == "VARCHAR" else "array"
    return f"""CAST(p_partkey AS {kind}) AS rule_id,
    CASE WHEN p_partkey % 97 = 0 THEN repeat('a', CAST(1990 + p_partkey % 20 AS INTEGER))
      ELSE concat({shape}, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END) END AS pattern,
    {choose(OPS, 'p_partkey', quote)} AS operation, p_partkey % 3 = 0 AS case_insensitive,
    {template} AS replacement_template, CAST(p_partkey % 5 AS INTEGER) - 1 AS group_no,
    CASE WHEN p_partkey % 7 > 1 THEN {arrays}(p_brand, '123', 'aa') END AS should_match,
    CASE WHEN p_partkey % 7 > 2 THEN {arrays}('zz top', p_name, p_type) END AS should_not_match"""


def rules_of_parts(spark, sf_dir):
    made = derive(table(spark, sf_dir, "part"), _rules(spark_text, "STRING"))
    return made.withColumnRenamed("group_no", "group")


_JAVA = r"""regexp_replace(replace(pattern, '(?P<', '(?<'), '\(\?P=(\w+)\)', '\\k<\1>', 'g')"""
_BARE = r"""regexp_replace(regexp_replace(java, '\\.', '_', 'g'), '\[[^\]]*\]', '_', 'g')"""
_COUNT = r"""len(regexp_extract_all(bare, '\(')) - len(regexp_extract_all(bare, '\(\?'))
  + len(regexp_extract_all(bare, '\(\?<[a-zA-Z]'))"""
# Structure in SQL: items become m, n, o or L (must or may match; may, must with a loop at the end),
# then the innermost groups become items, round by round.
_INNER = r"\((?:[mLno|]*\|)?{}(?:\|[mLno|]*)?\)"
_LOOSE, _BLANK = _INNER.format("[mLno]*[Lo][no]*"), _INNER.format("[no]*")


def _items(bare: str) -> str:
    plain = rf"regexp_replace(regexp_replace({bare}, '[\^$]', '', 'g'), '\(\?(?::|<[A-Za-z]\w*>)', '(', 'g')"
    counted = rf"regexp_replace(regexp_replace({plain}, '\{{\d+,\}}', '+', 'g'), '\{{\d+(?:,\d+)?\}}', '', 'g')"
    return rf"replace(replace(replace(regexp_replace({counted}, '[^()|*+?]', 'm', 'g'), 'm*', 'o'), 'm+', 'L'), 'm?', 'n')"


def _collapsed(items: str) -> str:
    out = items
    for shape, item in (
        (r"\([mLno|]*\)\*", "o"), (r"\([mLno|]*\)\+", "L"), (_LOOSE + r"\?", "o"), (r"\([mLno|]*\)\?", "n"),
    ):
        out = f"regexp_replace({out}, '{shape}', '{item}', 'g')"
    for shape, item in ((_LOOSE, "L"), (_BLANK, "n"), (r"\([mLno|]*\)", "m")):
        out = f"regexp_replace({out}, '{shape}([^*+?]|$)', '{item}\\1', 'g')"
    return out


_ALTERNATIVES = r"regexp_extract_all(regexp_replace(regexp_replace(bare, '\{\d+,\}', '+', 'g'), '\(\?:', '(', 'g'), '\(([^()]*\|[^()]*)\)[*+]', 1)"
_ALIKE = (
    f"len(list_filter(list_transform({_ALTERNATIVES}, lambda a: list_transform(string_split(a, '|'), lambda x: x[1])), "
    "lambda f: len(list_distinct(f)) < len(f) OR list_contains(f, '.'))) > 0"
)
# Verdicts in SQL.  Look-ahead is spelled out, since the other engine has none.
VETTED = rf"""
rules AS (SELECT {_rules(text, 'VARCHAR')} FROM part),
spelled AS (SELECT *, {_JAVA} AS java FROM rules),
bared AS (SELECT *, {_BARE} AS bare FROM spelled),
counted AS (SELECT *, {_COUNT} AS groups,
  list_filter(regexp_extract_all(replacement_template, '(?:^|[^\\])\$(\d)', 1), lambda x: true) AS refs FROM bared),
itemised AS (SELECT *, {_items('bare')} AS items0 FROM counted),
collapsed1 AS (SELECT *, {_collapsed('items0')} AS items1 FROM itemised),
collapsed2 AS (SELECT *, {_collapsed('items1')} AS items2 FROM collapsed1),
judged AS (SELECT *, CASE
  WHEN trim(java) = '' THEN 'blank'
  WHEN length(pattern) > 2000 THEN 'too-long'
  WHEN contains(java, '(?#') THEN 'not-java:inline-comment'
  WHEN regexp_matches(java, '\[\[:[a-z]+:\]\]') THEN 'not-java:posix-class'
  WHEN contains(java, '(?P>') THEN 'not-java:recursive-group'
  WHEN contains(bare, '[') OR len(regexp_extract_all(bare, '\(')) <> len(regexp_extract_all(bare, '\)'))
    THEN 'does-not-compile'
  WHEN regexp_matches(java, '\((?:[^()?:][^()]*)?[+*]\)\s*[+*]') THEN 'runaway:nested-repeat'
  WHEN regexp_matches(java, '\(\?:[^()]*[+*]\)\s*[+*]') THEN 'runaway:nested-repeat-noncapturing'
  WHEN regexp_matches(java, '\((?:\?:)?[^()]*[+*][^()]*\?\)\s*[+*]') THEN 'runaway:optional-tail'
  WHEN contains(java, '.*.*') THEN 'runaway:any-any-star'
  WHEN contains(java, '.+.+') THEN 'runaway:any-any-plus'
  WHEN regexp_matches(java, '\((?:[^()?:|][^()|]*)?\|[^()]*\)\s*[+*]') THEN 'runaway:repeated-choice'
  WHEN regexp_matches(java, '\{{\d{{4,}},?\d*\}}') THEN 'runaway:huge-count'
  WHEN regexp_matches(items0, '{_LOOSE}[*+]') OR regexp_matches(items1, '{_LOOSE}[*+]') OR regexp_matches(items2, '{_LOOSE}[*+]')
    THEN 'runaway:loose-end'
  WHEN {_ALIKE} THEN 'runaway:overlapping-choice'
  WHEN operation = 'MASK' AND replacement_template = '' THEN 'template:missing'
  WHEN operation = 'MASK' AND len(list_filter(refs, lambda x: CAST(x AS INTEGER) > groups)) > 0
    THEN 'template:number'
  WHEN operation = 'EXTRACT' AND (group_no > groups OR group_no < 0)
    THEN 'group-out-of-range'
  END AS reason FROM collapsed2),
runnable AS (SELECT *, replace(CASE WHEN reason IS NOT NULL OR contains(java, '\k<') THEN '$^'
  WHEN case_insensitive THEN concat('(?i)', java) ELSE java END, '(?<', '(?P<') AS safe FROM judged),
tested AS (SELECT *,
  CASE WHEN reason IS NULL THEN coalesce(list_filter(should_match, lambda x: NOT regexp_matches(x, safe)), []) END AS missed,
  CASE WHEN reason IS NULL THEN coalesce(list_filter(should_not_match, lambda x: regexp_matches(x, safe)), []) END AS false_hits
  FROM runnable),
vetted AS (SELECT *,
  CASE WHEN reason IS NULL AND (len(coalesce(should_match, [])) + len(coalesce(should_not_match, []))) > 0
    THEN len(missed) = 0 AND len(false_hits) = 0 END AS self_test_passed FROM tested)"""


def _named(items: str) -> str:
    return f"concat('[', array_to_string(list_transform(({items})[1:3], lambda x: concat('''', x, '''')), ', '), ']')"


@query(
    "lint_rules",
    rf"""WITH {VETTED} SELECT rule_id, java AS pattern, reason IS NULL AS accepted, reason, self_test_passed,
    array_to_string(list_filter([
      CASE WHEN contains(pattern, '(?P<') THEN 'rewritten:named-groups' END,
      CASE WHEN contains(pattern, '(?P=') THEN 'rewritten:references' END,
      CASE WHEN operation = 'MASK' AND reason IS NULL AND len(refs) = 0
        THEN 'template-keeps-no-group' END,
      CASE WHEN len(missed) > 0 THEN concat('missed:', {_named('missed')}) END,
      CASE WHEN len(false_hits) > 0 THEN concat('false-hits:', {_named('false_hits')}) END
    ], lambda x: x IS NOT NULL), '; ') AS warnings FROM vetted""",
)
def linted(spark, sf_dir):
    """A rule per part, with its verdict."""
    out = lint_rules(rules_of_parts(spark, sf_dir))
    return out.select(
        "rule_id", "pattern", "accepted", "reason", "self_test_passed",
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query(
    "lint_rules_strict",
    f"""WITH {VETTED} SELECT operation, count(*) AS rules,
    count(*) FILTER (reason IS NULL AND self_test_passed IS NOT FALSE) AS accepted FROM vetted GROUP BY operation""",
)
def linted_strict(spark, sf_dir):
    out = lint_rules(rules_of_parts(spark, sf_dir), strict=True)
    return out.groupBy("operation").agg(
        F.count(F.lit(1)).alias("rules"), F.count_if("accepted").alias("accepted")
    )


# Patterns with the power of the length that a failing try may take (0: two to the power of it).
_POWERS = {r"\d+": 2, r"\w+\s*\w+!": 5, r"(?:[a-z]+-)+x": 3, r"(a+)b\1": 0, "abc": 1, r"[a-z]+@[a-z]+": 3}


def _long_examples(quote, kind: str) -> str:
    arrays = "list_value" if kind == "VARCHAR" else "array"
    return f"""CAST(p_partkey AS {kind}) AS rule_id, {choose(list(_POWERS), 'p_partkey', quote)} AS pattern, 'REPLACE' AS operation,
    false AS case_insensitive, {arrays}(concat('c', repeat('c', CAST(p_size * p_size AS INTEGER)))) AS should_not_match"""


@query(
    "lint_long_examples",
    f"""WITH rules AS (SELECT {_long_examples(text, 'VARCHAR')} FROM part),
    costs AS (SELECT rule_id, length(should_not_match[1]) AS size, CASE pattern
      {' '.join(f"WHEN {text(p)} THEN {n}" for p, n in _POWERS.items())} END AS power FROM rules)
    SELECT rule_id, CAST(late AS INTEGER) AS untested, CASE WHEN NOT late THEN true END AS self_test_passed
    FROM (SELECT rule_id, CASE WHEN power = 0 THEN size + 1 > 26 ELSE pow(size + 1, power) > 1e8 END AS late FROM costs)""",
)
def lint_long_examples(spark, sf_dir):
    """Examples of up to 2,501 characters; those on which a pattern might run long are not tried."""
    rules = derive(table(spark, sf_dir, "part"), _long_examples(spark_text, "STRING"))
    rules = rules.selectExpr("*", "CAST(NULL AS ARRAY<STRING>) AS should_match", "'' AS replacement_template", "0 AS `group`")
    return lint_rules(rules).select("rule_id", "untested", "self_test_passed")


@query(
    "rejections_by_reason",
    f"WITH {VETTED} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS rules FROM vetted GROUP BY 1",
)
def rejections(spark, sf_dir):
    out = lint_rules(rules_of_parts(spark, sf_dir))
    return out.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("rules"))


@query(
    "self_test_totals",
    f"""WITH {VETTED} SELECT count(*) FILTER (self_test_passed) AS passed,
    count(*) FILTER (NOT self_test_passed) AS failed, count(*) FILTER (self_test_passed IS NULL) AS untested,
    CAST(sum(len(missed)) AS BIGINT) AS missed_examples, CAST(sum(len(false_hits)) AS BIGINT) AS false_hits FROM vetted""",
)
def self_tests(spark, sf_dir):
    return self_test_totals(lint_rules(rules_of_parts(spark, sf_dir)))


@query(
    "group_counts",
    f"WITH {VETTED} SELECT rule_id, CAST(groups AS INTEGER) AS groups FROM counted",
)
def group_counts(spark, sf_dir):
    """Capturing groups of every pattern."""
    return rules_of_parts(spark, sf_dir).select("rule_id", group_count(to_java(F.col("pattern"))).alias("groups"))


@query(
    "effective_patterns",
    f"""WITH {VETTED} SELECT rule_id, CASE WHEN case_insensitive THEN concat('(?i)', pattern) ELSE pattern END AS pattern
    FROM rules""",
)
def effective_patterns(spark, sf_dir):
    rules = rules_of_parts(spark, sf_dir)
    return rules.select("rule_id", effective_pattern(F.col("pattern"), F.col("case_insensitive")).alias("pattern"))


# ---------------------------------------------------------------- words to patterns
WORDS = [
    "Find all  EMAIL addresses", "mask the Phone", "credit card", "social security no", "the ip address",
    "every website", "GUIDs", "birthday", "zip", "markup to drop", "extra spaces", "numeric cells", "price",
    "accent marks", "rows starting with \"{}\"", "cells ending in '{}'", "containing '{}' anywhere", "gibberish",
]


def _words(kind: str) -> str:
    where = "//" if kind == "VARCHAR" else "div"
    return f"""p_partkey, CASE WHEN p_partkey % 31 = 0 THEN 'DROP' ELSE {choose(OPS, f'(p_partkey {where} 18)')} END
    AS operation, replace({choose(WORDS, 'p_partkey')}, '{{}}', concat(p_brand, ' (', p_name, ')')) AS description"""


def _name_sql(cell: str) -> str:
    lines = []
    for known in CATALOGUE:
        tests = " OR ".join(f"contains({cell}, {text(w)})" for w in known.keywords)
        lines.append(f"WHEN {tests} THEN {text(known.name)}")
    return f"CASE {' '.join(lines)} END"


def _by_name(value) -> str:
    lines = [f"WHEN {text(k.name)} THEN {value(k)}" for k in CATALOGUE if value(k) is not None]
    return f"CASE name {' '.join(lines)} END" if lines else "NULL"


_SQUEEZED = r"trim(regexp_replace(lower(description), '\s+', ' ', 'g'))"
_QUOTED = """regexp_extract(words, '[''"]([^''"]{1,80})[''"]', 1)"""
_LITERAL = rf"""regexp_replace({_QUOTED}, '([()\[\]{{}}?*+\-|^$\\.&~#\s])', '\\\1', 'g')"""


@query(
    "suggested_rules",
    rf"""WITH asked AS (SELECT {_words('VARCHAR')} FROM part),
    squeezed AS (SELECT *, {_SQUEEZED} AS words FROM asked),
    named AS (SELECT *, {_name_sql('words')} AS name, CASE WHEN {_QUOTED} <> '' THEN
      CASE WHEN regexp_matches(words, 'start|begin|prefix') THEN concat('^', {_LITERAL})
        WHEN regexp_matches(words, 'end|suffix') THEN concat({_LITERAL}, '$') ELSE {_LITERAL} END END AS literal
      FROM squeezed),
    found AS (SELECT *, coalesce({_by_name(lambda k: text(k.pattern))}, literal) AS search,
      {_by_name(lambda k: text(k.mask[0]) if k.mask else None)} AS mask,
      {_by_name(lambda k: text(k.mask[1]) if k.mask else None)} AS template,
      {_by_name(lambda k: text(k.extract[0]) if k.extract else None)} AS extract,
      {_by_name(lambda k: str(k.extract[1]) if k.extract else None)} AS part_no,
      {_by_name(lambda k: text(k.validate) if k.validate else None)} AS valid FROM named)
    SELECT p_partkey, operation, CASE operation WHEN 'MASK' THEN mask WHEN 'EXTRACT' THEN coalesce(extract, search)
      WHEN 'VALIDATE' THEN coalesce(valid, concat('^', search, '$')) ELSE search END AS pattern,
    CASE WHEN operation = 'MASK' THEN template ELSE '' END AS replacement_template,
    CASE WHEN operation = 'EXTRACT' THEN coalesce(part_no, 0) ELSE 0 END AS group_no,
    CASE WHEN operation = 'DROP' THEN 'unsupported operation: DROP'
      WHEN search IS NULL THEN 'no pattern is known for this description'
      WHEN operation = 'MASK' AND mask IS NULL THEN 'no mask is known for this pattern' END AS reason FROM found""".replace(
        "concat('^', search, '$')", "'^' || search || '$'"
    ),
)
def suggested(spark, sf_dir):
    """A request in words per part, with the rule found for it."""
    asked = derive(table(spark, sf_dir, "part").drop("p_size"), _words("STRING"))
    out = suggest_rules(asked)
    return out.select(
        "p_partkey", "operation", "pattern", "replacement_template", F.col("group").alias("group_no"), "reason"
    )


@query("keyword_by_substring", f"SELECT doc_id, {_name_sql('lower(text)')} AS name FROM documents")
def keyword_by_substring(spark, sf_dir):
    """First catalogue entry with a keyword in the text, over whole documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", name_by_substring(F.lower("text")).alias("name"))


def _word_sql(cell: str) -> str:
    lines = []
    for known in CATALOGUE:
        tests = " OR ".join(f"contains({cell}, {text(f' {w.strip()} ')})" for w in known.keywords)
        lines.append(f"WHEN {tests} THEN {text(known.name)}")
    return f"CASE {' '.join(lines)} END"


@query(
    "keyword_by_words",
    rf"""WITH said AS (SELECT p_partkey, concat(' ', array_to_string(regexp_extract_all(lower(description),
      '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*'), ' '), ' ') AS words FROM (SELECT {_words('VARCHAR')} FROM part))
    SELECT p_partkey, {_word_sql('words')} AS name FROM said""",
)
def keyword_by_words(spark, sf_dir):
    """The same by whole words, as a join with the keyword table."""
    asked = derive(table(spark, sf_dir, "part"), _words("STRING"))
    return match_words(asked, keyword_table(spark), "p_partkey")


@query(
    "keyword_by_words_pages",
    rf"""WITH said AS (SELECT page_id, concat(' ', array_to_string(regexp_extract_all(lower(html),
      '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*'), ' '), ' ') AS words FROM pages)
    SELECT page_id, {_word_sql('words')} AS name FROM said""",
)
def keyword_by_words_pages(spark, sf_dir):
    """Whole pages against the keyword table."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("description"))
    return match_words(pages, keyword_table(spark), "page_id")


@query(
    "keyword_long_phrases",
    r"""WITH said AS (SELECT doc_id, concat(' ', array_to_string(regexp_extract_all(lower(text),
      '[\p{L}\p{N}][\p{L}\p{N}-]*'), ' '), ' ') AS words FROM documents),
    items AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}-]*')[:6], ' ') AS phrase
      FROM benchmark)
    SELECT doc_id, arg_min(concat('item ', item_id), item_id) AS name FROM said LEFT JOIN items
      ON contains(words, concat(' ', phrase, ' ')) GROUP BY doc_id""",
)
def keyword_long_phrases(spark, sf_dir):
    """Whole documents against keywords of six words, the beginnings of the benchmark items."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}-]*)"))
    phrases = table(spark, sf_dir, "benchmark").select(
        F.array_join(F.slice(words, 1, 6), " ").alias("phrase"),
        F.concat(F.lit("item "), "item_id").alias("name"),
        F.col("item_id").alias("priority"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"))
    return match_words(docs, phrases, "doc_id")


# ---------------------------------------------------------------- requests
def _requests(kind: str) -> str:
    arrays = "list_value" if kind == "VARCHAR" else "array"
    keys = ["raw/a.csv", " /raw/b.TSV ", "raw/../c.csv", "raw/d.txt", "raw/e.xlsx", "", "//f.parquet"]
    words = ["find emails", " ab ", "mask   phones", ""]
    return f"""o_orderkey, {choose(keys, 'o_orderkey')} AS source_key, '' AS sheet_name,
    {choose([*OPS, 'DROP'], 'o_custkey')} AS operation,
    CASE WHEN o_orderkey % 53 = 0 THEN repeat('w', 2001) ELSE {choose(words, 'o_orderkey')} END AS natural_language,
    CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderpriority END AS replacement_value,
    CASE o_orderkey % 4 WHEN 0 THEN {arrays}('Email', ' Email ', 'Notes') WHEN 1 THEN {arrays}(o_orderpriority)
      WHEN 2 THEN {arrays}('  ', o_orderstatus) ELSE CAST({arrays}() AS {'VARCHAR[]' if kind == 'VARCHAR' else 'array<string>'})
    END AS target_columns"""


@query(
    "request_gate",
    rf"""WITH asked AS (SELECT {_requests('VARCHAR')} FROM orders),
    clean AS (SELECT o_orderkey, operation, regexp_replace(trim(source_key), '^/+', '') AS source_key,
      trim(natural_language) AS natural_language, trim(replacement_value) AS replacement_value,
      list_transform(target_columns, lambda x: trim(x)) AS names FROM asked),
    judged AS (SELECT *, list_filter([
      CASE WHEN source_key = '' THEN 'source_key: may not be blank' END,
      CASE WHEN contains(source_key, '..') THEN 'source_key: invalid key' END,
      CASE WHEN source_key <> '' AND NOT regexp_matches(lower(source_key), '\.(csv|tsv|xlsx|xls|parquet)$')
        THEN 'source_key: unsupported file type' END,
      CASE WHEN operation = 'DROP' THEN 'operation: not one of the four kinds' END,
      CASE WHEN length(natural_language) < 3 THEN 'natural_language: fewer than 3 characters' END,
      CASE WHEN length(natural_language) > 2000 THEN 'natural_language: longer than 2000' END,
      CASE WHEN operation = 'REPLACE' AND replacement_value = '' THEN 'replacement_value: required for REPLACE' END,
      CASE WHEN len(list_filter(names, lambda x: x <> '')) = 0 THEN 'target_columns: none is named' END,
      CASE WHEN len(list_filter(names, lambda x: x = '')) > 0 THEN 'target_columns: a name is blank' END
    ], lambda x: x IS NOT NULL) AS problems FROM clean)
    SELECT o_orderkey, source_key, CASE o_orderkey % 4 WHEN 0 THEN 'Email,Notes'
      ELSE array_to_string(list_filter(names, lambda x: x <> ''), ',') END AS targets,
    array_to_string(problems, '; ') AS problems, len(problems) = 0 AS accepted FROM judged""",
)
def request_gate(spark, sf_dir):
    out = gate_requests(derive(table(spark, sf_dir, "orders"), _requests("STRING")))
    return out.select(
        "o_orderkey", "source_key", F.array_join("target_columns", ",").alias("targets"),
        F.array_join("problems", "; ").alias("problems"), "accepted",
    )


@query(
    "distinct_targets",
    """SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_transform(range(len(w)),
      lambda i: CASE WHEN list_position(w, w[i + 1]) = i + 1 THEN w[i + 1] END), lambda x: x IS NOT NULL), lambda x: x), '|') AS words
    FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)""",
)
def distinct_targets(spark, sf_dir):
    """Order-preserving distinct, over the words of whole turns."""
    said = table(spark, sf_dir, "conversations")
    words = distinct_texts(F.split("text", " "))
    return said.select("conv_id", "turn", F.array_join(words, "|").alias("words"))


@query(
    "normalised_descriptions",
    r"""SELECT doc_id, trim(regexp_replace(lower(text), '[\s\x0b]+', ' ', 'g')) AS words FROM documents""",
)
def normalised_descriptions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", squeeze(F.col("text")).alias("words"))


@query("url_extensions", r"SELECT page_id, lower(regexp_extract(url, '\.[^.]+$')) AS extension FROM pages")
def url_extensions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extension_of(F.col("url")).alias("extension"))


@query(
    "model_payloads",
    f"""SELECT c_custkey, concat('{{"operation":"', operation, '","user_description":"', description,
    '","target_columns":["c_name","', c_mktsegment, '"]',
    CASE WHEN c_custkey % 2 = 0 THEN concat(',"sample_values_from_those_columns":["', c_name, '"]') ELSE '' END,
    CASE WHEN operation = 'REPLACE' AND c_custkey % 3 > 0 THEN ',"literal_replacement_value":"x"' ELSE '' END, '}}')
    AS payload FROM (SELECT *, {choose(OPS, 'c_custkey')} AS operation, concat('find ', c_name) AS description FROM customer)""",
)
def model_payloads(spark, sf_dir):
    asked = derive(
        table(spark, sf_dir, "customer"),
        f"""c_custkey, {choose(OPS, 'c_custkey')} AS operation, concat('find ', c_name) AS description,
        array('c_name', c_mktsegment) AS columns,
        CASE WHEN c_custkey % 2 = 0 THEN array(c_name) ELSE array() END AS samples,
        CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' END AS replacement_value""",
    )
    return payloads(asked).select("c_custkey", "payload")


# ---------------------------------------------------------------- answers
def _answers(kind: str) -> str:
    number = f"CAST(event_id AS {kind})"
    return f"""event_id, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN concat('I would use /', event_type, '/')
    WHEN 2 THEN concat('```json', chr(10), '{{"pattern": " ', event_type, ' ", "confidence": "0.25", "group": ', {number},
      ', "should_match": ["a", 1, 2.5, true, null, ["x"], "b", "c", "d", "e", "f"]}}', chr(10), '```')
    WHEN 3 THEN concat('[', {number}, ']') WHEN 4 THEN '{{"confidence": 1}}'
    WHEN 5 THEN concat('  {{"pattern": "', event_type, '+", "confidence": ', {number}, ', "case_insensitive": 0, "group": "7x"}} ')
    WHEN 6 THEN concat('{{"pattern": "(', event_type, '+)+", "confidence": -1, "case_insensitive": "no", "explanation": " why "}}')
    WHEN 7 THEN concat('{{"pattern": "(', event_type, ')", "confidence": true, "case_insensitive": true, "group": 1.9, ',
      '"should_not_match": ["zzz"], "replacement_template": "$1"}}')
    ELSE '{{"pattern": 5}}' END AS answer"""


_PARSED = r"""
given AS (SELECT {answers} FROM events),
stripped AS (SELECT *, regexp_replace(answer, '^\s+|\s+$', '', 'g') AS bare FROM given),
unfenced AS (SELECT *, CASE WHEN starts_with(bare, '```')
  THEN regexp_replace(bare, '^```[a-zA-Z]*\s*|\s*```$', '', 'g') ELSE bare END AS body FROM stripped),
typed AS (SELECT *, CASE WHEN body <> '' AND json_valid(body) THEN json_type(body) END AS kind FROM unfenced),
judged AS (SELECT *, CASE WHEN body = '' THEN 'the answer is empty'
  WHEN kind IS NULL THEN concat('the answer is not JSON: ', substring(body, 1, 200))
  WHEN kind <> 'OBJECT' THEN 'the answer is not a JSON object'
  WHEN coalesce(json_type(body, '$.pattern'), '') <> 'VARCHAR' THEN 'the answer has no pattern' END AS reason FROM typed),
whole AS (SELECT *, CASE WHEN reason IS NULL THEN body ELSE '{}' END AS j FROM judged),
parsed AS (SELECT event_id, reason, trim(json_extract_string(j, '$.pattern')) AS pattern,
  coalesce(CASE json_type(j, '$.case_insensitive') WHEN 'BOOLEAN' THEN json_extract_string(j, '$.case_insensitive') = 'true'
    WHEN 'VARCHAR' THEN json_extract_string(j, '$.case_insensitive') <> ''
    ELSE CAST(json_extract_string(j, '$.case_insensitive') AS DOUBLE) <> 0 END, false) AS case_insensitive,
  trim(coalesce(json_extract_string(j, '$.explanation'), '')) AS explanation,
  greatest(0.0, least(1.0, coalesce(CASE json_type(j, '$.confidence') WHEN 'BOOLEAN' THEN 1.0
    ELSE TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END, 0.0)))::DOUBLE AS confidence,
  CASE WHEN json_extract(j, '$.should_match') IS NULL THEN '' ELSE 'a,1,2.5,True,b,c,d,e' END AS should_match,
  coalesce(json_extract_string(j, '$.replacement_template'), '') AS replacement_template,
  coalesce(CASE json_type(j, '$.group') WHEN 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.group') AS INTEGER)
    ELSE CAST(floor(CAST(json_extract_string(j, '$.group') AS DOUBLE)) AS INTEGER) END, 0) AS group_no FROM whole)"""
PARSED = _PARSED.replace("{answers}", _answers("VARCHAR"))


def answers_of_events(spark, sf_dir):
    return derive(table(spark, sf_dir, "events"), _answers("STRING"))


@query("parsed_answers", f"WITH {PARSED} SELECT * FROM parsed")
def parsed_answers(spark, sf_dir):
    """An answer per event, in every good and bad form."""
    out = parse_answers(answers_of_events(spark, sf_dir))
    return out.select(
        "event_id", "reason", "pattern", "case_insensitive", "explanation", "confidence",
        F.array_join("should_match", ",").alias("should_match"), "replacement_template",
        F.col("group").alias("group_no"),
    )


# ---------------------------------------------------------------- from requests to rules
NOW = "2024-01-15 00:00:00"
PROVIDER, MODEL = "batch", "m-1"


def _asked(kind: str) -> str:
    number = f"CAST(o_custkey AS {kind})"
    return f"""o_orderkey AS request_id, {choose(OPS, 'o_custkey')} AS operation,
    CASE o_orderkey % 3 WHEN 0 THEN concat('find code ', {number}) WHEN 1 THEN concat('Find  CODE ', {number})
      ELSE concat(' FIND code ', {number}, ' ') END AS description, o_orderkey % 10 = 0 AS force_refresh"""


def _key_sql(operation: str, words: str) -> str:
    return f"concat('llm:regex:', sha256(concat('v3|{PROVIDER}|{MODEL}|', {operation}, '|', {words})))"


def requests_of_orders(spark, sf_dir):
    return keyed(derive(table(spark, sf_dir, "orders"), _asked("STRING")), PROVIDER, MODEL)


def _coded(spark, sf_dir, name, key):
    """Key, operation and code of one request per row of a table."""
    made = derive(
        table(spark, sf_dir, name),
        f"{key} AS code, {choose(OPS, key)} AS operation, concat('find code ', CAST({key} AS STRING)) AS description",
    )
    return keyed(made, PROVIDER, MODEL)


def _rule_struct(pattern):
    filler = {
        "pattern": pattern,
        "case_insensitive": F.lit(False),
        "explanation": F.lit(""),
        "confidence": F.lit(0.5),
        "should_match": F.array().cast("array<string>"),
        "should_not_match": F.array().cast("array<string>"),
        "replacement_template": F.lit("$0"),
        "group": F.lit(0),
        "warnings": F.array().cast("array<string>"),
        "self_test_passed": F.lit(None).cast("boolean"),
    }
    return F.struct(*[filler[f].alias(f) for f in RULE_FIELDS])


def memory_of_parts(spark, sf_dir):
    """Two entries per part for one part in three, of different ages."""
    coded = _coded(spark, sf_dir, "part", "p_partkey").where("code % 3 = 0")
    day = 86_400_000_000
    stored = lambda n: F.expr(
        f"timestamp_micros(unix_micros(timestamp'{NOW}') - ((code * {n}) % 15) * {day})"
    )
    entry = lambda n: coded.select(
        "key", _rule_struct(F.format_string(f"%d-v{n}", "code")).alias("rule"), stored(n).alias("stored_at")
    )
    return entry(1).unionByName(entry(7))


MEMORY = f"""
entries AS (SELECT p_partkey AS code, {choose(OPS, 'p_partkey')} AS operation,
  concat(p_partkey, '-v', n) AS pattern, (p_partkey * n) % 15 AS age FROM part, (VALUES (1), (7)) AS v(n)
  WHERE p_partkey % 3 = 0),
live AS (SELECT code, {_key_sql('operation', "concat('find code ', code)")} AS key,
  max(struct_pack(newer := -age, rule := pattern)).rule AS pattern, min(age) AS age
  FROM entries WHERE age <= 7 GROUP BY code, operation)"""
ASKED = f"""
asked AS (SELECT {_asked('VARCHAR')}, o_custkey AS code FROM orders),
keyed AS (SELECT *, {_key_sql('operation', _SQUEEZED)} AS key FROM asked)"""


@query("request_keys", f"WITH {ASKED} SELECT request_id, key FROM keyed")
def request_keys(spark, sf_dir):
    return requests_of_orders(spark, sf_dir).select("request_id", "key")


@query("live_entries", f"WITH {MEMORY} SELECT key, pattern, age AS age_days FROM live")
def live_memory(spark, sf_dir):
    """Remembered rules that have not expired, the newest of each key."""
    now = F.lit(NOW).cast("timestamp")
    live = live_entries(memory_of_parts(spark, sf_dir), now)
    age = F.expr("(unix_micros(timestamp'2024-01-15 00:00:00') - unix_micros(stored_at)) div 86400000000")
    return live.select("key", F.col("rule.pattern").alias("pattern"), age.alias("age_days"))


def _live(spark, sf_dir):
    return live_entries(memory_of_parts(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(
    "remembered_requests",
    f"""WITH {ASKED}, {MEMORY} SELECT request_id, live.pattern FROM keyed JOIN live USING (key) WHERE NOT force_refresh""",
)
def remembered_requests(spark, sf_dir):
    """Requests answered from memory."""
    hits = hits_of(requests_of_orders(spark, sf_dir), _live(spark, sf_dir))
    return hits.select("request_id", F.col("rule.pattern").alias("pattern"))


@query(
    "keys_to_ask",
    f"""WITH {ASKED}, {MEMORY} SELECT DISTINCT keyed.key, operation FROM keyed
    WHERE force_refresh OR key NOT IN (SELECT key FROM live)""",
)
def asked_keys(spark, sf_dir):
    """What a model must still be asked, once per key."""
    return keys_to_ask(requests_of_orders(spark, sf_dir), _live(spark, sf_dir)).select("key", "operation")


def answers_of_customers(spark, sf_dir):
    """Answers by the customer's number: good, repaired, to repair, unreadable, refused; none for the sixth."""
    coded = _coded(spark, sf_dir, "customer", "c_custkey").where("code % 6 < 5")
    good = """concat('{"pattern": "c', CAST(code AS STRING), '(x)", "replacement_template": "$1", "confidence": 0.9}')"""
    unsafe = """concat('{"pattern": "(c', CAST(code AS STRING), '+)+", "replacement_template": "$1"}')"""
    first = coded.withColumn("attempt", F.lit(1)).withColumn(
        "answer", F.expr(f"CASE code % 6 WHEN 0 THEN {good} WHEN 3 THEN 'no idea' ELSE {unsafe} END")
    )
    second = coded.where("code % 6 IN (1, 4)").withColumn("attempt", F.lit(2)).withColumn(
        "answer", F.expr(f"CASE code % 6 WHEN 1 THEN {good} ELSE {unsafe} END")
    )
    return first.unionByName(second)


VERDICTS = f"""
verdicts AS (SELECT {_key_sql('operation', "concat('find code ', code)")} AS key, code,
  CASE code % 6 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'ACCEPTED' WHEN 2 THEN 'REPAIR' WHEN 3 THEN 'UNREADABLE'
    ELSE 'REJECTED' END AS status,
  CASE WHEN code % 6 < 2 THEN concat('c', code, '(x)') END AS fresh,
  CASE code % 6 WHEN 3 THEN 'the answer is not JSON: no idea' WHEN 2 THEN 'runaway:nested-repeat'
    WHEN 4 THEN 'runaway:nested-repeat' END AS reason,
  CASE WHEN code % 6 IN (1, 4) THEN 2 ELSE 1 END AS attempts
  FROM (SELECT c_custkey AS code, {choose(OPS, 'c_custkey')} AS operation FROM customer) WHERE code % 6 < 5)"""


@query("judged_answers", f"WITH {VERDICTS} SELECT key, status, fresh AS pattern, reason, attempts FROM verdicts")
def judged(spark, sf_dir):
    verdicts = judge_answers(answers_of_customers(spark, sf_dir))
    return verdicts.select("key", "status", F.col("rule.pattern").alias("pattern"), "reason", "attempts")


@query(
    "repairs_to_ask",
    f"""WITH {ASKED}, {MEMORY}, {VERDICTS} SELECT DISTINCT keyed.key, operation, reason AS hint
    FROM keyed JOIN verdicts v ON v.key = keyed.key AND status = 'REPAIR'
    WHERE force_refresh OR keyed.key NOT IN (SELECT key FROM live)""",
)
def repairs(spark, sf_dir):
    """Requests whose answer was refused once, with what was wrong."""
    asked = keys_to_ask(requests_of_orders(spark, sf_dir), _live(spark, sf_dir))
    again = repairs_to_ask(asked, judge_answers(answers_of_customers(spark, sf_dir)))
    return again.select("key", "operation", "hint")


RESOLVED = f"""
joined AS (SELECT k.*, live.pattern AS kept, v.status AS verdict, fresh, reason, attempts,
  NOT force_refresh AND live.pattern IS NOT NULL AS was_cached
  FROM keyed k LEFT JOIN live USING (key) LEFT JOIN verdicts v ON v.key = k.key),
resolved AS (SELECT request_id, key, CASE WHEN was_cached THEN 'HIT' ELSE coalesce(verdict, 'ASK') END AS status,
  CASE WHEN was_cached THEN kept ELSE fresh END AS pattern, CASE WHEN NOT was_cached THEN reason END AS reason,
  CASE WHEN was_cached THEN 0 ELSE coalesce(attempts, 0) END AS attempts, was_cached FROM joined)"""


def _resolved(spark, sf_dir):
    verdicts = judge_answers(answers_of_customers(spark, sf_dir))
    return resolve(requests_of_orders(spark, sf_dir), _live(spark, sf_dir), verdicts)


@query("resolved_requests", f"WITH {ASKED}, {MEMORY}, {VERDICTS}, {RESOLVED} SELECT * EXCLUDE (key) FROM resolved")
def resolved_requests(spark, sf_dir):
    """Every request with its rule, or what it still lacks."""
    out = _resolved(spark, sf_dir)
    return out.select(
        "request_id", "status", F.col("rule.pattern").alias("pattern"), "reason", "attempts", "was_cached"
    )


@query(
    "reuse_stats",
    f"""WITH {ASKED}, {MEMORY}, {VERDICTS}, {RESOLVED} SELECT count(*) FILTER (was_cached) AS cache_hits,
    count(*) FILTER (NOT was_cached) AS cache_misses,
    (SELECT CAST(sum(calls) AS BIGINT) FROM (SELECT max(attempts) AS calls FROM resolved GROUP BY key)) AS provider_calls,
    round_even(100.0 * count(*) FILTER (was_cached) / count(*), 1) AS hit_rate_percent FROM resolved""",
)
def stats(spark, sf_dir):
    return reuse_stats(_resolved(spark, sf_dir))


@query(
    "remembered_after",
    f"""WITH {MEMORY}, {VERDICTS}, latest AS (SELECT {_key_sql('operation', "concat('find code ', code)")} AS key,
      max(struct_pack(newer := -age, rule := pattern)).rule AS pattern
      FROM entries GROUP BY code, operation)
    SELECT coalesce(v.key, latest.key) AS key, coalesce(v.fresh, latest.pattern) AS pattern
    FROM latest FULL JOIN (SELECT * FROM verdicts WHERE status = 'ACCEPTED') v ON v.key = latest.key""",
)
def remembered_after(spark, sf_dir):
    """Memory with the newly accepted rules in it."""
    verdicts = judge_answers(answers_of_customers(spark, sf_dir))
    now = F.lit("2024-01-15 00:00:01").cast("timestamp")
    kept = remember(memory_of_parts(spark, sf_dir), verdicts, now)
    return kept.select("key", F.col("rule.pattern").alias("pattern"))
