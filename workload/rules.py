"""Queries of the four rule kinds over the text tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright import (
    EXTRACT,
    MASK,
    VALIDATE,
    RuleError,
    TextRule,
    apply_rule,
    apply_rules,
    catalogue_rules,
    column_counts,
    known_rule,
    profile,
)
from rulewright.functions.text import column
from rulewright.rule import REPLACE, rules_table
from rulewright.operators.results import affected_rows, invalid_rows, totals
from rulewright.operators.rulebook import BY_NAME, CATALOGUE
from rulewright.operators.shape import derive_hints
from rulewright.operators.transform import found_in, hide_internal
from workload.registry import choose, derive, query, table, text

EMAIL, PHONE, CARD = BY_NAME["email"], BY_NAME["phone"], BY_NAME["card"]
IPV4, DIGITS, TAG, URL = BY_NAME["ipv4"], BY_NAME["digits"], BY_NAME["tag"], BY_NAME["url"]
FOUND = "CAST(regexp_matches({}, {}) AS INTEGER)"


def found(cell: str, pattern: str) -> str:
    return FOUND.format(cell, text(pattern))


def counter(frame):
    """Show the row counter under a name that does not hide it."""
    return frame.withColumnRenamed("__matched", "matched")


@query(
    "replace_email",
    f"""SELECT doc_id, regexp_replace(text, {text(EMAIL.pattern)}, 'REDACTED', 'g') AS text,
    {found('text', EMAIL.pattern)} AS matched FROM documents""",
)
def replace_email(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counter(apply_rule(docs, known_rule("email"), ["text"], "REDACTED").frame)


@query(
    "replace_phone",
    f"""SELECT doc_id, regexp_replace(text, {text(PHONE.pattern)}, '<phone>', 'g') AS text,
    {found('text', PHONE.pattern)} AS matched FROM documents""",
)
def replace_phone(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counter(apply_rule(docs, known_rule("phone"), ["text"], "<phone>").frame)


@query(
    "replace_tags",
    f"""SELECT page_id, regexp_replace(html, {text(TAG.pattern)}, '', 'g') AS html,
    {found('html', TAG.pattern)} AS matched FROM pages""",
)
def replace_tags(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return counter(apply_rule(pages, known_rule("tag"), ["html"], "").frame)


@query(
    "replace_non_ascii",
    r"""SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]+', '?', 'g') AS text,
    CAST(regexp_matches(text, '[^\x00-\x7F]+') AS INTEGER) AS matched FROM conversations""",
)
def replace_non_ascii(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return counter(apply_rule(said, known_rule("non_ascii"), ["text"], "?").frame)


@query(
    "replace_whitespace",
    r"""SELECT doc_id, regexp_replace(text, '\s{2,}', ' ', 'g') AS text,
    CAST(regexp_matches(text, '\s{2,}') AS INTEGER) AS matched FROM documents""",
)
def replace_whitespace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counter(apply_rule(docs, known_rule("whitespace"), ["text"], " ").frame)


@query(
    "replace_literal_value",
    r"""SELECT c_custkey, regexp_replace(c_name, '([0-9]+)', '$1\\x', 'g') AS c_name,
    CAST(regexp_matches(c_name, '[0-9]+') AS INTEGER) AS matched FROM customer""",
)
def replace_literal_value(spark, sf_dir):
    """The value holds a dollar sign and a backslash; both are written as they are."""
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return counter(apply_rule(people, TextRule("([0-9]+)"), ["c_name"], "$1\\x").frame)


@query(
    "replace_with_references",
    r"""SELECT c_custkey, regexp_replace(c_name, '#0*([0-9]+)', ' no. \1', 'g') AS c_name,
    CAST(regexp_matches(c_name, '#0*[0-9]+') AS INTEGER) AS matched FROM customer""",
)
def replace_with_references(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rule = TextRule("#0*([0-9]+)")
    return counter(apply_rule(people, rule, ["c_name"], " no. $1", raw_template=True).frame)


@query(
    "mask_email",
    f"""SELECT doc_id, regexp_replace(text, {text(EMAIL.mask[0])}, '\\1***\\2', 'g') AS text,
    {found('text', EMAIL.mask[0])} AS matched FROM documents""",
)
def mask_email(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counter(apply_rule(docs, known_rule("email", MASK), ["text"]).frame)


@query(
    "mask_card",
    f"""SELECT doc_id, regexp_replace(text, {text(CARD.mask[0])}, '**** **** **** \\1', 'g') AS text,
    {found('text', CARD.mask[0])} AS matched FROM documents""",
)
def mask_card(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counter(apply_rule(docs, known_rule("card", MASK), ["text"]).frame)


@query(
    "mask_address",
    f"""SELECT doc_id, regexp_replace(text, {text(IPV4.mask[0])}, '\\1.x.x', 'g') AS text,
    {found('text', IPV4.mask[0])} AS matched FROM documents""",
)
def mask_address(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counter(apply_rule(docs, known_rule("ipv4", MASK), ["text"]).frame)


@query(
    "mask_url",
    f"""SELECT page_id, regexp_replace(url, {text(URL.mask[0])}, '\\1/***', 'g') AS url,
    {found('url', URL.mask[0])} AS matched FROM pages""",
)
def mask_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return counter(apply_rule(pages, known_rule("url", MASK), ["url"]).frame)


@query(
    "extract_mail_domain",
    f"""SELECT doc_id, text, regexp_extract(text, {text(EMAIL.extract[0])}, 1) AS text_extracted,
    {found('text', EMAIL.extract[0])} AS matched FROM documents""",
)
def extract_mail_domain(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return counter(apply_rule(docs, known_rule("email", EXTRACT), ["text"]).frame)


@query(
    "extract_url_host",
    f"""SELECT page_id, url, regexp_extract(url, {text(URL.extract[0])}, 1) AS url_extracted,
    {found('url', URL.extract[0])} AS matched FROM pages""",
)
def extract_url_host(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return counter(apply_rule(pages, known_rule("url", EXTRACT), ["url"]).frame)


@query(
    "extract_whole_match",
    r"""SELECT s_suppkey, s_name, regexp_extract(s_name, '[1-9][0-9]*', 0) AS s_name_extracted,
    CAST(regexp_matches(s_name, '[1-9][0-9]*') AS INTEGER) AS matched FROM supplier""",
)
def extract_whole_match(spark, sf_dir):
    makers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    rule = TextRule("[1-9][0-9]*", EXTRACT, group=0)
    return counter(apply_rule(makers, rule, ["s_name"]).frame)


@query(
    "extract_optional_group",
    r"""SELECT o_orderkey, o_orderpriority,
    coalesce(regexp_extract(o_orderpriority, '^([1-2])?[-0-9]*[A-Z]', 1), '') AS o_orderpriority_extracted,
    CAST(regexp_matches(o_orderpriority, '^([1-2])?[-0-9]*[A-Z]') AS INTEGER) AS matched FROM orders""",
)
def extract_optional_group(spark, sf_dir):
    """The group takes no part in some matches, which gives the empty string."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rule = TextRule("^([1-2])?[-0-9]*[A-Z]", EXTRACT, group=1)
    return counter(apply_rule(orders, rule, ["o_orderpriority"]).frame)


@query(
    "validate_priority",
    r"""SELECT o_orderkey, o_orderpriority,
    regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$') AS o_orderpriority_valid,
    CAST(NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$') AS INTEGER) AS matched FROM orders""",
)
def validate_priority(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    rule = TextRule("^[1-3]-[A-Z]+$", VALIDATE)
    return counter(apply_rule(orders, rule, ["o_orderpriority"]).frame)


@query(
    "validate_ascii",
    r"""SELECT conv_id, turn, regexp_matches(text, '^[\x00-\x7F]*\z') AS text_valid,
    CAST(NOT regexp_matches(text, '^[\x00-\x7F]*\z') AS INTEGER) AS matched FROM conversations""",
)
def validate_ascii(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    rule = TextRule(r"^[\x00-\x7F]*\z", VALIDATE)
    return counter(apply_rule(said, rule, ["text"]).frame.drop("text"))


@query(
    "several_targets",
    f"""SELECT page_id, regexp_replace(url, '\\d+', '0', 'g') AS url,
    regexp_replace(html, '\\d+', '0', 'g') AS html,
    {found('url', DIGITS.pattern)} + {found('html', DIGITS.pattern)} AS matched FROM pages""",
)
def several_targets(spark, sf_dir):
    """Wanted names differ in case, carry blanks and repeat."""
    pages = table(spark, sf_dir, "pages")
    return counter(apply_rule(pages, known_rule("digits"), [" HTML ", "Url", "html"], "0").frame)


NULLED = "CASE WHEN lang <> 'en' THEN text END"


@query(
    "null_cells_replace",
    f"""SELECT doc_id, regexp_replace({NULLED}, '^[0-9]*', '#', 'g') AS cell, 1 AS matched FROM documents""",
)
def null_cells_replace(spark, sf_dir):
    """The rule also matches the empty string: NULL cells are counted and stay NULL."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{NULLED} AS cell")
    return counter(apply_rule(docs, TextRule("^[0-9]*"), ["cell"], "#").frame)


@query(
    "null_cells_validate",
    f"""SELECT doc_id, regexp_matches(coalesce({NULLED}, ''), '[a-z]') AS cell_valid,
    CAST(NOT regexp_matches(coalesce({NULLED}, ''), '[a-z]') AS INTEGER) AS matched FROM documents""",
)
def null_cells_validate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{NULLED} AS cell")
    return counter(apply_rule(docs, TextRule("[a-z]", VALIDATE), ["cell"]).frame.drop("cell"))


@query(
    "null_cells_extract",
    f"""SELECT doc_id, regexp_extract(coalesce({NULLED}, ''), '[a-z]+', 0) AS cell_extracted,
    CAST(regexp_matches(coalesce({NULLED}, ''), '[a-z]+') AS INTEGER) AS matched FROM documents""",
)
def null_cells_extract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{NULLED} AS cell")
    return counter(apply_rule(docs, TextRule("[a-z]+", EXTRACT), ["cell"]).frame.drop("cell"))


@query(
    "number_cells",
    r"""SELECT regexp_replace(CAST(l_orderkey AS VARCHAR), '[13579]', 'o', 'g') AS l_orderkey, l_linenumber,
    l_shipdate, CAST(regexp_matches(CAST(l_orderkey AS VARCHAR), '[13579]') AS INTEGER) AS matched
    FROM lineitem""",
)
def number_cells(spark, sf_dir):
    """A target that is not text becomes text; the other columns keep their types."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return counter(apply_rule(lines, TextRule("[13579]"), ["l_orderkey"], "o").frame)


@query(
    "ignore_case",
    r"""SELECT p_partkey, regexp_replace(p_type, '(?i)e[a-z]o', '_', 'g') AS p_type,
    CAST(regexp_matches(p_type, '(?i)e[a-z]o') AS INTEGER) AS matched FROM part""",
)
def ignore_case(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    rule = TextRule("e[a-z]o", case_insensitive=True)
    return counter(apply_rule(parts, rule, ["p_type"], "_").frame)


@query(
    "taken_names",
    r"""SELECT p_partkey, p_brand, 'kept' AS "P_BRAND_EXTRACTED",
    regexp_extract(p_brand, '#(\d)', 1) AS p_brand_extracted_2,
    CAST(regexp_matches(p_brand, '#(\d)') AS INTEGER) AS matched FROM part""",
)
def taken_names(spark, sf_dir):
    """The usual name of the new column is taken, in another case."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lit("kept").alias("P_BRAND_EXTRACTED"))
    return counter(apply_rule(parts, TextRule(r"#(\d)", EXTRACT, group=1), ["p_brand"]).frame)


@query(
    "odd_names",
    r"""SELECT p_partkey, regexp_replace(p_name, ' ', '_', 'g') AS "Part Name.Full",
    regexp_replace(p_type, '[AEIOU]', '', 'g') AS "a`b" FROM part""",
)
def odd_names(spark, sf_dir):
    """Column names with blanks, dots and back-ticks; the counter is hidden."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("Part Name.Full"), F.col("p_type").alias("a`b")
    )
    one = apply_rule(parts, TextRule(" "), ["part name.full"], "_").frame
    two = apply_rule(hide_internal(one), TextRule("[AEIOU]"), ["A`B"], "").frame
    return hide_internal(two)


@query(
    "rule_found",
    f"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, {text(CARD.pattern)})",
)
def rule_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(found_in(column("text"), known_rule("card"))).select("doc_id", "lang")


@query(
    "rule_not_found",
    f"SELECT doc_id, lang FROM documents WHERE NOT regexp_matches(text, {text(DIGITS.pattern)})",
)
def rule_not_found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where(~found_in(column("text"), known_rule("digits"))).select("doc_id", "lang")


@query(
    "affected_rows",
    f"""SELECT doc_id, regexp_replace(text, {text(IPV4.pattern)}, '0.0.0.0', 'g') AS text FROM documents
    WHERE regexp_matches(text, {text(IPV4.pattern)})""",
)
def affected(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    outcome = apply_rule(docs, known_rule("ipv4"), ["text"], "0.0.0.0")
    return hide_internal(affected_rows(outcome.frame))


@query(
    "invalid_rows",
    """SELECT page_id, url, regexp_matches(url, '^http://') AS url_valid FROM pages
    WHERE NOT regexp_matches(url, '^http://')""",
)
def invalid(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcome = apply_rule(pages, TextRule("^http://", VALIDATE), ["url"])
    return hide_internal(invalid_rows(outcome.frame, outcome.added_columns))


@query(
    "run_totals",
    f"""SELECT count(*) AS total_rows,
    CAST(sum({found('text', EMAIL.pattern)} + {found('source', EMAIL.pattern)}) AS BIGINT) AS matched_cells
    FROM documents""",
)
def run_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return totals(apply_rule(docs, known_rule("email"), ["text", "source"], "x").frame)


@query(
    "run_totals_by_source",
    f"""SELECT source, lang, count(*) AS total_rows,
    CAST(sum({found('text', EMAIL.pattern)}) AS BIGINT) AS matched_cells
    FROM documents GROUP BY source, lang""",
)
def run_totals_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    frame = apply_rule(docs, known_rule("email"), ["text"], "x").frame
    return frame.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum("__matched").alias("matched_cells")
    )


@query(
    "column_counts",
    f"""SELECT column_name, CAST(sum(hit) AS BIGINT) AS affected_cells, count(*) AS total_rows,
    round(sum(hit) / count(*), 4) AS rate FROM (
      SELECT 'url' AS column_name, {found('url', DIGITS.pattern)} AS hit FROM pages
      UNION ALL SELECT 'html', {found('html', DIGITS.pattern)} FROM pages)
    GROUP BY column_name""",
)
def columns_counted(spark, sf_dir):
    return column_counts(table(spark, sf_dir, "pages"), known_rule("digits"), ["url", "html"])


def _profile_sql(source: str, cells: list[str]) -> str:
    parts = []
    for known in CATALOGUE:
        hits = [found(c, known.pattern) for c in cells]
        anywhere = f"greatest({', '.join(hits)})"
        for cell, hit in zip(cells, hits):
            parts.append(
                f"""SELECT {text(known.name)} AS rule_id, {text(cell)} AS column_name,
                CAST(sum({hit}) AS BIGINT) AS affected_cells, CAST(sum({anywhere}) AS BIGINT) AS affected_rows,
                count(*) AS total_rows, round(sum({hit}) / count(*), 4) AS rate FROM {source}"""
            )
    return " UNION ALL ".join(parts)


@query("profile_documents", _profile_sql("documents", ["text", "lang", "source"]))
def profile_documents(spark, sf_dir):
    """Every catalogue rule against every text column, in one scan."""
    return profile(table(spark, sf_dir, "documents"), catalogue_rules(), ["text", "lang", "source"])


@query("profile_pages", _profile_sql("pages", ["url", "html"]))
def profile_pages(spark, sf_dir):
    return profile(table(spark, sf_dir, "pages"), catalogue_rules(), ["url", "html"])


@query(
    "rule_steps",
    """SELECT step, operation, pattern, targets, outputs, (SELECT count(*) FROM documents WHERE regexp_matches(text, '\\d')) AS affected
    FROM (VALUES (1, 'REPLACE', '\\d+', 'text', 'text'), (2, 'EXTRACT', '(?i)n', 'lang,source', 'lang_extracted,source_extracted'),
      (3, 'VALIDATE', '^N', 'text', 'text_valid')) AS v(step, operation, pattern, targets, outputs)""",
)
def rule_steps(spark, sf_dir):
    """What each rule of a sequence says it did, next to the cells that the first affected."""
    docs = table(spark, sf_dir, "documents").select("text", "lang", "source")
    rules = [
        (TextRule(r"\d+"), [" Text "], "N"), (TextRule("n", EXTRACT, case_insensitive=True), ["LANG", "source", "lang"], ""), (TextRule("^N", VALIDATE), ["text"], ""),
    ]
    outcome = apply_rules(docs, rules)
    told = [(k, s.operation, s.pattern, ",".join(s.targets), ",".join(s.outputs)) for k, s in enumerate(outcome.steps, 1)]
    steps = spark.createDataFrame(told, "step int, operation string, pattern string, targets string, outputs string")
    return steps.withColumn("affected", outcome.frame.agg(F.sum("__matched_1")).scalar())


_KINDS = ["REPLACE", "MASK", "EXTRACT", "VALIDATE", "DROP", "replace", ""]


@query(
    "unsupported_kinds",
    f"""WITH asked AS (SELECT {choose(_KINDS, "c_custkey")} AS operation FROM customer)
    SELECT operation, count(*) AS requests, CASE WHEN operation IN ('REPLACE', 'MASK', 'EXTRACT', 'VALIDATE') THEN NULL
      ELSE concat('unsupported operation: ', operation) END AS refusal FROM asked GROUP BY operation""",
)
def unsupported_kinds(spark, sf_dir):
    """Every kind that the customers ask for, how many do, and whether a rule of it is refused."""
    customers = table(spark, sf_dir, "customer")
    asked = derive(customers, f"{choose(_KINDS, 'c_custkey')} AS operation").groupBy("operation").agg(F.count(F.lit(1)).alias("requests"))

    def refusal(kind: str) -> str | None:
        try:
            apply_rule(customers, TextRule("a", kind, replacement_template="b"), ["c_name"], "x")
        except RuleError as problem:
            return str(problem)
        return None

    # A row per kind, of which the list above has seven.
    told = [(kind, refusal(kind)) for kind in _KINDS]
    return asked.join(spark.createDataFrame(told, "operation string, refusal string"), "operation").select("operation", "requests", "refusal")


@query("profile_derived_hints", _profile_sql("documents", ["text"]))
def profile_derived_hints(spark, sf_dir):
    """Catalogue rules whose literals come from the patterns alone; the counts are those without any."""
    bare = rules_table(spark, catalogue_rules()).drop("requires")
    rules = [TextRule.from_row(r) for r in derive_hints(bare).collect()]
    return profile(table(spark, sf_dir, "documents"), rules, ["text"])


@query("profile_conversations", _profile_sql("conversations", ["role", "text"]))
def profile_conversations(spark, sf_dir):
    return profile(table(spark, sf_dir, "conversations"), catalogue_rules(), ["role", "text"])


# A ticket per order: one form of every kind of data the catalogue knows, by the order's number.
_FORMS = [
    "concat('mail c', n, '@mail', m, '.example.org')", "concat('call +49 30 ', 1000 + m % 9000, ' ', 5000 + m % 5000)",
    "concat('card 4000 ', 1000 + m % 9000, ' 5678 ', 1000 + n % 9000)", "concat(100 + m % 900, '-', 10 + m % 90, '-', 1000 + n % 9000)",
    "concat('10.', m % 256, '.', n % 256, '.7')", "concat('https://h', m, '.example.net/p', n)",
    "concat(left(md5(CAST(n AS {text})), 8), '-0000-4000-8000-', right(md5(CAST(n AS {text})), 12))",
    "concat('2024-', 10 + m % 3, '-', 10 + n % 18)", "CAST(10000 + m % 90000 AS {text})", "concat('<b class=x>', n, '</b>')",
    "concat('two  blanks ', n)", "CAST(n AS {text})", "concat('$', 1 + n % 9, '.50')", "concat('caf\u00e9 ', n)", "'plain words'",
]
_TICKETS = f"""o_orderkey AS id, {choose([f'@{i}' for i in range(len(_FORMS))], 'o_orderkey', lambda w: _FORMS[int(w[1:])])} AS body,
    {choose([f'@{i}' for i in range(len(_FORMS))], 'o_custkey', lambda w: _FORMS[int(w[1:])])} AS note"""
_VARIANTS = (REPLACE, MASK, EXTRACT, VALIDATE)


def _tickets(kind: str) -> str:
    return _TICKETS.replace("{text}", kind)


def _variant_sql(operation: str) -> str:
    parts = []
    for known in CATALOGUE:
        if operation == MASK and not known.mask:
            continue
        rule = known_rule(known.name, operation)
        hits = [found(c, rule.pattern) if operation != VALIDATE else f"(1 - {found(c, rule.pattern)})" for c in ("body", "note")]
        for cell, hit in zip(("body", "note"), hits):
            parts.append(
                f"SELECT '{operation}' AS operation, {text(known.name)} AS rule_id, '{cell}' AS column_name, "
                f"CAST(sum({hit}) AS BIGINT) AS affected_cells, CAST(sum(greatest({hits[0]}, {hits[1]})) AS BIGINT) AS affected_rows FROM tickets"
            )
    return " UNION ALL ".join(parts)


@query(
    "profile_tickets",
    f"""WITH tickets AS (SELECT {_tickets('VARCHAR')} FROM (SELECT *, o_orderkey AS n, o_custkey AS m FROM orders))
    {" UNION ALL ".join(_variant_sql(o) for o in _VARIANTS)}""",
)
def profile_tickets(spark, sf_dir):
    """Every catalogue rule in every variant over cells that hold all the kinds of data they look for."""
    orders = table(spark, sf_dir, "orders").selectExpr("*", "o_orderkey AS n", "o_custkey AS m")
    tickets = derive(orders, _tickets("STRING"))
    parts = [
        profile(tickets, catalogue_rules(o), ["body", "note"]).select(
            F.lit(o).alias("operation"), "rule_id", "column_name", "affected_cells", "affected_rows"
        )
        for o in _VARIANTS
    ]
    return reduce(DataFrame.unionByName, parts)


_ONE = f"regexp_replace(text, {text(EMAIL.pattern)}, 'user 1', 'g')"
_TWO = f"regexp_replace({_ONE}, {text(CARD.mask[0])}, '**** **** **** \\1', 'g')"


@query(
    "rules_in_sequence",
    f"""SELECT doc_id, regexp_replace({_TWO}, '\\d+', '0', 'g') AS text,
    regexp_extract({_TWO}, '\\d+', 0) AS text_extracted,
    {found('text', EMAIL.pattern)} AS matched_1, {found(_ONE, CARD.mask[0])} AS matched_2,
    {found(_TWO, DIGITS.pattern)} AS matched_3, {found(_TWO, DIGITS.pattern)} AS matched_4,
    {found('text', EMAIL.pattern)} + {found(_ONE, CARD.mask[0])} + 2 * {found(_TWO, DIGITS.pattern)} AS matched
    FROM documents""",
)
def rules_in_sequence(spark, sf_dir):
    """Each rule sees what the one before left; every step keeps its own counter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    steps = [
        (known_rule("email"), ["text"], "user 1"),
        (known_rule("card", MASK), ["text"], ""),
        (known_rule("digits", EXTRACT), ["text"], ""),
        (known_rule("digits"), ["text"], "0"),
    ]
    frame = counter(apply_rules(docs, steps).frame)
    return frame.withColumnsRenamed({f"__matched_{k}": f"matched_{k}" for k in range(1, 5)})


@query(
    "affected_labelled",
    f"""SELECT d.doc_id, quality, toxic FROM labels d JOIN documents USING (doc_id)
    WHERE regexp_matches(text, {text(PHONE.pattern)})""",
)
def affected_labelled(spark, sf_dir):
    """Labels of the documents a rule affects; doc_id is unique on both sides."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = affected_rows(apply_rule(docs, known_rule("phone"), ["text"], "x").frame).select("doc_id")
    return table(spark, sf_dir, "labels").join(hit, "doc_id", "left_semi")
