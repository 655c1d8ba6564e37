"""URL filters: rules first, logistic regression on hashed character n-grams for the rest.

All of it is DataFrame expressions.  A small labelled URL table is drawn from the URLs
that the rules decide: at most ``PER_VERDICT`` distinct URLs of each verdict, those with
the smallest hashes.  The regression is trained on it by full-batch gradient ascent in
its dual form: one number per labelled URL, one similarity per pair of them, so a
single row of fixed size holds the whole training.  The weights, one per bucket, reach
the pages as a scalar subquery.  Judging a page needs no shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import stored

BUCKETS = 4096
PER_VERDICT = 150
ROUNDS = 150
RATE = 0.02
DECAY = 0.01
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


# The rules asked for.
RULES = (
    UrlRule("block", "net", "/"),
    UrlRule("allow", "example.net", "/en/"),
    UrlRule("block", "example.com", "/de/"),
    UrlRule("allow", "org", "/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _buckets(part: str) -> Column:
    """Buckets of the character trigrams of a column, its two ends marked."""
    chars = F.split(F.concat(F.lit("\x02"), F.col(part), F.lit("\x03")), "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - 2, F.lit(1)))
    return F.transform(
        starts,
        lambda i: F.pmod(
            F.xxhash64(F.lit(part), F.get(chars, i - 1), F.get(chars, i), F.get(chars, i + 1)), F.lit(BUCKETS)
        ).cast("int"),
    )


def with_features(pages: DataFrame) -> DataFrame:
    return pages.withColumn("at", F.array_distinct(F.concat(_buckets("host"), _buckets("path"))))


def by_rule(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (NULL where no rule fits).  The longest rule wins."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        rule, verdict = F.when(r.fits(), r.text).otherwise(rule), F.when(r.fits(), r.verdict).otherwise(verdict)
    return rows.select("*", rule.alias("rule"), verdict.alias("verdict"))


def labelled_urls(ruled: DataFrame, per_verdict: int = PER_VERDICT) -> DataFrame:
    """host, path, verdict of at most ``per_verdict`` distinct URLs for each verdict."""
    order = F.xxhash64("host", "path")
    parts = [
        ruled.where(F.col("verdict") == v).select("host", "path", "verdict").distinct()
        .orderBy(order, "host", "path").limit(per_verdict)
        for v in ("block", "allow")
    ]
    return parts[0].union(parts[1])


def train(labelled: DataFrame) -> DataFrame:
    """One row with the weights of all buckets (``w``) and the intercept (``bias``)."""
    y = F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)
    examples = with_features(labelled).select(F.struct(y.alias("y"), F.col("at")).alias("e"))
    row = examples.agg(F.array_sort(F.collect_list("e")).alias("e")).withColumn(
        "k",
        F.expr(
            "transform(e, a -> transform(e, b -> "
            "1D + size(array_intersect(a.at, b.at)) / sqrt(CAST(size(a.at) AS DOUBLE) * size(b.at))))"
        ),
    )
    # Written, or else the similarities would be worked out anew in each round.
    solved = stored(row, "url-similarities").withColumn(
        "alpha",
        F.expr(
            f"aggregate(sequence(1, {ROUNDS}), transform(e, x -> 0D), (alpha, t) -> "
            "transform(e, (x, i) -> "
            f"alpha[i] * (1D - {RATE}D * {DECAY}D) + {RATE}D * (x.y - 1D / (1D + exp(-"
            "aggregate(zip_with(k[i], alpha, (p, q) -> p * q), 0D, (s, v) -> s + v))))))"
        ),
    )
    solved = stored(solved.select("e", "alpha"), "url-solution")
    shares = solved.select(F.explode(F.arrays_zip("e", "alpha")).alias("x")).select(
        "x.alpha", F.explode("x.e.at").alias("at"), F.size("x.e.at").alias("n")
    )
    weights = shares.groupBy("at").agg(F.sum(F.col("alpha") / F.sqrt("n")).alias("weight"))
    dense = (
        labelled.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("at"))
        .join(weights, "at", "left")
        .agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("weight", F.lit(0.0)).alias("weight")))).alias("w"))
    )
    bias = solved.select(F.expr("aggregate(alpha, 0D, (s, v) -> s + v)").alias("bias"))
    return labelled.sparkSession.sql(
        "SELECT (SELECT w.weight FROM {dense}) AS w, coalesce((SELECT bias FROM {bias}), 0D) AS bias", dense=dense, bias=bias
    )


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (NULL where a rule decides).

    A NULL URL or one without ``://`` has an empty host and path, so no rule fits it.
    Without labelled URLs every other URL is allowed (a score of 0 allows).  Repeated
    rows are judged alike and all come back; other columns are not read; an empty table
    gives no rows.
    """
    ruled = by_rule(pages, rules)
    model = stored(train(stored(labelled_urls(ruled), "labelled-urls")), "url-weights")
    scored = pages.sparkSession.sql(
        "SELECT *, (SELECT w FROM {model}) AS w, (SELECT bias FROM {model}) AS bias FROM {pages}",
        model=model, pages=with_features(ruled),
    ).withColumn(
        "block_score",
        F.expr("CASE WHEN rule IS NULL THEN bias + aggregate(at, 0D, (s, i) -> s + w[i]) / sqrt(CAST(size(at) AS DOUBLE)) END"),
    )
    learned = F.when(F.col("block_score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "block_score")
