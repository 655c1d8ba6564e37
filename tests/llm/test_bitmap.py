from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from rulewright.llm import bitmap as B
from rulewright.llm.bitmap import possible
from rulewright.llm.jaccard_join import near_copies, node_sets


def test_wanted_rows_pass_and_few_others_do(spark):
    rows = spark.range(40_000).select(F.col("id").alias("x"), F.lit("t").alias("t"))
    wanted = rows.where("x % 40 = 0").select((F.col("x") - 20_000).alias("x"))
    rows = rows.withColumn("x", F.col("x") - 20_000).union(spark.createDataFrame([(None, "u")], "x long, t string"))
    null = rows.where("x IS NULL").select("x")
    got = [r.x for r in possible(rows, "x", wanted.union(wanted.limit(3)).union(null)).collect()]
    assert set(got) >= {x for x in range(-20_000, 20_000) if x % 40 == 0} | {None}
    assert len(got) == len(set(got)) < 1_000 + 0.03 * 39_000
    assert possible(rows, "x", wanted.where("x IS NULL")).count() == 0


def test_texts_that_nobody_wants_do_not_move(spark):
    docs = spark.createDataFrame([(i, f"some words of the text number {i}") for i in range(200)] + [(None, "a b")], "doc_id long, text string")
    wanted = spark.createDataFrame([(7, 1), (None, 2)], "id long, node long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = io.StringIO()
        with contextlib.redirect_stdout(plan):
            node_sets(docs, wanted).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Texts are read, filtered, moved and hashed: the last lines are the first steps.
    steps = plan.getvalue().splitlines()
    move = max(i for i, line in enumerate(steps) if "Exchange hashpartitioning(coalesce(doc_id" in line)
    assert sum("BroadcastHashJoin" in line and "LeftSemi" in line for line in steps[move:]) == 2


def test_a_full_bitmap_loses_no_link(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:50] + [f"x{i}" for i in range(k)]) for k in (0, 1, 2)] + [" ".join(reversed(words)), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = sorted(tuple(r) for r in near_copies(docs).collect())
    assert [r[2] for r in told] == [0, 0, 0, 3, 4, 5]
    monkeypatch.setattr(B, "MOST_BITS", 64)
    assert sorted(tuple(r) for r in near_copies(docs).collect()) == told
