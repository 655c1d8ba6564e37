from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulewright import TextRule, apply_rule, apply_rules, column_counts, count_matches, known_rule, page_index, profile
from rulewright import read_page, write_counted, write_result
from rulewright.errors import RuleError
from rulewright.operators import paging
from rulewright.operators.paging import (
    clamp_page_size,
    page_envelope,
    open_index,
    page_slices,
    save_index,
    running_start,
    visible_columns,
)
from rulewright.operators.results import affected_rows, invalid_rows, totals
from rulewright.session import scratch_path


@pytest.fixture(scope="module")
def written(spark):
    rows = [(f"{i:04d}", f"u{i}@example.org") for i in range(120)]
    df = spark.createDataFrame(rows, ["ID", "Email"]).coalesce(1).repartitionByRange(3, "ID").sortWithinPartitions("ID")
    path = scratch_path(spark, "written")
    counts = write_counted(apply_rule(df, known_rule("email"), ["Email"], "x").frame, path, rows_per_file=25)
    assert (counts.rows, counts.matched) == (120, 120)
    return path


def test_files_are_bounded_and_tile(spark, written):
    chunks = page_index(spark, written).orderBy("start").collect()
    assert len(chunks) > 1 and all(0 < c["rows"] <= 25 for c in chunks)
    end = 0
    for c in chunks:
        assert c["start"] == end
        end += c["rows"]
    assert end == 120
    assert visible_columns(spark, written) == ["ID", "Email"]


@pytest.mark.parametrize("size", [30, 50, 7, 120])
def test_pages_tile_the_result(spark, written, size):
    index = page_index(spark, written).cache()
    seen = [r["ID"] for p in range(1, 120 // size + 2) for r in read_page(spark, index, p, size).collect()]
    assert seen == [f"{i:04d}" for i in range(120)]


def test_page_limits(spark, written):
    index = page_index(spark, written)
    assert read_page(spark, index, 99, 50).count() == 0
    assert read_page(spark, index, 99, 50).columns == ["ID", "Email"]
    assert read_page(spark, index, 1, 1000).count() == 120
    assert read_page(spark, index, 1, 0).count() == 0
    assert [r["ID"] for r in read_page(spark, index, 0, 2).collect()] == ["0000", "0001"]
    assert read_page(spark, index, 1, 5, columns=["Email"]).columns == ["Email"]


def test_position_filter_reaches_the_scan(spark, written):
    plan = read_page(spark, page_index(spark, written), 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "_tmp_metadata_row_index" in plan and "DataFilters: [(_tmp_metadata_row_index" in plan


def test_nothing_written(spark, tmp_path):
    assert page_index(spark, str(tmp_path / "missing")).count() == 0
    assert page_index(spark, str(tmp_path)).count() == 0
    assert visible_columns(spark, str(tmp_path)) == []
    assert read_page(spark, page_index(spark, str(tmp_path)), 1, 10).count() == 0


def test_path_with_blanks(spark, tmp_path):
    path = str(tmp_path / "a b%c")
    write_result(spark.range(10).coalesce(1), path)
    assert [r["id"] for r in read_page(spark, page_index(spark, path), 2, 4).collect()] == [4, 5, 6, 7]


def test_overwrite_replaces(spark):
    path = scratch_path(spark, "again")
    write_result(spark.range(10), path)
    write_result(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_empty_result_counts_zero(spark):
    df = spark.createDataFrame([], "t string")
    frame = apply_rule(df, TextRule("a"), ["t"], "b").frame
    path = scratch_path(spark, "none")
    assert write_counted(frame, path).matched == 0
    assert count_matches(spark, path) == 0
    assert tuple(totals(frame).first()) == (0, 0)
    assert profile(df, [known_rule("email")], ["t"]).first()["rate"] == 0.0


def test_file_numbers_order_as_numbers(spark):
    names = ["part-00002-x-c1000", "part-00002-x-c999", "part-00010-x-c000", "part-100000-x-c000", "part-99999-x-c000"]
    files = spark.createDataFrame([(f"/r/{n}.parquet", 5) for n in names] + [("/r/part-00001-x-c000.parquet", 0)], "path string, rows bigint")
    got = [r["path"][3:-8] for r in running_start(files).orderBy("start").collect()]
    assert got == [names[1], names[0], names[2], names[4], names[3]]


def test_unnamed_files_meet_in_lots(spark):
    names = [f"/r/{i * 7919 % 3001:04d}{'-c' + str(i % 3) if i % 5 == 0 else ''}.parquet" for i in range(3000)]
    piece = lambda n: int(n.split("-c")[1].split(".")[0]) if "-c" in n else -1
    named = [f"/r/part-{i:05d}-c000.parquet" for i in (0, 999, 1000)]
    files = [(n, 1 + i % 4) for i, n in enumerate(names + named)]
    table = spark.createDataFrame(files, "path string, rows bigint").repartition(3)
    rows, start, want = dict(files), 0, []
    for n in sorted(names, key=lambda n: (piece(n), n)) + named:
        want.append((n, rows[n], start))
        start += rows[n]
    assert [tuple(r) for r in running_start(table).orderBy("start").collect()] == want
    numbered = table.selectExpr("path", "rows", "CAST(NULL AS BIGINT) AS task", "CAST(nullif(regexp_extract(path, '-c([0-9]+)', 1), '') AS BIGINT) AS piece")
    lots = [r["count"] for r in paging._with_lot(numbered).groupBy("lot").count().collect()]
    assert sum(lots) == len(files) and max(lots) < 150


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    sizes=st.lists(st.integers(0, 40), min_size=1, max_size=12),
    asked=st.lists(st.tuples(st.integers(-1, 12), st.integers(0, 60)), min_size=1, max_size=6),
    bucket=st.sampled_from([1, 7, 100]),
)
def test_page_slices_agree_with_brute_force(spark, sizes, asked, bucket):
    files = spark.createDataFrame([(f"part-{i:05d}-c000", n) for i, n in enumerate(sizes)], "path string, rows bigint")
    pages = spark.createDataFrame(asked, "page int, page_size int")
    got = sorted(
        (r["page"], r["page_size"], r["path"], r["local_offset"], r["take"])
        for r in page_slices(pages, running_start(files), bucket).collect()
    )
    want = []
    for page, size in asked:
        start = 0
        for i, rows in enumerate(sizes):
            low, high = max(start, max(page - 1, 0) * size), min(start + rows, max(page - 1, 0) * size + size)
            if low < high:
                want.append((page, size, f"part-{i:05d}-c000", low - start, high - low))
            start += rows
    assert got == sorted(want)


def test_envelope_and_clamp(spark):
    pages = spark.createDataFrame([(1, 50, 120), (3, 50, 120), (1, 0, 120), (1, 50, 0)], "page int, page_size int, total_rows bigint")
    got = [tuple(r)[3:] for r in page_envelope(pages).collect()]
    assert got == [(3, True, False, 0), (3, False, True, 100), (0, False, False, 0), (0, False, False, 0)]
    asked = spark.createDataFrame([(a,) for a in ["10", " 10 ", "0", "-4", "9999", "ten", "1.5", "", None]], "a string")
    assert [r[0] for r in asked.select(clamp_page_size(F.col("a"))).collect()] == [10, 10, 1, 1, 500, 50, 50, 50, 50]


def test_outcome_filters(people):
    replaced = apply_rule(people, known_rule("email"), ["Email"], "x")
    assert [r["ID"] for r in affected_rows(replaced.frame).collect()] == ["1", "2", "3"]
    checked = apply_rule(people, known_rule("email", "VALIDATE"), ["Email"])
    assert [r["ID"] for r in invalid_rows(checked.frame, checked.added_columns).collect()] == ["4", "5"]


def test_profile_and_column_counts(people):
    counts = {r["column_name"]: r["affected_cells"] for r in column_counts(people, known_rule("email"), ["Email", "Notes"]).collect()}
    assert counts == {"Email": 3, "Notes": 1}
    rows = profile(people, [known_rule("email"), known_rule("digits"), TextRule("A", case_insensitive=True, rule_id="a", requires=("q",))]).collect()
    assert len(rows) == 12
    assert {r["rule_id"]: r["affected_rows"] for r in rows} == {"email": 3, "digits": 5, "a": 5}
    checked = profile(people, [known_rule("email", "VALIDATE")], ["Email"]).first()
    assert checked["affected_cells"] == 2 and checked["rate"] == 0.4


def test_profile_of_many_rules_and_columns(spark):
    wide = spark.range(40).select("id", *[F.concat(F.lit("a@b.co "), F.col("id") * i % 7).alias(f"c{i}") for i in range(500)])
    rules = [TextRule(str(k), rule_id=f"r{k}", requires=(str(k),)) for k in range(7)] * 10 + [known_rule("email", "VALIDATE"), TextRule("A", case_insensitive=True, rule_id="a")]
    got = {(r["rule_id"], r["column_name"]): r for r in profile(wide, rules, [f"c{i}" for i in range(500)]).collect()}
    assert len(got) == 9 * 500
    for k in range(7):
        for i in (0, 1, 5, 499):
            row = got[f"r{k}", f"c{i}"]
            assert row["affected_cells"] == sum(n * i % 7 == k for n in range(40)) and row["total_rows"] == 40
            assert row["affected_rows"] == sum(any(n * j % 7 == k for j in range(500)) for n in range(40))
    assert got["email", "c3"]["affected_cells"] == 40 and got["a", "c3"]["rate"] == 1.0
    with pytest.raises(RuleError, match="at least one rule"):
        profile(wide, [])


def test_profile_counts_nulls_as_blank_and_rows_once(spark):
    df = spark.createDataFrame([("a", "b"), (None, "a"), ("x", None), (None, None)], "s string, t string")
    checked = profile(df, [TextRule("^a$", "VALIDATE", rule_id="v"), TextRule("^$", rule_id="blank"), TextRule("a", rule_id="a", requires=("a",))]).collect()
    assert {(r["rule_id"], r["column_name"]): (r["affected_cells"], r["affected_rows"]) for r in checked} == {
        ("v", "s"): (3, 4), ("v", "t"): (3, 4), ("blank", "s"): (2, 3), ("blank", "t"): (2, 3), ("a", "s"): (1, 2), ("a", "t"): (1, 2),
    }


def test_rules_in_sequence(people):
    outcome = apply_rules(people, [(known_rule("email"), ["Email", "Notes"], "m 1"), (known_rule("digits"), ["Email"], "N")])
    rows = {r["ID"]: r for r in outcome.frame.collect()}
    assert rows["1"]["Email"] == "m N" and rows["2"]["Notes"] == "copy to m 1"
    assert [rows[i]["__matched_1"] for i in "12345"] == [1, 2, 1, 0, 0]
    assert [rows[i]["__matched"] for i in "12345"] == [2, 3, 2, 0, 0]
    assert outcome.visible_columns == people.columns


def test_plans_stay_narrow(spark, written, people):
    index = page_index(spark, written)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in index
    seen = profile(people, [known_rule("email"), known_rule("digits")])._jdf.queryExecution().executedPlan().toString()
    # A row per column with hits, then one row of counts.
    assert seen.count("Exchange") == 2 and "Exchange hashpartitioning(at#" in seen and "Exchange SinglePartition" in seen
    count = totals(spark.read.parquet(written))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<__matched:int>" in count


def scanned_rows(frame):
    """Rows that the scans of a finished plan put out."""
    plan, out = frame._jdf.queryExecution().executedPlan(), 0
    found = plan.collectLeaves()
    for i in range(found.size()):
        metrics = found.apply(i).metrics()
        if metrics.contains("numOutputRows"):
            out += metrics.apply("numOutputRows").value()
    return out


def test_a_saved_index_prunes_both_bounds(spark, tmp_path):
    files = spark.range(10**6).selectExpr("concat('/r/part-', id) AS path", "CAST(id % 7 + 1 AS BIGINT) AS rows", "id * 4 AS start")
    index = save_index(files, str(tmp_path / "index"), files_per_group=5000)
    assert index.count() == 10**6 and open_index(spark, str(tmp_path / "index")).columns == ["path", "rows", "start", "end"]
    hits = index.where((F.col("start") < 2_000_050) & (F.col("end") > 2_000_000))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(start,2000050)" in plan and "GreaterThan(end,2000000)" in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hits = index.where((F.col("start") < 2_000_050) & (F.col("end") > 2_000_000))
        assert len(hits.collect()) == 13
        # One row group, or two where the page lies on a border.
        assert scanned_rows(hits) <= 13 or scanned_rows(hits) <= 10_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_pages_by_a_saved_index(spark, written, tmp_path):
    index = save_index(page_index(spark, written), str(tmp_path / "index"))
    seen = [r["ID"] for p in range(1, 6) for r in read_page(spark, index, p, 30).collect()]
    assert seen == [f"{i:04d}" for i in range(120)]


def test_slices_read_each_table_once(spark, tmp_path):
    files = spark.range(40).selectExpr("format_string('/r/part-%05d-c000.parquet', id) AS path", "CAST(id % 5 AS BIGINT) AS rows")
    index = save_index(running_start(files), str(tmp_path / "index"))
    pages = spark.createDataFrame([(p, 7) for p in range(1, 14)], "page int, page_size int")
    plan = page_slices(pages, index)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") + plan.count("Scan parquet") <= 2 and "NestedLoop" not in plan and "SinglePartition" not in plan
