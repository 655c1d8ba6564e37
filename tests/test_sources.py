from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rulewright import SourceError, list_files, preview, read_table, sample_values
from rulewright.functions.text import extension_of, human_size
from rulewright.sources.delimited import detect_delimiter
from rulewright.sources.files import compare_inventories, inventory, update_inventory, catalogue
from rulewright.sources.synthetic import make_contacts, make_tickets
from rulewright.sources.tables import extension, resolve_uri


def write(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body, encoding="utf-8")
    return str(path)


def test_csv_is_all_text(spark, tmp_path):
    df = read_table(spark, write(tmp_path, "a.csv", 'code,n\n007,1.50\n"a ""b"", c",\n"",x\n'))
    assert [t for _, t in df.dtypes] == ["string", "string"]
    assert [tuple(r) for r in df.collect()] == [("007", "1.50"), ('a "b", c', None), (None, "x")]


def test_short_rows_are_padded_and_long_rows_cut(spark, tmp_path):
    df = read_table(spark, write(tmp_path, "a.csv", "a,b\n1\n1,2,3\n"))
    assert [tuple(r) for r in df.collect()] == [("1", None), ("1", "2")]


def test_tsv_and_upper_case_extension(spark, tmp_path):
    df = read_table(spark, write(tmp_path, "a.TSV", "a\tb\n1,5\t2\n"))
    assert [tuple(r) for r in df.collect()] == [("1,5", "2")]


def test_parquet_keeps_types(spark, tmp_path):
    spark.range(2).selectExpr("id", "id > 0 AS b").write.parquet(str(tmp_path / "p.parquet"))
    assert dict(read_table(spark, "p.parquet", base=str(tmp_path)).dtypes) == {"id": "bigint", "b": "boolean"}


@pytest.mark.parametrize("name", ["a.txt", "a", "a.xls", "a."])
def test_unknown_types(spark, name):
    with pytest.raises(SourceError, match="unsupported"):
        read_table(spark, f"/nowhere/{name}")


@pytest.mark.parametrize("key, base, uri", [
    ("s3://b/k.csv", "x", "s3a://b/k.csv"),
    ("s3a://b/k.csv", "x", "s3a://b/k.csv"),
    ("file:///k.csv", "x", "file:///k.csv"),
    ("/k.csv", "x", "/k.csv"),
    ("raw/k.csv", "s3a://b/", "s3a://b/raw/k.csv"),
])
def test_resolve_uri(key, base, uri):
    assert resolve_uri(key, base) == uri


@pytest.mark.parametrize("key, kind", [("a/B.CSV", ".csv"), ("abc", ""), ("a.", ""), ("x.tar.gz", ".gz")])
def test_extension(spark, key, kind):
    assert extension(key) == kind
    assert spark.range(1).select(extension_of(F.lit(key))).first()[0] == kind


@pytest.mark.parametrize("name, body, sep", [
    ("a.csv", "a,b\n1,2\n", ","),
    ("b.csv", "a;b\n1,5;2\n2;3,5\n", ";"),
    ("c.csv", "a\tb,\n1\t2\n", "\t"),
    ("d.csv", 'a|b\n"x,y,z"|2\n', "|"),
    ("e.csv", "only\none\n", ","),
    ("f.tsv", "a,b\n", "\t"),
    ("h.csv", "a;b\n" + "1;2\n" * 9 + "short\n", ";"),
    ("i.csv", "a;b,c\n" + "1,5;2,5\n" * 3 + "2;x\n", ";"),
    ("g.csv", "", ","),
])
def test_detect_delimiter(spark, tmp_path, name, body, sep):
    assert detect_delimiter(spark, write(tmp_path, name, body)) == sep


def test_preview(spark, tmp_path):
    body = "a;;b \n" + "".join(f"{i};;x\n" for i in range(30))
    seen = preview(spark, write(tmp_path, "p.csv", body), rows=None)
    assert seen.columns == ["a", "col_1", "b"]
    assert [tuple(r) for r in seen.frame.collect()] == [(str(i), "", "x") for i in range(5)]
    assert preview(spark, str(tmp_path / "p.csv"), rows=100).frame.count() == 20
    assert seen.truncated and not preview(spark, write(tmp_path, "few.csv", "a\n1\n")).truncated


def test_preview_of_equal_headers(spark, tmp_path):
    seen = preview(spark, write(tmp_path, "eq.csv", "A, A,b, a,A_2\n1,2,3,4,5\n"))
    assert seen.columns[0] == "A" and len({c.lower() for c in seen.columns}) == 5
    assert tuple(seen.frame.first()) == ("1", "2", "3", "4", "5")


def test_preview_of_nothing(spark, tmp_path):
    seen = preview(spark, write(tmp_path, "p.csv", ""))
    assert seen.frame is None and seen.columns == [] and seen.note == "no columns"


def test_preview_of_parquet_hides_columns(spark, tmp_path):
    spark.range(9).selectExpr("id", "nullif(id, 0) AS n", "1 AS __m").write.parquet(str(tmp_path / "q.parquet"))
    seen = preview(spark, str(tmp_path / "q.parquet"), rows=2)
    assert seen.columns == ["id", "n"]
    assert all(isinstance(v, str) for r in seen.frame.collect() for v in r)


def test_sample_values(spark):
    df = spark.createDataFrame([("",), (None,), ("x" * 200,), ("b",)], "t string")
    got = [r["sample"] for r in sample_values(df, ["t"], 3).collect()]
    assert got == ["x" * 120, "b"]
    listed = spark.range(3).selectExpr("array(id) AS l")
    assert [r["sample"] for r in sample_values(listed, ["l"], 1).collect()] == ["[0]"]
    assert sample_values(df, []).count() == 0


def test_catalogue(spark):
    listing = spark.sql("""SELECT * FROM VALUES
        ('r/old.csv', 10L, timestamp'2024-01-01'), ('r/new.PARQUET', 2048L, timestamp'2024-02-01'),
        ('r/undated.tsv', 1L, null), ('r/notes.txt', 1L, timestamp'2024-03-01'), ('r/dir.csv/', 0L, null)
        AS t(path, length, modificationTime)""")
    rows = catalogue(listing).collect()
    assert [r["name"] for r in rows] == ["undated.tsv", "new.PARQUET", "old.csv"]
    assert [r["size_human"] for r in rows] == ["1.0 B", "2.0 KB", "10.0 B"]
    assert rows[1]["extension"] == ".parquet"


def test_inventories(spark, tmp_path):
    shape = "path string, length long, modificationTime timestamp"
    day = lambda n: dt.datetime(2024, 1, n, tzinfo=dt.timezone.utc)
    old = spark.createDataFrame([("a.csv", 1, day(1)), ("b.csv", 1, None), ("c.csv", 1, day(1)), ("d.txt", 1, day(1)), ("e.csv", 1, day(1)), (None, 1, day(1))], shape)
    new = spark.createDataFrame(
        [("a.csv", 1, day(1)), ("b.csv", 1, day(2)), ("e.csv", 2, day(1)), ("e.csv", 1, day(1)), ("e.csv", 9, None), ("f.csv/", 0, None), ("g.csv", 5, None)], shape
    )
    first = update_inventory(spark, old, str(tmp_path), 0)
    assert sorted((r["key"], r["change"]) for r in first.collect()) == [(k, "added") for k in ("a.csv", "b.csv", "c.csv", "e.csv")]
    for _ in range(2):
        then = update_inventory(spark, new, str(tmp_path), 1)
        assert sorted((r["key"], r["change"], r["size"], r["old_size"]) for r in then.collect()) == [
            ("b.csv", "changed", 1, 1), ("c.csv", "gone", None, 1), ("e.csv", "changed", 2, 1), ("g.csv", "added", 5, None),
        ]
    assert sorted(r["change"] for r in compare_inventories(inventory(old), inventory(new)).collect()) == ["added", "changed", "changed", "gone", "same"]
    gone = update_inventory(spark, new.limit(0), str(tmp_path), 2)
    assert {r["change"] for r in gone.collect()} == {"gone"} and gone.count() == 4


@pytest.mark.parametrize("size, shown", [
    (0, "0.0 B"), (30976, "30.2 KB"), (1329, "1.3 KB"), (1023, "1023.0 B"), (1024, "1.0 KB"), (5 * 1024**3, "5.0 GB"), (2**50, "1.0 PB"), (2**60, "1024.0 PB"),
])
def test_human_size(spark, size, shown):
    assert spark.range(1).select(human_size(F.lit(size))).first()[0] == shown


def test_list_files_reads_no_content(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub", "a.csv", "a\n1\n")
    write(tmp_path, "b.txt", "x")
    listed = list_files(spark, str(tmp_path))
    assert [r["name"] for r in listed.collect()] == ["a.csv"]
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a.xlsx", "b.XLS"])
def test_workbooks_are_refused(spark, name):
    with pytest.raises(SourceError, match="workbooks are not read"):
        read_table(spark, f"/x/{name}")


def test_contacts_are_the_same_for_any_partitioning(spark):
    made = make_contacts(spark, 100)
    assert made.columns == ["ID", "Name", "Email", "Phone", "City", "Status", "Score", "Last Seen IP", "Notes"]
    rows = sorted(made.collect())
    assert rows == sorted(make_contacts(spark, 100).repartition(9).collect())
    blank = [int(r["ID"]) for r in rows if r["Email"] == ""]
    assert sorted(blank) == [17, 34, 51, 68, 85]
    by = {int(r["ID"]): r for r in rows}
    assert by[28]["Score"] == "3.6" and by[17]["Notes"] == "contact unknown re order 17"


def test_tickets_mix_personal_data(spark):
    from rulewright import catalogue_rules, profile

    seen = profile(make_tickets(spark, 60), catalogue_rules(), ["Body"])
    counts = {r["rule_id"]: r["affected_cells"] for r in seen.collect()}
    assert counts["email"] == 40 and counts["card"] == 10 and counts["url"] == 10 and counts["ipv4"] == 20
