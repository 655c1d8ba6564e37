"""Any page of a written result, by row position, without reading the rest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.functions.text import column
from rulewright.operators.transform import visible

# Page sizes, writing tasks per group of the running sum, and groups of
# files whose names have no task number.
PAGE_SIZE = 50
PAGE_SIZE_CEILING = 500
TASKS_PER_LOT = 1000
UNNAMED_LOTS = 256
#: Rows of a bucket in which pages and files meet; see operators.results for the rows of a file.
BUCKET_ROWS = 100_000

INDEX_SCHEMA = "path string, rows bigint, start bigint"
CLUSTERED_SCHEMA = INDEX_SCHEMA + ", end bigint"
#: Files in a row group of a saved index: what opening a page reads of it.
FILES_PER_GROUP = 20_000
_NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def running_start(files: DataFrame) -> DataFrame:
    """Exclusive running row count of files (path, rows) in writing order.

    Order is by the task and file numbers in the name, as numbers, then by path.
    The sum is taken in two levels, inside lots and over the lots, so no task sees the
    whole list.  Lots are ranges of tasks; files without a task number come first, in
    lots that are ranges of their order.
    """
    number = "try_cast(nullif(regexp_extract(path, '{}', 1), '') as bigint)"
    named = files.where("rows > 0").select(
        "path",
        "rows",
        F.expr(number.format("part-([0-9]+)[^/]*$")).alias("task"),
        F.expr(number.format("-c([0-9]+)[^/]*$")).alias("piece"),
    )
    named = _with_lot(named)

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("lot").orderBy("task", "piece", "path"))
    lots = named.groupBy("lot").agg(F.sum("rows").alias("lot_rows"))
    lots = lots.select(
        "lot",
        F.coalesce(F.sum("lot_rows").over(before(Window.orderBy("lot"))), F.lit(0)).alias("lot_start"),
    )
    placed = named.withColumn("offset", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    return placed.join(lots, "lot").select(
        "path", "rows", (F.col("lot_start") + F.col("offset")).alias("start")
    )


def _with_lot(named: DataFrame) -> DataFrame:
    """``named`` with ``lot``: below 0 for files without a task number, from 0 for the others."""
    spot = F.struct(F.coalesce("piece", F.lit(-1)).alias("piece"), "path")
    # One file by chance of each hash bucket: the borders follow the files' own spread.
    drawn = named.where("task IS NULL").groupBy(F.pmod(F.xxhash64("path"), F.lit(UNNAMED_LOTS)).alias("bucket"))
    borders = drawn.agg(F.min_by(spot, F.struct(F.xxhash64(F.lit(1), "path"), "path")).alias("border"))
    borders = borders.agg(F.collect_list("border").alias("borders"))
    passed = F.size(F.filter("borders", lambda border: border <= spot))
    unnamed = F.when(F.col("task").isNull(), passed - (UNNAMED_LOTS + 1)).cast("bigint")
    lot = F.coalesce(F.floor(F.col("task") / TASKS_PER_LOT), unnamed)
    return named.crossJoin(F.broadcast(borders)).withColumn("lot", lot).drop("borders")


def page_index(spark: SparkSession, uri: str) -> DataFrame:
    """One row per non-empty file: path, rows, start.  Only footers are read."""
    try:
        table = spark.read.parquet(uri)
    except AnalysisException as problem:
        if problem.getCondition() in _NOTHING_THERE:
            return spark.createDataFrame([], INDEX_SCHEMA)
        raise
    path = F.col("_metadata.file_path").alias("path")
    return running_start(table.groupBy(path).agg(F.count(F.lit(1)).alias("rows")))


def save_index(index: DataFrame, path: str, files_per_group: int = FILES_PER_GROUP) -> DataFrame:
    """``index`` written in the order of row positions, with ``end``; returned as open_index does.

    Ranges of positions become files, in small row groups, so the statistics of either bound
    tell where a page lies and the rest of the index is not read.
    """
    placed = index.select("path", "rows", "start", (F.col("start") + F.col("rows")).alias("end"))
    ordered = placed.repartitionByRange("start").sortWithinPartitions("start")
    ordered.write.mode("overwrite").option("parquet.block.row.count.limit", files_per_group).parquet(path)
    return open_index(index.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """A saved index: path, rows, start, end."""
    return spark.read.schema(CLUSTERED_SCHEMA).parquet(path)


def _file_end(index: DataFrame) -> Column:
    """Where a file's rows end: a column of a saved index, so that it can be pushed into its scan."""
    return F.col("end") if "end" in index.columns else F.col("start") + F.col("rows")


def visible_columns(spark: SparkSession, uri: str) -> list[str]:
    """Columns of a written result that are shown; none when nothing is there."""
    try:
        return visible(spark.read.parquet(uri).columns)
    except AnalysisException as problem:
        if problem.getCondition() in _NOTHING_THERE:
            return []
        raise


def clamp_page_size(asked: Column) -> Column:
    """Page size in [1, 500]; 50 when it is missing or not a number."""
    number = F.coalesce(asked.cast("string").try_cast("bigint"), F.lit(PAGE_SIZE))
    return F.greatest(F.lit(1), F.least(number, F.lit(PAGE_SIZE_CEILING)))


def page_offset(page: Column, size: Column) -> Column:
    """0-based first row of a 1-based page; pages below 1 are page 1."""
    return F.greatest(page.cast("bigint") - 1, F.lit(0)) * size


def page_count(rows: Column, size: Column) -> Column:
    whole = F.call_function("div", rows + size - 1, F.when(size > 0, size))
    return F.when((rows > 0) & (size > 0), whole).otherwise(F.lit(0)).cast("bigint")


def page_envelope(pages: DataFrame) -> DataFrame:
    """Add total_pages, has_next, has_previous, row_offset to (page, page_size, total_rows)."""
    total = page_count(F.col("total_rows"), F.col("page_size"))
    return pages.withColumns(
        {
            "total_pages": total,
            "has_next": F.col("page") < total,
            "has_previous": F.col("page") > 1,
            "row_offset": (F.col("page") - 1) * F.col("page_size"),
        }
    )


def page_slices(pages: DataFrame, index: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The part of each file that each page needs: local_offset and take.

    ``pages`` has page and page_size.  Row positions are cut into buckets of
    ``bucket_rows`` rows, both sides are matched bucket by bucket, and a pair is kept in
    the bucket where its overlap begins, so it appears once.  Each table is read once;
    adaptive execution splits a bucket that most pages ask for.
    """
    first = page_offset(F.col("page"), F.col("page_size"))
    asked = pages.withColumns({"first_row": first, "end_row": first + F.col("page_size")}).where("page_size > 0")
    asked = asked.withColumn("bucket", _buckets("first_row", "end_row", bucket_rows))
    files = index.where("rows > 0").withColumn("file_end", _file_end(index))
    files = files.withColumn("bucket", _buckets("start", "file_end", bucket_rows))
    begin, until = F.greatest("start", "first_row"), F.least("file_end", "end_row")
    pairs = asked.join(files, "bucket").where(begin < until)
    return pairs.where(F.expr(f"greatest(start, first_row) div {bucket_rows}") == F.col("bucket")).select(
        *[column(n) for n in pages.columns],
        "path",
        (begin - F.col("start")).alias("local_offset"),
        (until - begin).alias("take"),
    )


def _buckets(low: str, high: str, rows: int) -> Column:
    """One row per bucket that the rows from ``low`` to before ``high`` fall in."""
    return F.explode(F.expr(f"sequence({low} div {rows}, ({high} - 1) div {rows})"))


def render_cells(df: DataFrame) -> DataFrame:
    """Booleans and numbers as they are, everything else as text."""
    plain = (T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType)
    return df.select(
        *[
            column(f.name) if isinstance(f.dataType, plain) else column(f.name).cast("string").alias(f.name)
            for f in df.schema.fields
        ]
    )


def read_page(
    spark: SparkSession,
    index: DataFrame,
    page: int,
    page_size: int = PAGE_SIZE,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of one page, in file order, bookkeeping columns hidden.

    Only files that hold rows of the page are opened, and the position filter
    reaches the Parquet scan; of an index from save_index only the row groups that the
    page lies in are read.  No page has more than PAGE_SIZE_CEILING rows.
    """
    size = min(max(page_size, 0), PAGE_SIZE_CEILING)
    first = max(page - 1, 0) * size
    end = first + size
    # Every listed file holds a row of the page, so there are at most `size` of them.
    hits = (
        index.where((F.col("start") < end) & (_file_end(index) > first))
        .orderBy("start")
        .limit(size)
        .collect()
    )
    if not hits:
        any_file = index.select("path").limit(1).collect()
        if not any_file:
            return spark.createDataFrame([], "")
        empty = spark.read.parquet(unquote(any_file[0]["path"])).limit(0)
        return render_cells(empty.select(*[column(n) for n in _wanted(empty, columns)]))

    whole, parts = [], []
    for file in hits:
        low, high = max(first - file["start"], 0), min(end - file["start"], file["rows"])
        if (low, high) == (0, file["rows"]):
            whole.append(file)
        else:
            parts.append(_rows_of(spark, [file], columns, low, high))
    if whole:
        parts.append(_rows_of(spark, whole, columns))
    rows = reduce(DataFrame.unionByName, parts).orderBy("__position")
    return render_cells(rows.drop("__position"))


def _wanted(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return [n for n in visible(df.columns) if not columns or n in columns]


def _rows_of(spark, files, columns, low: int | None = None, high: int | None = None) -> DataFrame:
    df = spark.read.parquet(*[unquote(f["path"]) for f in files])
    starts = F.create_map(*[F.lit(v) for f in files for v in (f["path"], f["start"])])
    within = F.col("_metadata.row_index")
    position = starts[F.col("_metadata.file_path")] + within
    if low is not None:
        df = df.where((within >= low) & (within < high))
    return df.select(*[column(n) for n in _wanted(df, columns)], position.alias("__position"))
