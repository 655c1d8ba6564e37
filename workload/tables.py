"""Queries of sources, sinks, previews, paging and generated tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from rulewright import VALIDATE, TextRule, apply_rule, known_rule, list_files, page_index, read_page, read_table
from rulewright.functions.text import clip
from rulewright.operators.paging import (
    clamp_page_size,
    page_envelope,
    page_slices,
    save_index,
    render_cells,
    running_start,
)
from rulewright.operators.results import write_counted, write_result
from rulewright.operators.transform import hide_internal
from rulewright.sources.files import catalogue, update_inventory
from rulewright.sources.preview import head_of, sample_values
from rulewright.sources.synthetic import (
    CITIES,
    DOMAINS,
    FIRST_NAMES,
    LAST_NAMES,
    PRIORITIES,
    STATES,
    contacts,
    tickets,
)
from rulewright.session import scratch_path
from workload.registry import choose, derive, query, table, text
from workload.rules import EMAIL, counter, found

# Part names as awkward text: quotes, commas, blanks at the ends, leading zeros, empty cells.
PART_CELLS = """lpad(CAST(p_partkey AS {text}), 9, '0') AS code,
    CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('say "', p_name, '"')
      WHEN 2 THEN concat(p_name, '{sep} ', p_type) WHEN 3 THEN concat(' ', p_name, ' ') ELSE p_name END AS label,
    p_brand AS brand"""


def part_cells(spark, sf_dir, sep):
    return derive(table(spark, sf_dir, "part"), PART_CELLS.format(text="STRING", sep=sep))


def part_sql(sep):
    return f"""SELECT code, nullif(label, '') AS label, brand
    FROM (SELECT {PART_CELLS.format(text='VARCHAR', sep=sep)} FROM part)"""


def delimited(spark, df, sep, extension):
    """Write a table as delimited text and return where."""
    path = f"{scratch_path(spark, 'delimited')}{extension}"
    df.write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    return path


@query("csv_scan", part_sql(","))
def csv_scan(spark, sf_dir):
    return read_table(spark, delimited(spark, part_cells(spark, sf_dir, ","), ",", ".csv"))


@query("tsv_scan", part_sql("\t"))
def tsv_scan(spark, sf_dir):
    return read_table(spark, delimited(spark, part_cells(spark, sf_dir, "\t"), "\t", ".tsv"))


@query("csv_scan_detected", part_sql(";"))
def csv_scan_detected(spark, sf_dir):
    """A CSV file split by semicolons, opened without naming the delimiter."""
    path = delimited(spark, part_cells(spark, sf_dir, ";"), ";", ".csv")
    return read_table(spark, path, sep=None)


@query("parquet_scan", "SELECT * FROM lineitem")
def parquet_scan(spark, sf_dir):
    """Parquet keeps its own types."""
    return read_table(spark, f"{sf_dir}/lineitem.parquet")


# A listing with every kind of extension, folder markers and undated files.
_NAMES = ["a.csv", "b.TSV", "c.xlsx", "d.parquet", "e.txt", "f.", "g", "h.XLS", "folder.csv/", "i.tar.csv"]
LISTING = f"""concat('raw/', source, '/', CAST(doc_id AS {{text}}), '-', {choose(_NAMES, 'doc_id')}) AS path,
    n_chars * n_chars * (doc_id % 7) * (1 + doc_id % 3 * 1000) AS length"""


@query(
    "file_catalogue",
    f"""SELECT path AS key, regexp_extract(path, '[^/]*$') AS name, length AS size,
    CASE WHEN length < 1024 THEN printf('%.1f B', length::DOUBLE)
      WHEN length / 1024 < 1024 THEN printf('%.1f KB', length / 1024)
      WHEN length / 1048576 < 1024 THEN printf('%.1f MB', length / 1048576)
      WHEN length / 1073741824 < 1024 THEN printf('%.1f GB', length / 1073741824)
      ELSE printf('%.1f TB', length / 1099511627776) END AS size_human,
    lower(regexp_extract(path, '\\.[^.]*$')) AS extension
    FROM (SELECT {LISTING.format(text='VARCHAR')} FROM documents)
    WHERE path NOT LIKE '%/'
    AND lower(regexp_extract(path, '\\.[^.]*$')) IN ('.csv', '.tsv', '.xlsx', '.xls', '.parquet')""",
)
def file_catalogue(spark, sf_dir):
    dated = LISTING.format(text="STRING") + ", timestamp_seconds(doc_id * 3600) AS modificationTime"
    listing = derive(table(spark, sf_dir, "documents"), dated)
    return catalogue(listing).drop("last_modified")


@query(
    "file_catalogue_order",
    f"""SELECT path AS key, row_number() OVER (ORDER BY modified DESC NULLS FIRST, path DESC) AS place
    FROM (SELECT {LISTING.format(text='VARCHAR')},
      CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 7919) % 1000 END AS modified FROM documents)
    WHERE path NOT LIKE '%/'
    AND lower(regexp_extract(path, '\\.[^.]*$')) IN ('.csv', '.tsv', '.xlsx', '.xls', '.parquet')""",
)
def file_catalogue_order(spark, sf_dir):
    """Every file of the catalogue with its place; undated files lead."""
    dated = """, CASE WHEN doc_id % 11 <> 0 THEN timestamp_seconds((doc_id * 7919) % 1000) END
    AS modificationTime"""
    listing = derive(table(spark, sf_dir, "documents"), LISTING.format(text="STRING") + dated)
    ranked = catalogue(listing).select("key", "last_modified")
    newest = [F.col("last_modified").desc_nulls_first(), F.col("key").desc()]
    path = scratch_path(spark, "catalogue-order")
    # A file per range, in order: a place is the rows of the files before and the row in the file.
    ranked.select("key", "last_modified").repartitionByRange(*newest).sortWithinPartitions(*newest).write.parquet(path)
    rows = spark.read.parquet(path).select("key", "_metadata.row_index", F.col("_metadata.file_path").alias("path"))
    place = (F.col("start") + F.col("row_index") + 1).cast("bigint")
    return rows.join(page_index(spark, path), "path").select("key", place.alias("place"))


# Two listings of a store: keys come and go, sizes and dates change, some keys are listed twice.
_OLD_FILES = """SELECT path, length, stamp(CASE WHEN doc_id % 13 > 0 THEN doc_id * 3600 END) AS modified
    FROM (SELECT doc_id, {listing} FROM documents) WHERE doc_id % 5 > 0"""
_NEW_FILES = """SELECT path, length + CASE WHEN doc_id % 17 = 0 THEN copy + 1 ELSE 0 END AS length,
    stamp(CASE WHEN doc_id % 13 > 0 THEN doc_id * 3600 + CASE WHEN doc_id % 19 = 0 THEN copy * 60 ELSE 0 END END) AS modified
    FROM (SELECT doc_id, copy, {listing} FROM documents, (SELECT 0 AS copy UNION ALL SELECT 1) AS copies) WHERE doc_id % 7 > 0 AND copy <= doc_id % 2"""


def _folded_sql(listing: str) -> str:
    rows = listing.format(listing=LISTING.format(text="VARCHAR")).replace("stamp(", "to_timestamp(")
    return f"""SELECT path AS key, length AS size, epoch_us(modified) AS modified_us FROM ({rows})
    WHERE path NOT LIKE '%/' AND lower(regexp_extract(path, '\\.[^.]*$')) IN ('.csv', '.tsv', '.xlsx', '.xls', '.parquet')
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY modified DESC NULLS LAST, length DESC) = 1"""


@query(
    "inventory_changes",
    f"""WITH old AS ({_folded_sql(_OLD_FILES)}), new AS ({_folded_sql(_NEW_FILES)}),
    both_of AS (SELECT coalesce(n.key, o.key) AS key, n.size, n.modified_us, o.size AS old_size, o.modified_us AS old_us,
      CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'gone'
        WHEN o.size IS DISTINCT FROM n.size OR o.modified_us IS DISTINCT FROM n.modified_us THEN 'changed' ELSE 'same' END AS change
      FROM old o FULL JOIN new n ON o.key = n.key)
    SELECT * FROM both_of WHERE change <> 'same'""",
)
def inventory_changes(spark, sf_dir):
    """What changed in a store between two listings, kept as generations of an inventory."""
    docs, folder = table(spark, sf_dir, "documents"), scratch_path(spark, "inventory")
    for generation, listing in enumerate((_OLD_FILES, _NEW_FILES)):
        rows = listing.format(listing=LISTING.format(text="STRING")).replace("stamp(", "timestamp_seconds(").replace("documents", "{docs}")
        files = spark.sql(rows, docs=docs).withColumnRenamed("modified", "modificationTime")
        changes = update_inventory(spark, files, folder, generation)
    micros = {"modified_us": F.unix_micros("last_modified"), "old_us": F.unix_micros("old_modified")}
    return changes.withColumns(micros).drop("last_modified", "old_modified")


@query("file_listing")
def file_listing(spark, sf_dir):
    """The given folder itself; SQL does not see files."""
    return list_files(spark, sf_dir).drop("last_modified")


@query(
    "preview_head",
    """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
    CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS flag FROM lineitem LIMIT 20""",
)
def preview_head(spark, sf_dir):
    """First rows as text, NULL shown as blank, bookkeeping hidden; the row limit is the feature."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "nullif(l_returnflag, 'N') AS flag", "1 AS __matched"
    )
    return head_of(lines, 50)


@query(
    "sample_values",
    """SELECT substring(cell, 1, 120) AS sample FROM (
      SELECT CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN text END AS cell FROM documents)
    WHERE length(cell) > 0 LIMIT 5""",
)
def samples(spark, sf_dir):
    """Five non-blank values; the row limit is the feature."""
    cells = table(spark, sf_dir, "documents").selectExpr(
        "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN text END AS cell"
    )
    return sample_values(cells, ["cell"])


@query("clipped_text", "SELECT doc_id, substring(text, 1, 120) AS shown FROM documents")
def clipped_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clip(F.col("text"), 120).alias("shown"))


@query(
    "result_write",
    f"""SELECT doc_id, regexp_replace(text, {text(EMAIL.pattern)}, 'x', 'g') AS text,
    {found('text', EMAIL.pattern)} AS matched FROM documents""",
)
def result_write(spark, sf_dir):
    """A result written and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "result")
    write_result(apply_rule(docs, known_rule("email"), ["text"], "x").frame, path, rows_per_file=300)
    return counter(spark.read.parquet(path))


@query(
    "write_and_count",
    """SELECT count(*) AS total_rows,
    CAST(sum(CAST(NOT regexp_matches(o_orderpriority, '^[12]-') AS INTEGER)) AS BIGINT) AS matched_cells
    FROM orders""",
)
def write_and_count(spark, sf_dir):
    """Counts taken in the same pass that writes."""
    orders = table(spark, sf_dir, "orders")
    frame = apply_rule(orders, TextRule("^[12]-", VALIDATE), ["o_orderpriority"]).frame
    got = write_counted(frame, scratch_path(spark, "counted"))
    return spark.createDataFrame([(got.rows, got.matched)], "total_rows bigint, matched_cells bigint")


def written_lines(spark, sf_dir):
    """The line items with their flags masked, written in files of 7,000 rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    path = scratch_path(spark, "lines")
    write_result(apply_rule(lines, TextRule("[AN]"), ["l_returnflag"], "-").frame, path, rows_per_file=7000)
    return path


@query(
    "page_index",
    """SELECT count(*) AS total_rows, count(*) AS last_row, CAST(0 AS BIGINT) AS gaps,
    CAST(0 AS BIGINT) AS oversized, CAST(0 AS BIGINT) AS first_start FROM lineitem""",
)
def indexed(spark, sf_dir):
    """The index of a written result tiles its rows: starts meet ends, no file is too long."""
    index = page_index(spark, written_lines(spark, sf_dir))
    ends = index.select((F.col("start") + F.col("rows")).alias("start")).distinct()
    loose = index.where("start > 0").join(ends, "start", "left_anti").agg(F.count(F.lit(1)).alias("gaps"))
    return index.agg(
        F.sum("rows").alias("total_rows"),
        F.max(F.col("start") + F.col("rows")).alias("last_row"),
        F.count_if(F.col("rows") > 7000).alias("oversized"),
        F.min("start").alias("first_start"),
    ).withColumn("gaps", loose.scalar())


def _page_sql(offset: int, size: int) -> str:
    return f"""SELECT l_orderkey, l_linenumber, regexp_replace(l_returnflag, '[AN]', '-', 'g') AS l_returnflag,
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate FROM lineitem LIMIT {size} OFFSET {offset}"""


@query("page_read", _page_sql(49 * 50, 50))
def page_read(spark, sf_dir):
    """Page 50 of 50 rows, by a saved index; one page is the feature."""
    index = save_index(page_index(spark, written_lines(spark, sf_dir)), scratch_path(spark, "lines-index"))
    return read_page(spark, index, 50, 50)


@query("page_read_across_files", _page_sql(13 * 500, 500 * 1))
def page_read_across_files(spark, sf_dir):
    return read_page(spark, page_index(spark, written_lines(spark, sf_dir)), 14, 500)


@query("page_read_past_end", _page_sql(10**12, 50))
def page_read_past_end(spark, sf_dir):
    return read_page(spark, page_index(spark, written_lines(spark, sf_dir)), 10**11, 50)


@query("page_read_columns", "SELECT l_linenumber FROM lineitem LIMIT 20 OFFSET 0")
def page_read_columns(spark, sf_dir):
    """A page below 1 is page 1, and one column is wanted."""
    index = page_index(spark, written_lines(spark, sf_dir))
    return read_page(spark, index, -3, 20, columns=["l_linenumber"])


# Files as a write would name them: tasks of up to eight files, some of them empty.
FILES = """{format}('/r/part-%05d-job-c%03d.parquet', c_custkey // 8, c_custkey % 8) AS path,
    (c_custkey * 37) % 400 AS rows"""
FILES_SQL = f"SELECT {FILES.format(format='printf')}, c_custkey FROM customer"
STARTS_SQL = f"""SELECT path, rows, CAST(coalesce(sum(rows) OVER (ORDER BY c_custkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM ({FILES_SQL}) WHERE rows > 0"""


def written_files(spark, sf_dir):
    text_of = FILES.format(format="format_string").replace("c_custkey // 8", "c_custkey div 8")
    return derive(table(spark, sf_dir, "customer"), text_of)


@query("file_starts", STARTS_SQL)
def file_starts(spark, sf_dir):
    return running_start(written_files(spark, sf_dir))


@query(
    "page_slices",
    f"""WITH files AS ({STARTS_SQL}), pages AS (
      SELECT o_orderkey, o_custkey % 1500 AS page, 10 + o_orderkey % 491 AS page_size FROM orders),
    wanted AS (SELECT *, greatest(page - 1, 0) * page_size AS first_row,
      greatest(page - 1, 0) * page_size + page_size AS end_row FROM pages)
    SELECT o_orderkey, page, page_size, path, greatest(first_row, start) - start AS local_offset,
      least(start + rows, end_row) - greatest(first_row, start) AS take
    FROM wanted JOIN files ON start + rows > first_row AND start < end_row""",
)
def slices(spark, sf_dir):
    """For a table of pages, the part of each file each page needs."""
    pages = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_custkey % 1500 AS page", "10 + o_orderkey % 491 AS page_size"
    )
    # Written once: the join then reads each table once.
    index = save_index(running_start(written_files(spark, sf_dir)), scratch_path(spark, "files-index"))
    return page_slices(pages, index)


@query(
    "page_envelopes",
    """SELECT o_orderkey, o_custkey % 40 + 1 AS page, o_orderkey % 60 AS page_size,
    CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey END AS total_rows,
    CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 60 = 0 THEN 0
      ELSE (o_custkey + o_orderkey % 60 - 1) // (o_orderkey % 60) END AS total_pages,
    o_custkey % 40 + 1 < CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 60 = 0 THEN 0
      ELSE (o_custkey + o_orderkey % 60 - 1) // (o_orderkey % 60) END AS has_next,
    o_custkey % 40 + 1 > 1 AS has_previous, (o_custkey % 40) * (o_orderkey % 60) AS row_offset FROM orders""",
)
def envelopes(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_custkey % 40 + 1 AS page",
        "o_orderkey % 60 AS page_size",
        "CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey END AS total_rows",
    )
    return page_envelope(pages)


ASKED = """CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS {text}) WHEN 1 THEN concat(' ', CAST(o_custkey AS {text}), ' ')
    WHEN 2 THEN o_orderpriority WHEN 3 THEN concat('-', CAST(o_custkey AS {text})) WHEN 4 THEN ''
    ELSE concat(CAST(o_custkey AS {text}), '.5') END AS asked"""


@query(
    "page_size_clamp",
    f"""SELECT o_orderkey, asked, CAST(greatest(1, least(500,
      CASE WHEN regexp_matches(asked, '^\\s*-?\\d+\\s*$') THEN CAST(trim(asked) AS BIGINT) ELSE 50 END)) AS BIGINT)
      AS page_size FROM (SELECT o_orderkey, {ASKED.format(text='VARCHAR')} FROM orders)""",
)
def page_size_clamp(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey", ASKED.format(text="STRING"))
    return asked.withColumn("page_size", clamp_page_size(F.col("asked")))


@query(
    "cell_rendering",
    """SELECT o_orderkey, o_totalprice, o_orderkey % 2 = 0 AS even,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(CAST(o_custkey AS DECIMAL(12, 2)) AS VARCHAR) AS amount
    FROM orders""",
)
def cell_rendering(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "o_totalprice",
        "o_orderkey % 2 = 0 AS even",
        "o_orderdate",
        "CAST(o_orderdate AS DATE) AS day",
        "CAST(o_custkey AS DECIMAL(12, 2)) AS amount",
    )
    return render_cells(orders)


def _spread_sql(step: int, low: int, high: int, key: str = "k") -> str:
    return f"CAST(({key} * {step} + {step // 3}) % {high - low + 1} + {low} AS VARCHAR)"


def _email_sql(first: str, last: str, key: str = "k") -> str:
    return f"""concat(CASE {key} % 4 WHEN 0 THEN concat(lower({first}), '.', lower({last}))
      WHEN 1 THEN concat(lower({first}), '_', lower({last}))
      WHEN 2 THEN concat(substring(lower({first}), 1, 1), lower({last}), CAST({key} % 100 AS VARCHAR))
      ELSE concat(lower({first}), lower({last})) END, '@', {choose(list(DOMAINS), key)})"""


_PHONE_SQL = f"""CASE k % 3 WHEN 0 THEN concat('+1 ', {_spread_sql(6101, 200, 989)}, '-555-', {_spread_sql(7907, 1000, 9999)})
    WHEN 1 THEN concat('0', {_spread_sql(31, 20, 99)}, ' ', {_spread_sql(4001, 1000, 9999)}, ' ', {_spread_sql(7907, 1000, 9999)})
    ELSE concat('+84 ', {_spread_sql(17, 90, 99)}, ' ', {_spread_sql(911, 100, 999)}, ' ', {_spread_sql(7907, 1000, 9999)}) END"""
_ADDRESS_SQL = f"""concat({_spread_sql(53, 10, 220)}, '.', {_spread_sql(101, 0, 255)}, '.',
    {_spread_sql(151, 0, 255)}, '.', {_spread_sql(211, 1, 254)})"""


@query(
    "contacts",
    f"""WITH named AS (SELECT c_custkey AS k, {choose(list(FIRST_NAMES), 'c_custkey')} AS first,
      {choose(list(LAST_NAMES), '(c_custkey // 7)')} AS last FROM customer),
    mailed AS (SELECT *, CASE WHEN k % 17 = 0 THEN '' ELSE {_email_sql('first', 'last')} END AS email FROM named)
    SELECT CAST(k AS VARCHAR) AS "ID", concat(first, ' ', last) AS "Name", email AS "Email", {_PHONE_SQL} AS "Phone",
    {choose(list(CITIES), 'k')} AS "City", {choose(list(STATES), 'k')} AS "Status",
    concat(CAST(k * 37 % 1000 // 10 AS VARCHAR), '.', CAST(k * 37 % 10 AS VARCHAR)) AS "Score",
    {_ADDRESS_SQL} AS "Last Seen IP",
    concat('contact ', CASE WHEN email = '' THEN 'unknown' ELSE email END, ' re order ', CAST(k AS VARCHAR)) AS "Notes"
    FROM mailed""",
)
def made_contacts(spark, sf_dir):
    """A contact per customer key."""
    return contacts(table(spark, sf_dir, "customer"), "c_custkey")


_CARD_SQL = f"""concat({_spread_sql(1009, 1000, 9999)}, ' ', {_spread_sql(2003, 1000, 9999)}, ' ',
    {_spread_sql(3001, 1000, 9999)}, ' ', {_spread_sql(4007, 1000, 9999)})"""


@query(
    "tickets",
    f"""WITH named AS (SELECT o_orderkey AS k, {choose(list(FIRST_NAMES), 'o_orderkey')} AS first,
      {choose(list(LAST_NAMES), 'o_orderkey')} AS last FROM orders),
    mailed AS (SELECT *, {_email_sql('first', 'last')} AS email, {_email_sql('last', 'first', '(k + 7)')} AS other,
      {_PHONE_SQL} AS phone, {_ADDRESS_SQL} AS host, {_CARD_SQL} AS card,
      concat('https://support.', {choose(list(DOMAINS), 'k')}, '/t/', CAST(k AS VARCHAR)) AS url FROM named)
    SELECT printf('TKT-%06d', k) AS "TicketID", {choose(list(PRIORITIES), 'k')} AS "Priority",
    concat('Issue with order ', CAST(k + 9000 AS VARCHAR)) AS "Subject",
    CASE k % 6 WHEN 0 THEN concat('Sign-in by ', email, ' failed from ', host, ' at 09:', printf('%02d', k % 60), '.')
      WHEN 1 THEN concat('Card ', card, ' to be refunded; call ', phone, ' this week.')
      WHEN 2 THEN concat('Trace at ', url, ' was sent by ', email)
      WHEN 3 THEN concat('Same as the ticket from ', email, ' (', phone, ').')
      WHEN 4 THEN 'Pages load slowly; no personal data here.'
      ELSE concat('Escalated by ', email, ', copy to ', other, ', host ', host, ', ref #', CAST(k + 100000 AS VARCHAR), '.')
    END AS "Body", {_email_sql('last', "'support'")} AS "Assignee" FROM mailed""",
)
def made_tickets(spark, sf_dir):
    """A ticket per order key."""
    return tickets(table(spark, sf_dir, "orders"), "o_orderkey")


@query(
    "hidden_columns",
    "SELECT event_id, user_id FROM events",
)
def hidden_columns(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("event_id", "value AS __value", "user_id", "props AS __p")
    return hide_internal(events)
