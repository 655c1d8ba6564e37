"""What can be picked: the files below a prefix, and how that changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.functions.text import extension_of, human_size
from rulewright.sources.tables import EXTENSIONS


def catalogue(listing: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Selectable files, newest first, of a listing (path, length, modificationTime).

    Folder markers go; files without a date come before all others.
    """
    kind = extension_of(F.col("path"))
    picked = listing.where(~F.col("path").endswith("/"))
    if extensions:
        picked = picked.where(kind.isin(list(extensions)))
    return picked.select(
        F.col("path").alias("key"),
        F.substring_index("path", "/", -1).alias("name"),
        F.col("length").alias("size"),
        human_size(F.col("length")).alias("size_human"),
        kind.alias("extension"),
        F.col("modificationTime").alias("last_modified"),
    ).orderBy(F.col("last_modified").desc_nulls_first(), F.col("key").desc())


def inventory(listing: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """The selectable files of a listing, one row per key: key, size, last_modified.

    A key that is listed more than once counts with its newest entry, of equally new ones
    with the largest size.  Files without a date are older than all others.  The listing may
    be a table of its own, such as an object store's inventory report; no file is looked at.
    """
    files = catalogue(listing, extensions).where(F.col("key").isNotNull())
    newest = F.max(F.struct("last_modified", "size")).alias("newest")
    return files.groupBy("key").agg(newest).select("key", "newest.size", "newest.last_modified")


def compare_inventories(old: DataFrame, new: DataFrame) -> DataFrame:
    """What became of every key between two inventories: key, change, size, last_modified,
    old_size, old_modified.

    ``change`` is added, gone, changed (other size or date) or same.  One full outer join by
    key, which is unique on both sides, so no key is hot.
    """
    before = old.select("key", F.col("size").alias("old_size"), F.col("last_modified").alias("old_modified"), F.lit(True).alias("was"))
    after = new.select("key", "size", "last_modified", F.lit(True).alias("is"))
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("last_modified").eqNullSafe(F.col("old_modified"))
    change = (
        F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "gone").when(same, "same").otherwise("changed")
    )
    return before.join(after, "key", "full_outer").select(
        "key", change.alias("change"), "size", "last_modified", "old_size", "old_modified"
    )


def update_inventory(spark: SparkSession, listing: DataFrame, folder: str, generation: int, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Write the inventory of ``listing`` as a generation below ``folder`` and return what changed
    since the generation before, also written; generation 0 has only added files.

    A generation that is written again is replaced, so an update that died can be repeated.
    """
    path = f"{folder}/inventory/generation={generation}"
    inventory(listing, extensions).write.mode("overwrite").parquet(path)
    now = spark.read.parquet(path)
    before = spark.read.parquet(f"{folder}/inventory/generation={generation - 1}") if generation else now.limit(0)
    changes = f"{folder}/changes/generation={generation}"
    compare_inventories(before, now).where("change <> 'same'").write.mode("overwrite").parquet(changes)
    return spark.read.parquet(changes)


def list_files(
    spark: SparkSession, prefix: str, extensions: Sequence[str] = EXTENSIONS
) -> DataFrame:
    """Catalogue of a folder and everything below it; no file content is read."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(prefix)
        .select("path", "length", "modificationTime")
    )
    return catalogue(listing, extensions)
