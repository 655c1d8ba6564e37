"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by the size of their shingle set.  The sketch of an item is its
smallest shingle hashes, as many as its partition needs: a document that holds the
asked share of the item lacks at most the rest, so it holds one of any larger number of
shingles, and no item can be missed.  Documents that hold a hash of a sketch are
candidates, and only their texts are read again, to count the item's shingles in them
by the words themselves.

DataFrame expressions only.  Items are broadcast when they are few; otherwise the same
join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rulewright.llm.common import stored

WORDS = 5
SHARE = 0.8
#: Rows up to which a table of items is broadcast.
FEW = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    words = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+", -1)
    return F.filter(words, lambda w: w != "")


def _places(words: Column) -> Column:
    """Where shingles begin: one place for one to four words, none without words."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0))))


def shingle_hashes(words: str) -> Column:
    at = F.col(words)
    return F.transform(_places(at), lambda i: F.xxhash64(*(F.get(at, i + k) for k in range(WORDS))))


def shingle_texts(words: str) -> Column:
    at = F.col(words)
    return F.transform(_places(at), lambda i: F.array_join(F.slice(at, i + 1, WORDS), " "))


def item_shingles(items: DataFrame, share: float = SHARE) -> DataFrame:
    """item_id, shingle, hash, n_item_shingles, sketch (the hash is in the item's sketch)."""
    each = (
        items.select("item_id", word_list(F.col("text")).alias("words"))
        .select("item_id", F.explode(shingle_texts("words")).alias("shingle"))
        .distinct()
        .withColumn("hash", F.xxhash64(*(F.get(F.split("shingle", " "), F.lit(k)) for k in range(WORDS))))
    )
    one = Window.partitionBy("item_id")
    sized = each.select(
        "*", F.count("*").over(one).alias("n_item_shingles"),
        F.row_number().over(one.orderBy("hash", "shingle")).alias("rank"),
    )
    # Sizes 2^c to 2^(c+1)-1 make a partition; its largest size says how many hashes are needed.
    partition = F.floor(F.log2(F.col("n_item_shingles").cast("double")) + 1e-9)
    largest = F.pow(F.lit(2.0), partition + 1) - 1
    needed = F.floor(largest * (1 - share) + 1e-9) + 1
    return sized.select("item_id", "shingle", "hash", "n_item_shingles", (F.col("rank") <= needed).alias("sketch"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def contamination(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment for every pair whose
    document holds at least ``share`` of the item's distinct five-word shingles.

    Words are runs without white space, A-Z lower-cased; one to four words are one
    shingle; NULL and empty texts hold none and match nothing.  Rows with one doc_id
    count as one document (NULL too), items with one item_id as one item.  Other columns
    are not read.  Empty tables give no rows.
    """
    known = stored(item_shingles(items, share), "item-shingles")
    sketches = known.where("sketch").select("hash", "item_id").distinct()
    candidates = stored(
        docs.select("doc_id", word_list(F.col("text")).alias("words"))
        .select("doc_id", F.explode(shingle_hashes("words")).alias("hash"))
        .join(_small(sketches), "hash")
        .groupBy("doc_id").agg(F.collect_set("item_id").alias("items")),
        "candidates",
    )
    texts = (
        docs.select(F.col("doc_id").alias("id"), "text")
        .join(candidates, F.col("id").eqNullSafe(F.col("doc_id")))
        .select("doc_id", "items", word_list(F.col("text")).alias("words"))
        .select("doc_id", "items", F.explode(F.array_distinct(shingle_texts("words"))).alias("shingle"))
    )
    return (
        texts.join(_small(known.select("shingle", "item_id", "n_item_shingles")), "shingle")
        .where(F.array_contains("items", F.col("item_id")))
        .groupBy("doc_id", "item_id", "n_item_shingles", "shingle").agg(F.lit(1).alias("one"))
        .groupBy("doc_id", "item_id", "n_item_shingles").agg(F.count("*").alias("n_shared"))
        .where(F.col("n_shared") >= F.col("n_item_shingles") * share - 1e-9)
        .withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))
    )
