"""From raw documents to packed token sequences: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from rulewright.llm.common import free_name, stored, table
from rulewright.llm.queries import tokenizer_path


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``."""
    name = free_name(docs, "__gone")
    gone = ids.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier samples."""
    return quality.judge(docs, table(spark, sf_dir, "labels"), clear=True)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in one document; n_chars follows the text.  No document goes."""
    done = line_dedup.drop_shared_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Rows without doc_id stay; rows that repeat a doc_id share its fate.
    """
    groups = jaccard_join.near_copies(docs)
    return _without(docs, groups.where(F.col("doc_id") != F.col("component_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in their sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line dedup", drop_lines),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_tokens),
]

#: SQL cannot express the classifier, the similarity join or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
