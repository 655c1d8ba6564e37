"""What the operators share: reading tables, and tables written to cut lineage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from rulewright.session import scratch_path
from rulewright.sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{name}.parquet", base=sf_dir)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again, so that nothing before it runs twice."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, **added: str) -> StructType:
    """The schema of ``df`` with more fields; ``add`` changes a schema, so a copy is made."""
    shape = StructType(list(df.schema.fields))
    for name, kind in added.items():
        shape.add(name, kind)
    return shape


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


#: What tasks of one operator leave in a Python worker for its next tasks.
_REMEMBERED: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, worked out once per Python worker and kept until a task with another ``key`` begins."""
    if key not in _REMEMBERED:
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget_others(key: Hashable) -> None:
    """Drop what is remembered under other keys.  Called by name, since a task has copies of what its functions hold."""
    for other in [k for k in _REMEMBERED if k != key]:
        del _REMEMBERED[other]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], key: Hashable = None) -> Callable:
    """``run`` for mapInArrow in a worker that holds little between tasks.

    Spark keeps a worker for tasks of any later stage, beside whose memory it counts.  What
    is remembered under other keys is dropped first, and unused memory is given back at the end.
    """

    def leanly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(key)
        try:
            yield from run(batches)
        finally:
            give_back()

    return leanly


def give_back() -> None:
    """Memory that was freed, but is still held by Arrow or the C library, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)
