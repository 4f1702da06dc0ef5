"""What the operators of this subpackage share: reading tables, tables written to cut lineage, and workers that give back memory."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.pinned import pinned, shared_dir

#: df written to the shared folder as Parquet and read back: its lineage ends there, so a lost executor costs no recomputation beyond it.
staged = pinned

__all__ = ["returning", "shared_dir", "staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    """The C library's way to give freed memory back, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def returning(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, at whose end a worker gives back what it has freed: it lives on, idle or with the tasks of other stages."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(found)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return batches
