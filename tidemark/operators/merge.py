"""How a page of a table and the log window around it become one frame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.spec import TableSpec
from tidemark.sources.base import ChangeSource
from tidemark.sources.frames import DUMP


def superseded_keys(chunk: DataFrame, window: DataFrame, spec: TableSpec) -> DataFrame:
    """Distinct whole keys that both have."""
    keys = list(spec.pk_columns)
    return chunk.select(*keys).join(window.select(*keys).distinct(), keys, "left_semi")


def supersede(chunk: DataFrame, window: DataFrame | None, spec: TableSpec) -> DataFrame:
    """The chunk without rows whose whole key the window carries; rows without a key value are kept.

    One join; the side joined is keys only, and Spark decides from its size at
    run time whether to broadcast it.
    """
    if window is None:
        return chunk
    keys = list(spec.pk_columns)
    return chunk.join(window.select(*keys).distinct(), keys, "left_anti").select(*chunk.columns)


def merge_order(spec: TableSpec) -> list:
    """Window events first, in commit order, then dump rows in key order."""
    return [(F.col("operation") == DUMP).asc(), "start_lsn", "seqval", "operation", *spec.pk_columns]


def merge_chunk(source: ChangeSource, chunk: DataFrame, window: DataFrame | None, low: datetime, spec: TableSpec) -> DataFrame:
    """One frame of the event schema: the window, then what it leaves of the chunk, dated by the low watermark."""
    events = source.to_events(supersede(chunk, window, spec), spec, low)
    if window is None:
        return events.orderBy(*spec.pk_columns)
    if [(f.name, f.dataType) for f in window.schema] != [(f.name, f.dataType) for f in events.schema]:
        raise ValueError(f"{spec.qualified_name}: window and chunk have different schemas")
    return window.unionAll(events).orderBy(*merge_order(spec))
