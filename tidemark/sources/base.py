"""What a change source can do, the registry of sources, and the guards that all of them share."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from types import TracebackType
from typing import Protocol, Self

from pyspark.sql import DataFrame

from tidemark.plans.spec import TableSpec


class ChangeSource(Protocol):
    """A keyed table with a change log. The run operators use nothing else of a source."""

    def connect(self) -> Self: ...
    def close(self) -> None: ...
    def __enter__(self) -> Self: ...
    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None: ...

    def inspect(self, schema: str, table: str) -> TableSpec:
        """The table's spec, from the catalog, validated."""

    def get_max_lsn(self) -> bytes:
        """The position that the log consumer has reached."""

    def get_min_lsn(self, capture_instance: str) -> bytes:
        """The lowest position that the log still holds."""

    def increment_lsn(self, lsn: bytes) -> bytes: ...

    def watermark(self) -> datetime:
        """A mark on the source's clock (a barrier, not an event-time watermark)."""

    def await_watermark(self, mark: datetime) -> None:
        """Returns when the log consumer has passed the mark; TimeoutError at the deadline."""

    def read_event_log(self, spec: TableSpec, from_lsn: bytes, to_lsn: bytes, ordered: bool = True) -> DataFrame | None:
        """Events of the closed interval in commit order (in any, if that is not wanted), or None if there are none."""

    def to_events(self, rows: DataFrame, spec: TableSpec, commit_timestamp: datetime | None) -> DataFrame:
        """Table rows in the event schema."""

    def read_table(self, spec: TableSpec, start_pk: int | None = None, end_pk: int | None = None, limit: int = 0, ordered: bool = True) -> DataFrame:
        """Rows with start_pk <= leading key < end_pk, the first by key up to limit (0: all), in key order (in any, if that is not wanted)."""

    def read_pk_range(self, spec: TableSpec) -> tuple[int, int] | None:
        """Least and greatest leading key, or None on an empty table."""


_sources: dict[str, Callable[..., ChangeSource] | None] = {"postgres": None}


def register_source(kind: str, build: Callable[..., ChangeSource]) -> None:
    _sources[kind] = build


def build_source(kind: str, *args: object, **options: object) -> ChangeSource:
    """A source by its kind; "postgres" is a known kind that has no implementation."""
    if kind not in _sources:
        raise ValueError(f"unknown source kind {kind!r}; known: {', '.join(sorted(_sources))}")
    build = _sources[kind]
    if build is None:
        raise NotImplementedError(f"source kind {kind!r} is not implemented")
    return build(*args, **options)


def identifier(name: str, kind: str) -> str:
    """name, if it is safe to stand in generated text."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"Invalid {kind} name: {name!r}")
    return name


def check_spec(spec: TableSpec) -> None:
    if not spec.pk_columns:
        raise ValueError(f"{spec.qualified_name} has no key columns to read by")
    if not spec.captured_columns:
        raise ValueError(f"{spec.qualified_name} has no columns to read")


def check_page(start_pk: int | None, end_pk: int | None, limit: int) -> None:
    if limit < 0:
        raise ValueError(f"limit must not be negative, got {limit}")
    if start_pk is not None and end_pk is not None and start_pk >= end_pk:
        raise ValueError(f"empty key range: [{start_pk}, {end_pk})")


def check_floor(lsn: bytes | None, capture_instance: str) -> bytes:
    """The retention floor; none, or all zeros (which any position would pass), is refused."""
    if not lsn or not any(lsn):
        raise ValueError(f"no retention floor for capture instance {capture_instance!r}")
    return lsn
