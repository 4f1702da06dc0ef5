"""Change sources over DataFrames: a snapshot of a table, its log, and the source's clock.

Anything that Spark reads can stand behind them: Parquet folders, catalog
tables, JDBC relations.  All reads are plans; only scalars come to the driver.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Self

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.lsn import ZERO, binary, mask_width, successor
from tidemark.functions.pinned import pinned
from tidemark.plans.schema import conform, event_schema, row_schema, validate
from tidemark.plans.spec import ColumnSpec, TableSpec
from tidemark.sources.base import check_floor, check_page, check_spec, identifier, register_source

logger = logging.getLogger(__name__)

DUMP, DELETE, INSERT, BEFORE, AFTER = range(5)
LOG_COLUMNS = {"__$start_lsn": "start_lsn", "__$seqval": "seqval", "__$operation": "operation", "__$update_mask": "update_mask"}
#: Pages larger than this are bounded by counting keys, without sorting them in one task.
SORTED_PAGE = 100_000
BINS = 4096

SOURCE_TYPES = {
    T.LongType: "bigint", T.IntegerType: "int", T.ShortType: "smallint", T.ByteType: "smallint", T.BooleanType: "bit", T.DoubleType: "float", T.FloatType: "real",
    T.DateType: "date", T.StringType: "nvarchar", T.BinaryType: "varbinary", T.TimestampNTZType: "datetime2", T.TimestampType: "datetimeoffset",
}


def columns_of(schema: T.StructType) -> list[ColumnSpec]:
    """Column specs of a Spark schema."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            out.append(ColumnSpec(f.name, "decimal", f.dataType.precision, f.dataType.scale))
        elif type(f.dataType) in SOURCE_TYPES:
            out.append(ColumnSpec(f.name, SOURCE_TYPES[type(f.dataType)], 0, 6 if "Timestamp" in type(f.dataType).__name__ else 0))
        else:
            out.append(ColumnSpec(f.name, f.dataType.simpleString()))
    return out


@dataclass
class CapturedTable:
    """A table and what its catalog and log say; columns default to those of the frames."""

    rows: DataFrame
    pk_columns: Sequence[str]
    log: DataFrame | None = None
    capture_instance: str | None = None
    columns: Sequence[ColumnSpec] | None = None
    captured_columns: Sequence[ColumnSpec] | None = None
    computed: Mapping[str, str] = field(default_factory=dict)
    min_lsn: bytes | Callable[[], bytes | None] | None = None


def _now(value: object) -> object:
    return value() if callable(value) else value


class FrameSource:
    """A source whose tables, log positions, clock and capture sessions are given; callables are asked anew each time."""

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, CapturedTable],
        lsn_times: DataFrame | None = None,
        max_lsn: bytes | Callable[[], bytes | None] | None = None,
        clock: Callable[[], datetime] | None = None,
        sessions: DataFrame | Callable[[], DataFrame] | None = None,
        watermark_timeout: float = 120.0,
        watermark_poll: float = 1.0,
    ):
        self.spark, self.tables, self.lsn_times, self.max_lsn = spark, dict(tables), lsn_times, max_lsn
        self.clock, self.sessions, self.timeout, self.poll = clock, sessions, watermark_timeout, watermark_poll
        self.connected = False
        self._bins: dict[str, tuple[int, int, list[tuple[int, int]]]] = {}

    def connect(self) -> Self:
        self.connected = True
        return self

    def close(self) -> None:
        self.connected = False

    def __enter__(self) -> Self:
        return self.connect()

    def __exit__(self, *_: object) -> None:
        self.close()

    def _table(self, schema: str, table: str) -> CapturedTable:
        name = f"{identifier(schema, 'schema')}.{identifier(table, 'table')}"
        if name not in self.tables or not self.tables[name].pk_columns:
            raise ValueError(f"{name} does not have primary key columns")
        return self.tables[name]

    def inspect(self, schema: str, table: str) -> TableSpec:
        own = self._table(schema, table)
        columns = list(own.columns if own.columns is not None else columns_of(own.rows.schema))
        columns = [ColumnSpec(c.name, c.type_name, c.precision, c.scale, own.computed.get(c.name, c.computed_definition)) for c in columns]
        if own.capture_instance is None:
            return TableSpec(schema, table, own.pk_columns, columns, columns)
        captured = own.captured_columns
        if captured is None:
            fields = [f for f in own.log.schema.fields if not f.name.startswith("__$") and f.name != "commit_timestamp"]
            by_name = {c.name: c for c in columns}
            captured = [by_name.get(f.name, columns_of(T.StructType([f]))[0]) for f in fields]
        formulas = {c.name: c.computed_definition for c in columns if c.computed_definition is not None}
        if formulas:
            logger.info(f"{schema}.{table}: computed columns read NULL: {', '.join(formulas)}")
        captured = [ColumnSpec(c.name, c.type_name, c.precision, c.scale, formulas.get(c.name)) for c in captured]
        spec = TableSpec(schema, table, own.pk_columns, columns, captured, own.capture_instance)
        validate(spec)
        return spec

    def get_max_lsn(self) -> bytes:
        found = _now(self.max_lsn)
        if found is None and self.max_lsn is None:
            tops = [t.log.agg(F.max("`__$start_lsn`")).first()[0] for t in self.tables.values() if t.log is not None]
            found = max((bytes(t) for t in tops if t is not None), default=None)
        if not found:
            raise ValueError("the log has no position yet")
        return bytes(found)

    def get_min_lsn(self, capture_instance: str) -> bytes:
        own = [t for t in self.tables.values() if t.capture_instance == capture_instance]
        if not own:
            raise ValueError(f"no capture instance {capture_instance!r}")
        found = _now(own[0].min_lsn)
        if found is None and own[0].min_lsn is None:
            found = own[0].log.agg(F.min("`__$start_lsn`")).first()[0]
        return check_floor(bytes(found) if found else None, capture_instance)

    def map_lsn_to_timestamp(self, lsn: bytes) -> datetime | None:
        """When a position was committed, if it is known."""
        if self.lsn_times is None:
            return None
        row = self.lsn_times.where(F.col("start_lsn") == binary(lsn)).select("commit_timestamp").first()
        return row[0] if row else None

    def increment_lsn(self, lsn: bytes) -> bytes:
        return successor(lsn)

    def watermark(self) -> datetime:
        if self.clock is not None:
            return self.clock()
        return self.spark.sql("SELECT cast(current_timestamp() AS timestamp_ntz)").first()[0]

    def capture_passed(self, mark: datetime) -> bool:
        """Whether the latest scan session shows that everything up to the mark is in the log."""
        if self.sessions is None:
            return True
        found = _now(self.sessions).where("session_id > 0").orderBy(F.col("end_time").desc()).limit(1)
        at = F.lit(mark).cast("timestamp_ntz")
        passed = (F.col("start_time") > at) | (F.col("empty_scan_count") > 0) & (F.col("end_time") > at)
        row = found.select(F.when(passed, 1).otherwise(0)).first()
        return bool(row and row[0])

    def await_watermark(self, mark: datetime) -> None:
        deadline = time.monotonic() + self.timeout
        while time.monotonic() < deadline:
            if self.capture_passed(mark):
                return
            time.sleep(self.poll)
        raise TimeoutError(f"the log consumer did not pass {mark} within {self.timeout} s")

    def read_event_log(self, spec: TableSpec, from_lsn: bytes, to_lsn: bytes, ordered: bool = True) -> DataFrame | None:
        check_spec(spec)
        if spec.capture_instance is None:
            raise ValueError(f"{spec.qualified_name} has no capture instance to read a log from")
        log = self._table(spec.source_schema, spec.source_table).log
        start = F.col("`__$start_lsn`")
        events = log.where((start >= binary(from_lsn)) & (start <= binary(to_lsn)) & (F.col("`__$operation`") != BEFORE)).withColumnsRenamed(LOG_COLUMNS)
        if self.lsn_times is not None:
            events = events.drop("commit_timestamp").join(self.lsn_times.select("start_lsn", "commit_timestamp"), "start_lsn", "left")
        schema = event_schema(spec)
        events = conform(events.select(*[F.col(f"`{n}`") for n in schema.names]), schema, f"log of {spec.qualified_name}")
        events = pinned(events)  # read once; what follows reads the copy
        if events.isEmpty():
            return None
        return events.orderBy("start_lsn", "seqval", "operation") if ordered else events

    def to_events(self, rows: DataFrame, spec: TableSpec, commit_timestamp: datetime | None) -> DataFrame:
        return stamped(rows, spec, commit_timestamp)

    def read_table(self, spec: TableSpec, start_pk: int | None = None, end_pk: int | None = None, limit: int = 0, ordered: bool = True) -> DataFrame:
        check_spec(spec)
        check_page(start_pk, end_pk, limit)
        rows = self._table(spec.source_schema, spec.source_table).rows
        found = page(rows, spec, start_pk, self._upto(spec, rows, start_pk, end_pk, limit), limit, ordered)
        return conform(found, row_schema(spec), f"rows of {spec.qualified_name}")

    def _upto(self, spec: TableSpec, rows: DataFrame, start_pk: int | None, end_pk: int | None, limit: int) -> int | None:
        """A key before which a large page ends, from one count of all keys that all pages share, so that a page's end is looked for in its own key range."""
        lead = spec.pk_columns[0]
        if limit <= SORTED_PAGE or not whole_number(rows, lead):
            return end_pk
        if spec.qualified_name not in self._bins:
            low, high = rows.agg(F.min(lead), F.max(lead)).first()
            self._bins[spec.qualified_name] = (0, 1, []) if low is None else (low, *bins(rows.select(lead), lead, low, high))
        low, width, counts = self._bins[spec.qualified_name]
        seen = 0
        for at, count in counts:
            if start_pk is None or low + at * width >= start_pk:  # whole bins of the page
                seen += count
                if seen >= limit:
                    upto = low + (at + 1) * width
                    upto = upto if end_pk is None else min(upto, end_pk)
                    # The table may have lost rows since they were counted.
                    enough = rows.where(key_range(F.col(lead), start_pk, upto)).count() >= limit
                    return upto if enough else end_pk
        return end_pk

    def read_pk_range(self, spec: TableSpec) -> tuple[int, int] | None:
        check_spec(spec)
        key = spec.pk_columns[0]
        rows = self._table(spec.source_schema, spec.source_table).rows
        if not isinstance(rows.schema[key].dataType, T.IntegralType):
            raise ValueError(f"{spec.qualified_name}: leading key {key!r} is not an integer")
        low, high = rows.agg(F.min(key), F.max(key)).first()
        return None if low is None else (low, high)


def key_range(lead: Column, start_pk: int | None, end_pk: int | None) -> Column:
    out = F.lit(True)
    if start_pk is not None:
        out = out & (lead >= start_pk)
    if end_pk is not None:
        out = out & (lead < end_pk)
    return out


def whole_number(rows: DataFrame, column: str) -> bool:
    return isinstance(rows.schema[column].dataType, T.IntegralType)


def bins(keys: DataFrame, key: str, low: int, high: int) -> tuple[int, list[tuple[int, int]]]:
    """A bin's width, and the counts of at most BINS bins of integer keys from low to high, as (bin, count), in order."""
    width = -(-(high - low + 1) // BINS)
    part = keys.where((F.col(key) >= low) & (F.col(key) <= high))
    place = F.expr(f"(cast(`{key}` AS decimal(38, 0)) - cast({low} AS decimal(38, 0))) div cast({width} AS decimal(38, 0))")
    return width, [tuple(r) for r in part.groupBy(place.alias("bin")).count().orderBy("bin").collect()]


def page_end(keys: DataFrame, key: str, n: int) -> tuple[int, int] | None:
    """The n-th least of integer keys, and how many rows of that key are among the n; None if there are fewer.

    Found by counting in ever finer bins; no task holds the keys.
    """
    low, high, total = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if total < n:
        return None
    while low < high:
        width, counts = bins(keys, key, low, high)
        for at, count in counts:
            if n <= count:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            n -= count
        else:
            raise RuntimeError(f"keys of {key!r} changed while they were counted")
    return low, n


def first_rows(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The n least rows by their keys, not in order; many are bounded key column by key column, without sorting them in one task."""
    if n <= SORTED_PAGE or not whole_number(rows, keys[0]):
        return rows.orderBy(*keys).limit(n)
    end = page_end(rows.select(keys[0]), keys[0], n)
    if end is None:
        return rows
    last, left = end
    same = rows.where(F.col(keys[0]) == last)
    return rows.where(F.col(keys[0]) < last).unionAll(first_rows(same, keys[1:], left) if len(keys) > 1 else same.limit(left))


def page(rows: DataFrame, spec: TableSpec, start_pk: int | None, end_pk: int | None, limit: int, ordered: bool = True) -> DataFrame:
    """Rows of a key range in key order, at most limit of them (0: all), captured columns only, computed ones NULL."""
    found = rows.where(key_range(F.col(spec.pk_columns[0]), start_pk, end_pk))
    found = first_rows(found, spec.pk_columns, limit) if limit else found
    found = found.orderBy(*spec.pk_columns) if ordered else found
    return found.select(*[F.lit(None).alias(c.name) if c.computed_definition is not None else F.col(f"`{c.name}`") for c in spec.captured_columns])


def stamped(rows: DataFrame, spec: TableSpec, commit_timestamp: datetime | None) -> DataFrame:
    """Table rows as events: zero position and mask, so that they sort below every change, and the given time."""
    mark = F.lit(None if commit_timestamp is None else commit_timestamp.isoformat(sep=" ")).cast("timestamp_ntz")
    return rows.select(
        binary(ZERO).alias("start_lsn"), binary(ZERO).alias("seqval"), F.lit(DUMP).alias("operation"), binary(bytes(mask_width(len(spec.captured_columns)))).alias("update_mask"),
        mark.alias("commit_timestamp"), *[F.col(f"`{c}`") for c in rows.columns],
    )


def parquet_source(spark: SparkSession, tables: Mapping[str, Mapping[str, object]], lsn_times: str | None = None, **options: object) -> FrameSource:
    """A source over Parquet: per "schema.table" the paths "rows" and "log" and the other fields of CapturedTable."""
    read = spark.read.parquet
    built = {n: CapturedTable(**{k: read(v) if k in ("rows", "log") else v for k, v in t.items()}) for n, t in tables.items()}
    return FrameSource(spark, built, lsn_times=read(lsn_times) if lsn_times else None, **options)


register_source("frames", FrameSource)
register_source("parquet", parquet_source)
