"""A change source over JDBC: query text for the server, read by Spark's JDBC relation.

Only text is built here and a relation is declared on it; no driver is
bundled.  Names are guarded and bracketed, values are typed literals, and every
statement is logged at DEBUG.  Whole tables, key ranges and log windows are
read by ``partitions`` connections at once, each a range of keys or positions;
a page with a limit is one statement.

Times of day come as nanoseconds since midnight.  Timestamps of more than six
digits are refused by the server's own conversion error where the seventh is
not 0, as frames hold microseconds.
"""

from __future__ import annotations

import logging
import time
from datetime import datetime
from typing import Self

from pyspark.sql import DataFrame, Row, SparkSession

from tidemark.functions.lsn import WIDTH, successor, to_lsn
from tidemark.functions.pinned import pinned
from tidemark.plans.schema import conform, event_schema, row_schema, validate
from tidemark.plans.spec import ColumnSpec, TableSpec
from tidemark.sources.base import check_floor, check_page, check_spec, identifier, register_source
from tidemark.sources.frames import stamped

logger = logging.getLogger(__name__)

PAGINATIONS = ("fetch", "top")
#: Types that are written with a length that the catalog's precision does not give, and those with a scale alone.
LONG = {"char": "nvarchar(max)", "varchar": "nvarchar(max)", "nchar": "nvarchar(max)", "nvarchar": "nvarchar(max)", "text": "nvarchar(max)", "ntext": "nvarchar(max)", "xml": "nvarchar(max)",
        "sysname": "nvarchar(128)", "binary": "varbinary(max)", "varbinary": "varbinary(max)", "image": "varbinary(max)", "timestamp": "binary(8)", "rowversion": "binary(8)"}
SCALED = {"datetime2", "datetimeoffset", "time"}


def quoted(name: str, kind: str = "column") -> str:
    return f"[{identifier(name, kind)}]"


def server_type(column: ColumnSpec) -> str:
    """A column's type in statement text."""
    if column.kind in LONG:
        return LONG[column.kind]
    if column.kind in ("decimal", "numeric"):
        return f"{column.kind}({column.precision},{column.scale})"
    return f"{column.kind}({column.scale})" if column.kind in SCALED else column.kind


def column_text(column: ColumnSpec, computed: bool = False) -> str:
    """A column as it is selected; a computed one as a NULL of its type."""
    name = quoted(column.name)
    if computed:
        return f"CAST({'NULL AS bigint' if column.kind == 'time' else f'NULL AS {server_type(column)}'}) AS {name}"
    if column.kind == "time":
        return f"DATEDIFF_BIG(NANOSECOND, CAST('00:00:00' AS time(7)), {name}) AS {name}"
    if column.kind in ("datetime2", "datetimeoffset") and column.scale > 6:
        lossy = f"CAST('{column.name} has more digits than a frame holds' AS {server_type(column)})"
        return f"CASE WHEN DATEPART(NANOSECOND, {name}) % 1000 <> 0 THEN {lossy} ELSE {name} END AS {name}"
    return name


def table_query(spec: TableSpec, start_pk: int | None = None, end_pk: int | None = None, limit: int = 0, pagination: str = "fetch") -> str:
    """Text that reads one page: captured columns, computed ones NULL, in key order."""
    check_spec(spec)
    check_page(start_pk, end_pk, limit)
    shown = ", ".join(column_text(c, c.computed_definition is not None) for c in spec.captured_columns)
    lead = quoted(spec.pk_columns[0])
    tests = [f"{lead} {op} {int(v)}" for op, v in ((">=", start_pk), ("<", end_pk)) if v is not None]
    text = f"SELECT {f'TOP ({int(limit)}) ' if limit and pagination == 'top' else ''}{shown} FROM {quoted(spec.source_schema, 'schema')}.{quoted(spec.source_table, 'table')}"
    if tests:
        text += " WHERE " + " AND ".join(tests)
    text += " ORDER BY " + ", ".join(quoted(k) for k in spec.pk_columns)
    if limit and pagination == "fetch":
        text += f" OFFSET 0 ROWS FETCH NEXT {int(limit)} ROWS ONLY"
    return text


def event_query(spec: TableSpec, from_lsn: bytes, to_lsn: bytes) -> str:
    """Text that reads the closed interval of the log, after images only, with commit times."""
    check_spec(spec)
    if spec.capture_instance is None:
        raise ValueError(f"{spec.qualified_name} has no capture instance to read a log from")
    instance = identifier(spec.capture_instance, "capture instance")
    meta = ["start_lsn", "seqval", "operation", "update_mask"]
    shown = [f"[__${m}] AS [{m}]" for m in meta] + ["sys.fn_cdc_map_lsn_to_time([__$start_lsn]) AS [commit_timestamp]"] + [column_text(c) for c in spec.captured_columns]
    return f"SELECT {', '.join(shown)} FROM cdc.fn_cdc_get_all_changes_{instance}(0x{from_lsn.hex()}, 0x{to_lsn.hex()}, N'all')"


def key_range_query(spec: TableSpec) -> str:
    check_spec(spec)
    lead = quoted(spec.pk_columns[0])
    return f"SELECT MIN({lead}) AS [low], MAX({lead}) AS [high] FROM {quoted(spec.source_schema, 'schema')}.{quoted(spec.source_table, 'table')}"


def key_predicates(spec: TableSpec, low: int, high: int, parts: int) -> list[str]:
    """Conditions that part the keys from low to high (included) into ranges of about equal width, each key in one."""
    lead, width = quoted(spec.pk_columns[0]), -(-(high - low + 1) // parts)
    return [f"{lead} >= {at} AND {lead} < {min(at + width, high + 1)}" for at in range(low, high + 1, width)]


def window_predicates(from_lsn: bytes, to_lsn_: bytes, parts: int) -> list[str]:
    """Conditions that part a closed interval of positions into closed intervals."""
    low, high = (int.from_bytes(x, "big") for x in (from_lsn, to_lsn_))
    width = -(-(high - low + 1) // parts)
    ends = [(at, min(at + width - 1, high)) for at in range(low, high + 1, width)]
    return [f"[start_lsn] >= 0x{to_lsn(a).hex()} AND [start_lsn] <= 0x{to_lsn(b).hex()}" for a, b in ends]


class JdbcSource:
    """A server with change capture, reached by a JDBC url."""

    def __init__(
        self, spark: SparkSession, url: str, user: str | None = None, password: str | None = None, driver: str | None = None, encrypt: str = "yes",
        trust_server_certificate: str = "yes", application_name: str = "tidemark", watermark_timeout: float = 120.0, watermark_poll: float = 1.0, pagination: str = "fetch",
        partitions: int = 1,
    ):
        if pagination not in PAGINATIONS:
            raise ValueError(f"pagination must be one of {PAGINATIONS}, not {pagination!r}")
        if partitions < 1:
            raise ValueError(f"partitions must be at least 1, not {partitions}")
        self.spark, self.timeout, self.poll, self.pagination, self.partitions = spark, watermark_timeout, watermark_poll, pagination, partitions
        given = {"url": url, "user": user, "password": password, "driver": driver, "encrypt": "true" if encrypt == "yes" else "false"}
        given |= {"trustServerCertificate": "true" if trust_server_certificate == "yes" else "false", "applicationName": application_name}
        self.options = {k: v for k, v in given.items() if v is not None}
        self.connected = False

    def connect(self) -> Self:
        self.connected = True  # Spark opens and closes connections itself
        return self

    def close(self) -> None:
        self.connected = False

    def __enter__(self) -> Self:
        return self.connect()

    def __exit__(self, *_: object) -> None:
        self.close()

    def _read(self, query: str) -> DataFrame:
        # prepareQuery-free form: an ORDER BY may not stand in the subquery that "query" makes, so the sort is put on by Spark as well.
        text, _, order = query.partition(" ORDER BY ")
        if "FETCH NEXT" in order or "TOP (" in text:
            text = query
        logger.debug(f"statement: {text}")
        return self.spark.read.format("jdbc").options(**self.options, query=text).load()

    def _read_in_parts(self, query: str, predicates: list[str]) -> DataFrame:
        text, _, _ = query.partition(" ORDER BY ")
        if len(predicates) < 2:
            return self._read(text)
        logger.debug(f"statement, in {len(predicates)} parts: {text}")
        rest = {k: v for k, v in self.options.items() if k != "url"}
        return self.spark.read.jdbc(self.options["url"], f"({text}) AS part", predicates=predicates, properties=rest)

    def _first(self, query: str) -> Row | None:
        return self._read(query).first()

    def inspect(self, schema: str, table: str) -> TableSpec:
        where = f"s.name = N'{identifier(schema, 'schema')}' AND t.name = N'{identifier(table, 'table')}'"
        tables = "sys.tables t JOIN sys.schemas s ON s.schema_id = t.schema_id"
        keys = self._read(
            f"SELECT c.name, k.key_ordinal FROM {tables} JOIN sys.indexes i ON i.object_id = t.object_id AND i.is_primary_key = 1 "
            f"JOIN sys.index_columns k ON k.object_id = i.object_id AND k.index_id = i.index_id JOIN sys.columns c ON c.object_id = k.object_id AND c.column_id = k.column_id WHERE {where}"
        ).orderBy("key_ordinal").collect()
        if not keys:
            raise ValueError(f"{schema}.{table} does not have primary key columns")
        columns = self._columns(where)
        found = self._first(f"SELECT ct.capture_instance FROM cdc.change_tables ct JOIN {tables} ON t.object_id = ct.source_object_id WHERE {where}")
        pk = [r["name"] for r in keys]
        if found is None:
            return TableSpec(schema, table, pk, columns, columns)
        instance = identifier(found[0], "capture instance")
        formulas = {c.name: c.computed_definition for c in columns}
        captured = [c for c in self._columns(f"s.name = N'cdc' AND t.name = N'{instance}_CT'") if not c.name.startswith("__$")]
        captured = [ColumnSpec(c.name, c.type_name, c.precision, c.scale, formulas.get(c.name)) for c in captured]
        if computed := [c.name for c in captured if c.computed_definition is not None]:
            logger.info(f"{schema}.{table}: computed columns read NULL: {', '.join(computed)}")
        spec = TableSpec(schema, table, pk, columns, captured, instance)
        validate(spec)
        return spec

    def _columns(self, where: str) -> list[ColumnSpec]:
        rows = self._read(
            "SELECT c.column_id, c.name, y.name AS type_name, CAST(c.precision AS int) AS precision, CAST(c.scale AS int) AS scale, d.definition FROM sys.tables t "
            "JOIN sys.schemas s ON s.schema_id = t.schema_id JOIN sys.columns c ON c.object_id = t.object_id JOIN sys.types y ON y.user_type_id = c.user_type_id "
            f"LEFT JOIN sys.computed_columns d ON d.object_id = c.object_id AND d.column_id = c.column_id WHERE {where}"
        ).orderBy("column_id").collect()
        return [ColumnSpec(r["name"], r["type_name"], r["precision"], r["scale"], r["definition"]) for r in rows]

    def get_max_lsn(self) -> bytes:
        row = self._first("SELECT sys.fn_cdc_get_max_lsn() AS lsn")
        if row is None or row[0] is None:
            raise ValueError("the log has no position yet")
        return bytes(row[0])

    def get_min_lsn(self, capture_instance: str) -> bytes:
        row = self._first(f"SELECT sys.fn_cdc_get_min_lsn(N'{identifier(capture_instance, 'capture instance')}') AS lsn")
        return check_floor(bytes(row[0]) if row and row[0] is not None else None, capture_instance)

    def map_lsn_to_timestamp(self, lsn: bytes) -> datetime | None:
        """When a position was committed, if the server knows it."""
        if len(lsn) != WIDTH:
            raise ValueError(f"a log position has {WIDTH} bytes, not {len(lsn)}")
        row = self._first(f"SELECT sys.fn_cdc_map_lsn_to_time(0x{lsn.hex()}) AS at")
        return row[0] if row else None

    def increment_lsn(self, lsn: bytes) -> bytes:
        return successor(lsn)

    def watermark(self) -> datetime:
        return self._first("SELECT SYSDATETIME() AS now")[0]

    def await_watermark(self, mark: datetime) -> None:
        at = f"CAST('{mark.isoformat(sep=' ')}' AS datetime2)"
        text = (
            f"SELECT TOP (1) CASE WHEN start_time > {at} OR (empty_scan_count > 0 AND end_time > {at}) THEN 1 ELSE 0 END AS passed "
            "FROM sys.dm_cdc_log_scan_sessions WHERE session_id > 0 ORDER BY end_time DESC"
        )
        deadline = time.monotonic() + self.timeout
        while time.monotonic() < deadline:
            row = self._first(text)
            if row and row[0]:
                return
            time.sleep(self.poll)
        raise TimeoutError(f"the log consumer did not pass {mark} within {self.timeout} s")

    def read_event_log(self, spec: TableSpec, from_lsn: bytes, to_lsn: bytes, ordered: bool = True) -> DataFrame | None:
        rows = self._read_in_parts(event_query(spec, from_lsn, to_lsn), window_predicates(from_lsn, to_lsn, self.partitions))
        events = pinned(conform(rows, event_schema(spec), f"log of {spec.qualified_name}"))
        if events.isEmpty():
            return None
        return events.orderBy("start_lsn", "seqval", "operation") if ordered else events

    def to_events(self, rows: DataFrame, spec: TableSpec, commit_timestamp: datetime | None) -> DataFrame:
        return stamped(rows, spec, commit_timestamp)

    def read_table(self, spec: TableSpec, start_pk: int | None = None, end_pk: int | None = None, limit: int = 0, ordered: bool = True) -> DataFrame:
        query = table_query(spec, start_pk, end_pk, limit, self.pagination)
        rows = self._read_in_parts(query, self._key_ranges(spec, start_pk, end_pk)) if not limit else self._read(query)
        if ordered:
            rows = rows.orderBy(*[k for k in spec.pk_columns if k in rows.columns])
        return conform(rows, row_schema(spec), f"rows of {spec.qualified_name}")

    def _key_ranges(self, spec: TableSpec, start_pk: int | None, end_pk: int | None) -> list[str]:
        """Conditions by which a key range is read in parts; rows that come beyond the known keys meanwhile belong to the last."""
        if self.partitions == 1 or spec.pk_columns[0] not in spec.business_columns:
            return []
        known = self.read_pk_range(spec)
        if known is None:
            return []
        low = known[0] if start_pk is None else max(start_pk, known[0])
        high = known[1] if end_pk is None else min(end_pk - 1, known[1])
        found = key_predicates(spec, low, high, self.partitions) if low <= high else []
        if len(found) > 1:
            found[0], found[-1] = found[0].partition(" AND ")[2], found[-1].partition(" AND ")[0]
        return found

    def read_pk_range(self, spec: TableSpec) -> tuple[int, int] | None:
        row = self._first(key_range_query(spec))
        if row["low"] is not None and not isinstance(row["low"], int):
            raise ValueError(f"{spec.qualified_name}: leading key {spec.pk_columns[0]!r} is not an integer")
        return None if row["low"] is None else (row["low"], row["high"])


register_source("jdbc", JdbcSource)
register_source("mssql", JdbcSource)
