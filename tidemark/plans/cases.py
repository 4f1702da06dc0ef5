"""Registered queries on guards, validation, positions and order: what a run refuses, and where it stands after each step."""

from __future__ import annotations

import io
import logging
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.log import configure_logging
from tidemark.functions.lsn import successor, to_lsn
from tidemark.functions.pinned import pinned
from tidemark.operators.merge import merge_chunk, merge_order, supersede
from tidemark.operators.run import batches, capture_batch, opening_state, state_at_lsn
from tidemark.plans import world
from tidemark.plans.catalog import BUSINESS, DUMP, EVENT, LOG, ORACLE_SQL, QUERIES, ZEROS, dump, query, spec_of, stacked
from tidemark.plans.schema import conform, event_schema, row_schema, validate
from tidemark.plans.spec import ColumnSpec, TableSpec
from tidemark.plans.state import RunState
from tidemark.plans.world import INSTANCE, KEY, SCHEMA, TABLE, shown
from tidemark.sources.base import build_source, check_floor, check_page, check_spec, identifier
from tidemark.sources.frames import CapturedTable, FrameSource
from tidemark.sources.jdbc import JdbcSource, event_query, key_range_query, table_query


def outcome(action: Callable[[], object]) -> str:
    """"done", or the kind of error that an action ends in."""
    try:
        action()
    except Exception as error:
        return "value error in Spark" if isinstance(error, PySparkException) else type(error).__name__
    return "done"


def outcomes(spark: SparkSession, actions: dict[str, Callable[[], object]]) -> DataFrame:
    return spark.createDataFrame([(name, outcome(action)) for name, action in actions.items()], "attempt string, outcome string")


def expected(rows: dict[str, str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(str(r) for r in rows.items())}) t(attempt, outcome)"


def placed(df: DataFrame) -> DataFrame:
    """df with each row's place in its order (from 0): partitions are counted, no task holds all rows.

    It is sorted once and pinned: a second sort draws other bounds, and fewer columns make other partitions.
    """
    own = pinned(df.withColumn("_id", F.monotonically_increasing_id())).withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = sorted(tuple(r) for r in own.groupBy("_part").count().collect())  # a row for each partition
    offsets, before = [], 0
    for part, n in counts:
        offsets.append((part, before))
        before += n
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return own.join(starts, "_part").withColumn("place", F.col("_before") + F.col("_row")).drop("_id", "_part", "_row", "_before")


# --- sources and their catalogs ---


@query(expected({"frames": "done", "parquet": "done", "jdbc": "done", "mssql": "done", "postgres": "NotImplementedError", "oracle": "ValueError", "other pagination": "ValueError"}))
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(
        spark,
        {
            "frames": lambda: build_source("frames", spark, {}).close(),
            "parquet": lambda: build_source("parquet", spark, {"shop.customer": {"rows": f"{sf_dir}/customer.parquet", "pk_columns": [KEY]}}),
            "jdbc": lambda: build_source("jdbc", spark, "jdbc:x").connect().close(),
            "mssql": lambda: build_source("mssql", spark, "jdbc:x").__enter__().__exit__(),
            "postgres": lambda: build_source("postgres"),
            "oracle": lambda: build_source("oracle"),
            "other pagination": lambda: JdbcSource(spark, "jdbc:x", pagination="skip"),
        },
    )


@query("SELECT * FROM (VALUES ('applicationName', 'tidemark'), ('encrypt', 'true'), ('pagination', 'fetch'), ('timeout', '120.0'), ('poll', '1.0'), ('trustServerCertificate', 'true')) t(name, value)")
def source_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = JdbcSource(spark, "jdbc:x")
    given = {k: v for k, v in own.options.items() if k != "url"} | {"pagination": own.pagination, "timeout": own.timeout, "poll": own.poll}
    return spark.createDataFrame([(k, str(v)) for k, v in given.items()], "name string, value string")


@query("SELECT count(*) AS n, min(c_custkey) AS low, max(c_custkey) AS high, sum(c_nationkey) AS nations FROM customer")
def parquet_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table through the source that is built of Parquet paths."""
    with build_source("parquet", spark, {"shop.customer": {"rows": f"{sf_dir}/customer.parquet", "pk_columns": [KEY]}}) as src:
        rows = src.read_table(src.inspect("shop", "customer"))
        return rows.agg(F.count("*").alias("n"), F.min(KEY).alias("low"), F.max(KEY).alias("high"), F.sum("c_nationkey").alias("nations"))


@query(
    "SELECT * FROM (VALUES (0, 'c_custkey', 'bigint', 0, 0, true, false), (1, 'c_name', 'nvarchar', 0, 0, false, true), (2, 'c_nationkey', 'int', 0, 0, false, false), "
    "(3, 'c_acctbal', 'decimal', 12, 2, false, false), (4, 'c_mktsegment', 'nvarchar', 0, 0, false, false)) t(place, name, type_name, prec, scale, is_key, computed)"
)
def inspected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog says of the captured columns: order, types, the key, and which are computed."""
    spec = spec_of(world.source(spark, sf_dir, [1], computed={"c_name": "concat('Customer#', c_custkey)"}))
    rows = [(i, c.name, c.type_name, c.precision, c.scale, c.name in spec.pk_columns, c.computed_definition is not None) for i, c in enumerate(spec.captured_columns)]
    return spark.createDataFrame(rows, "place int, name string, type_name string, prec int, scale int, is_key boolean, computed boolean")


@query(expected({"key and capture": "done", "no key": "ValueError", "no such table": "ValueError", "no capture": "done", "column gone": "ValueError", "no such instance": "ValueError", "zero floor": "ValueError", "empty log": "ValueError"}))
def catalog_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, log = world.rows(spark, sf_dir), world.log(spark, sf_dir)
    tables = {
        "s.whole": CapturedTable(rows, [KEY], log, "whole"),
        "s.nokey": CapturedTable(rows, []),
        "s.plain": CapturedTable(rows, [KEY]),
        "s.gone": CapturedTable(rows.drop("c_name"), [KEY], log, "gone"),
        "s.zero": CapturedTable(rows, [KEY], log, "zero", min_lsn=bytes(10)),
    }
    src = FrameSource(spark, tables)
    return outcomes(
        spark,
        {
            "key and capture": lambda: src.inspect("s", "whole"),
            "no key": lambda: src.inspect("s", "nokey"),
            "no such table": lambda: src.inspect("s", "other"),
            "no capture": lambda: src.inspect("s", "plain"),
            "column gone": lambda: src.inspect("s", "gone"),
            "no such instance": lambda: src.get_min_lsn("other"),
            "zero floor": lambda: src.get_min_lsn("zero"),
            "empty log": lambda: FrameSource(spark, {"s.e": CapturedTable(rows, [KEY], log.limit(0), "e")}).get_max_lsn(),
        },
    )


@query(f"WITH {LOG} SELECT operation, count(*) AS n, count(DISTINCT c_custkey) AS keys, max(seqval) AS last FROM log GROUP BY operation")
def change_table_as_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change table, read as a table of its own."""
    log = world.log(spark, sf_dir).withColumnsRenamed({"__$start_lsn": "start_lsn", "__$seqval": "seqval", "__$operation": "operation", "__$update_mask": "update_mask"})
    src = FrameSource(spark, {"cdc.shop_customer_CT": CapturedTable(log, [KEY])})
    rows = src.read_table(src.inspect("cdc", "shop_customer_CT"))
    return rows.groupBy("operation").agg(F.count("*").alias("n"), F.count_distinct(KEY).alias("keys"), F.hex(F.max("seqval")).alias("last"))


@query("WITH t AS (SELECT event_id // 4 + 1 AS n, max(ts) AS committed FROM events GROUP BY 1), p AS (SELECT unnest([1, 2, 77, 100, 999999999]) AS n) SELECT CAST(p.n AS BIGINT) AS n, committed FROM p LEFT JOIN t ON p.n = t.n")
def position_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When single positions were committed; null where the source does not know."""
    src = world.source(spark, sf_dir, [1])
    return spark.createDataFrame([(n, src.map_lsn_to_timestamp(to_lsn(n))) for n in (1, 2, 77, 100, 999_999_999)], "n long, committed timestamp_ntz")


@query(
    "SELECT * FROM (VALUES ('all', 'SELECT [a], CAST(NULL AS date) AS [b] FROM [s].[t] ORDER BY [a]'), "
    "('fetch', 'SELECT [a], CAST(NULL AS date) AS [b] FROM [s].[t] WHERE [a] >= 3 AND [a] < 9 ORDER BY [a] OFFSET 0 ROWS FETCH NEXT 5 ROWS ONLY'), "
    "('top', 'SELECT TOP (5) [a], CAST(NULL AS date) AS [b] FROM [s].[t] WHERE [a] >= 3 ORDER BY [a]'), "
    "('bounds', 'SELECT MIN([a]) AS [low], MAX([a]) AS [high] FROM [s].[t]'), "
    "('log', 'SELECT [__$start_lsn] AS [start_lsn], [__$seqval] AS [seqval], [__$operation] AS [operation], [__$update_mask] AS [update_mask], "
    "sys.fn_cdc_map_lsn_to_time([__$start_lsn]) AS [commit_timestamp], [a], [b] FROM cdc.fn_cdc_get_all_changes_s_t(0x00000000000000000001, 0x00000000000000000002, N''all'')')) t(statement, body)"
)
def statement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [ColumnSpec("a", "int"), ColumnSpec("b", "date", computed_definition="x")]
    spec = TableSpec("s", "t", ["a"], columns, columns, "s_t")
    texts = {
        "all": table_query(spec), "fetch": table_query(spec, 3, 9, 5), "top": table_query(spec, 3, limit=5, pagination="top"),
        "bounds": key_range_query(spec), "log": event_query(spec, to_lsn(1), to_lsn(2)),
    }
    return spark.createDataFrame(list(texts.items()), "statement string, body string")


# --- guards ---


@query("SELECT DISTINCT n_name AS name, regexp_full_match(n_name, '[A-Za-z0-9_]+') AS safe FROM nation UNION SELECT DISTINCT p_type, regexp_full_match(p_type, '[A-Za-z0-9_]+') FROM part")
def identifier_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names may stand in generated text."""
    names = world.read(spark, sf_dir, "nation").select("n_name").union(world.read(spark, sf_dir, "part").select("p_type")).distinct()
    return spark.createDataFrame([(r[0], outcome(lambda n=r[0]: identifier(n, "table")) == "done") for r in names.toLocalIterator()], "name string, safe boolean")


@query(expected({"whole": "done", "no key": "ValueError", "no columns": "ValueError", "limit -1": "ValueError", "limit 0": "done", "range 5 to 5": "ValueError", "range 6 to 5": "ValueError", "range 5 to 6": "done", "no floor": "ValueError", "floor of zeros": "ValueError", "floor": "done"}))
def read_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = [ColumnSpec("a", "int")]
    return outcomes(
        spark,
        {
            "whole": lambda: check_spec(TableSpec("s", "t", ["a"], a, a)),
            "no key": lambda: check_spec(TableSpec("s", "t", [], a, a)),
            "no columns": lambda: check_spec(TableSpec("s", "t", ["a"], a, [])),
            "limit -1": lambda: check_page(None, None, -1),
            "limit 0": lambda: check_page(None, None, 0),
            "range 5 to 5": lambda: check_page(5, 5, 0),
            "range 6 to 5": lambda: check_page(6, 5, 0),
            "range 5 to 6": lambda: check_page(5, 6, 0),
            "no floor": lambda: check_floor(None, "x"),
            "floor of zeros": lambda: check_floor(bytes(10), "x"),
            "floor": lambda: check_floor(to_lsn(1), "x"),
        },
    )


@query(expected({"sound": "done", "captured but gone": "ValueError", "type differs": "ValueError", "key not captured": "ValueError", "key computed": "ValueError", "named like metadata": "ValueError", "type unknown": "ValueError", "computed, not a key": "done"}))
def spec_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ColumnSpec("a", "int"), ColumnSpec("b", "nvarchar")
    spec = lambda columns, captured, pk=("a",): TableSpec("s", "t", pk, columns, captured, "x")
    computed, meta, odd = ColumnSpec("a", "int", computed_definition="1"), ColumnSpec("seqval", "binary"), ColumnSpec("b", "geometry")
    cases = {
        "sound": spec([a, b], [b, a]), "captured but gone": spec([a], [a, b]), "type differs": spec([a, ColumnSpec("b", "int")], [a, b]), "key not captured": spec([a, b], [b]),
        "key computed": spec([a, b], [computed, b]), "named like metadata": spec([a, meta], [a, meta]), "type unknown": spec([a, odd], [a, odd]),
        "computed, not a key": spec([a, b], [a, ColumnSpec("b", "nvarchar", computed_definition="x")]),
    }
    return outcomes(spark, {name: lambda s=s: validate(s) for name, s in cases.items()})


@query(
    "SELECT 'o_totalprice to decimal(12,2)' AS attempt, CASE WHEN bool_and(CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) = o_totalprice) THEN 'done' ELSE 'value error in Spark' END AS outcome FROM orders "
    "UNION ALL SELECT 'l_quantity to int', CASE WHEN bool_and(l_quantity = floor(l_quantity)) THEN 'done' ELSE 'value error in Spark' END FROM lineitem "
    "UNION ALL SELECT 'l_discount to int', CASE WHEN bool_and(l_discount = floor(l_discount)) THEN 'done' ELSE 'value error in Spark' END FROM lineitem "
    "UNION ALL SELECT 'o_orderkey to smallint', CASE WHEN max(o_orderkey) < 32768 THEN 'done' ELSE 'value error in Spark' END FROM orders "
    "UNION ALL SELECT 'n_name to int', 'value error in Spark' UNION ALL SELECT 'n_nationkey to string', 'done' "
    "UNION ALL SELECT 'o_orderdate to date', CASE WHEN bool_and(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) = o_orderdate) THEN 'done' ELSE 'value error in Spark' END FROM orders "
    "UNION ALL SELECT 'o_orderdate to int', 'ValueError'"
)
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts of whole columns: a value that would not survive one stops it."""
    attempts = [("orders", "o_totalprice", "decimal(12,2)"), ("lineitem", "l_quantity", "int"), ("lineitem", "l_discount", "int"), ("orders", "o_orderkey", "smallint"),
                ("nation", "n_name", "int"), ("nation", "n_nationkey", "string"), ("orders", "o_orderdate", "date"), ("orders", "o_orderdate", "int")]

    def cast(table: str, column: str, kind: str) -> Callable[[], object]:
        schema = T.StructType().add(column, T._parse_datatype_string(kind))
        return lambda: conform(world.read(spark, sf_dir, table).select(column), schema, table).write.format("noop").mode("overwrite").save()

    return outcomes(spark, {f"{c} to {k}": cast(t, c, k) for t, c, k in attempts})


@query(expected({"same columns": "done", "another order": "done", "missing": "ValueError", "unexpected": "ValueError", "twice": "ValueError"}))
def column_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = world.read(spark, sf_dir, "nation")
    return outcomes(
        spark,
        {
            "same columns": lambda: conform(nation, nation.schema, "nation"),
            "another order": lambda: conform(nation.select("n_regionkey", "n_name", "n_nationkey"), nation.schema, "nation"),
            "missing": lambda: conform(nation.drop("n_name"), nation.schema, "nation"),
            "unexpected": lambda: conform(nation.withColumn("x", F.lit(1)), nation.schema, "nation"),
            "twice": lambda: conform(nation.select("*", "n_name"), nation.schema, "nation"),
        },
    )


@query(expected({"rows a batch: 0": "ValueError", "state of another table": "ValueError", "no capture": "ValueError", "position gone": "CdcRetentionExpiredError", "position at the floor": "done", "position to come": "done"}))
def run_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [50], floor=40)
    src.tables["shop.plain"] = CapturedTable(world.rows(spark, sf_dir), [KEY])
    at = lambda n: state_at_lsn(src, SCHEMA, TABLE, to_lsn(n))
    return outcomes(
        spark,
        {
            "rows a batch: 0": lambda: capture_batch(src, SCHEMA, TABLE, chunk_size=0),
            "state of another table": lambda: capture_batch(src, SCHEMA, "other", at(50)),
            "no capture": lambda: capture_batch(src, SCHEMA, "plain"),
            "position gone": lambda: at(39),
            "position at the floor": lambda: capture_batch(src, SCHEMA, TABLE, at(40)).release(),
            "position to come": lambda: capture_batch(src, SCHEMA, TABLE, at(60)),
        },
    )


@query(expected({"unchanged": "done", "key changed": "SchemaChangedError", "captured column gone": "SchemaChangedError", "captured column retyped": "SchemaChangedError", "table wider": "done", "not due": "done", "never": "done"}))
def schema_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs seen anew in the middle of a run."""
    src = world.source(spark, sf_dir, [50])
    spec = spec_of(src)
    columns = list(spec.captured_columns)
    seen = {
        "unchanged": spec, "key changed": TableSpec(SCHEMA, TABLE, ["c_name"], columns, columns, INSTANCE), "captured column gone": TableSpec(SCHEMA, TABLE, [KEY], columns, columns[:-1], INSTANCE),
        "captured column retyped": TableSpec(SCHEMA, TABLE, [KEY], columns, [columns[0], ColumnSpec("c_name", "int"), *columns[2:]], INSTANCE),
        "table wider": TableSpec(SCHEMA, TABLE, [KEY], [*columns, ColumnSpec("x", "int")], columns, INSTANCE), "not due": TableSpec(SCHEMA, TABLE, [KEY], columns, columns[:-1], INSTANCE),
        "never": TableSpec(SCHEMA, TABLE, [KEY], columns, columns[:-1], INSTANCE),
    }
    due = {"not due": timedelta(days=1), "never": None}

    def go_on(case: str) -> None:
        src.inspect = lambda schema, table: seen[case]
        state = RunState(spec, to_lsn(60), datetime.now(UTC), dump_done=True)
        capture_batch(src, SCHEMA, TABLE, state, inspect_every=due.get(case, timedelta(0)))

    return outcomes(spark, {case: lambda c=case: go_on(c) for case in seen})


@query(expected({"integers": "done", "repeated in the page": "ValueError", "repeated across its end": "ValueError", "strings": "TypeError", "booleans": "TypeError", "no rows": "done"}))
def page_keys_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading keys that a table can and cannot be walked by."""

    def first_page(rows: DataFrame, key: str, size: int) -> Callable[[], object]:
        columns = [ColumnSpec(key, {"string": "nvarchar", "boolean": "bit"}.get(rows.schema[key].dataType.simpleString(), "bigint"))]
        log = rows.limit(0).select(F.lit(b"").alias("__$start_lsn"), F.lit(b"").alias("__$seqval"), F.lit(2).alias("__$operation"), F.lit(b"").alias("__$update_mask"), F.lit(None).cast("timestamp_ntz").alias("commit_timestamp"), key)
        table = CapturedTable(rows.select(key), [key], log, "t", columns, columns, min_lsn=to_lsn(1))
        return lambda: capture_batch(FrameSource(spark, {"s.t": table}, max_lsn=to_lsn(5), clock=lambda: world.DAWN), "s", "t", chunk_size=size)

    orders, lines, nation = (world.read(spark, sf_dir, n) for n in ("orders", "lineitem", "nation"))
    pairs = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    return outcomes(
        spark,
        {
            "integers": first_page(orders, "o_orderkey", 500),
            "repeated in the page": first_page(lines, "l_orderkey", 500),
            "repeated across its end": first_page(pairs, "k", 2),
            "strings": first_page(nation, "n_name", 5),
            "booleans": first_page(nation.select((F.col("n_nationkey") > 3).alias("b")).distinct(), "b", 5),
            "no rows": first_page(orders.limit(0), "o_orderkey", 5),
        },
    )


@query(expected({"passed": "done", "not passed": "TimeoutError", "no sessions to ask": "done"}))
def barrier_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1])
    src.timeout, src.poll = 2.0, 0.2
    kind = "session_id int, start_time timestamp_ntz, end_time timestamp_ntz, empty_scan_count int"
    scan = spark.createDataFrame([(1, world.DAWN, world.DAWN + timedelta(seconds=9), 3)], kind)

    def wait(sessions: DataFrame | None, seconds: int) -> None:
        src.sessions = sessions
        src.await_watermark(world.DAWN + timedelta(seconds=seconds))

    return outcomes(spark, {"passed": lambda: wait(scan, 5), "not passed": lambda: wait(scan, 9), "no sessions to ask": lambda: wait(None, 9)})


@query(expected({"1": "done", "0": "done", "last of all": "ValueError", "nine bytes": "ValueError"}))
def successor_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, {"1": lambda: successor(to_lsn(1)), "0": lambda: successor(bytes(10)), "last of all": lambda: successor(b"\xff" * 10), "nine bytes": lambda: successor(bytes(9))})


@query(expected({"field set": "FrozenInstanceError", "unknown field": "ValueError", "with_ leaves it": "done"}))
def state_is_a_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = RunState(spec_of(world.source(spark, sf_dir, [1])), to_lsn(1), datetime.now(UTC))

    def with_() -> None:
        if state.with_(chunk_key=5).chunk_key != 5 or state.chunk_key is not None:
            raise AssertionError("it changed")

    return outcomes(spark, {"field set": lambda: setattr(state, "dump_done", True), "unknown field": lambda: RunState.from_json(state.to_json()[:-1] + ', "more": 1}'), "with_ leaves it": with_})


# --- joins and order ---


@query("SELECT conv_id, turn, role, text FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations w WHERE w.conv_id = c.conv_id AND w.turn = c.turn AND (w.conv_id + w.turn) % 3 = 0)")
def supersede_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a window's whole key supersedes; its leading part alone does not."""
    rows = world.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    columns = [ColumnSpec("conv_id", "bigint"), ColumnSpec("turn", "bigint")]
    return supersede(rows, rows.where("(conv_id + turn) % 3 = 0"), TableSpec("s", "t", ["conv_id", "turn"], columns, columns))


@query("SELECT k, id FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS k, o_orderkey AS id FROM orders) WHERE k IS NULL OR k NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def supersede_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null key equals none, so its row stays."""
    rows = world.read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("k"), F.col("o_orderkey").alias("id"))
    window = world.read(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("k")).unionAll(spark.createDataFrame([(None,)], "k long"))
    columns = [ColumnSpec("k", "bigint")]
    return supersede(rows, window, TableSpec("s", "t", ["k"], columns, columns))


@query(
    f"WITH {LOG}, win AS (SELECT log.* FROM log, m WHERE n BETWEEN m // 4 AND m // 2), al AS (SELECT {EVENT} FROM win UNION ALL SELECT {ZEROS}, TIMESTAMP '2026-01-01 00:00:00', {BUSINESS} FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM win)) "
    "SELECT row_number() OVER (ORDER BY operation = 0, start_lsn, seqval, operation, c_custkey) - 1 AS place, start_lsn, seqval, operation, c_custkey FROM al"
)
def batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of a merged batch's rows: the window in commit order, then the page in key order."""
    last = world.last_position(spark, sf_dir)
    src = world.source(spark, sf_dir, [last // 4, last // 2])
    frame = capture_batch(src, SCHEMA, TABLE, chunk_size=1 << 40).frame
    return shown(placed(frame).select("place", "start_lsn", "seqval", "operation", KEY))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, c_custkey FROM customer")
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1])
    return placed(src.read_table(spec_of(src))).select("place", KEY)


@query(f"WITH {LOG} SELECT row_number() OVER (ORDER BY start_lsn, seqval) - 1 AS place, start_lsn, seqval FROM log")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1])
    return shown(placed(src.read_event_log(spec_of(src), to_lsn(0), to_lsn(1 << 60))).select("place", "start_lsn", "seqval"))


@query(f"WITH {LOG}, win AS (SELECT log.* FROM log WHERE n <= 400) SELECT {EVENT} FROM win")
def wholly_superseded_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page all of whose rows a window carries leaves the window alone."""
    src = world.source(spark, sf_dir, [1])
    spec = spec_of(src)
    window = src.read_event_log(spec, to_lsn(1), to_lsn(400))
    chunk = src.read_table(spec).join(window.select(KEY).distinct(), KEY, "left_semi").select(*row_schema(spec).names)
    return shown(merge_chunk(src, chunk, window, world.DAWN, spec).orderBy(*merge_order(spec)))


@query(f"WITH {LOG} SELECT operation, count(*) AS n FROM log GROUP BY operation")
def empty_table_drains_the_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump of a table without rows still hands on the window."""
    last = world.last_position(spark, sf_dir)
    src = world.source(spark, sf_dir, [last])
    table = src.tables[f"{SCHEMA}.{TABLE}"]
    table.rows = table.rows.limit(0)
    result = capture_batch(src, SCHEMA, TABLE, state_at_lsn(src, SCHEMA, TABLE, to_lsn(1), dump_done=False))
    return result.frame.groupBy("operation").agg(F.count("*").alias("n"))


# --- where a run stands ---


@query(f"WITH {LOG}, s AS (SELECT (count(*) + 2) // 3 AS size, count(*) AS n FROM customer), b AS (SELECT unnest([1, 2, 3, 4]) AS batch_no) "
       "SELECT CAST(batch_no AS INTEGER) AS batch_no, CAST((SELECT c_custkey FROM customer ORDER BY 1 OFFSET least(size * least(batch_no, 3), s.n) - 1 LIMIT 1) + 1 AS BIGINT) AS chunk_key, "
       "lpad(to_hex(m // 6 * (batch_no + 1) + 1), 20, '0') AS next_position, batch_no = 4 OR size * batch_no > s.n AS dump_done FROM b, s, m".replace(
           "(SELECT c_custkey FROM customer ORDER BY 1 OFFSET least(size * least(batch_no, 3), s.n) - 1 LIMIT 1)",
           "(SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r = least(size * least(batch_no, 3), s.n))"))
def states_of_a_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key and the position that each batch of a dump leaves."""
    results = dump(spark, sf_dir)[1]
    rows = [(i, r.state.chunk_key, r.state.last_lsn.hex().upper(), r.state.dump_done) for i, r in enumerate(results, 1)]
    return spark.createDataFrame(rows, "batch_no int, chunk_key long, next_position string, dump_done boolean").where("batch_no <= 4")


@query(f"WITH {DUMP}, k AS (SELECT CAST(batch_no AS INTEGER) AS batch_no, operation, count(*) AS n FROM dumped GROUP BY ALL) SELECT * FROM k")
def state_through_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump whose state is kept as text between the batches."""
    last = world.last_position(spark, sf_dir)
    size = -(-world.read(spark, sf_dir, "customer").count() // 3)
    src = world.source(spark, sf_dir, [last // 6 * k for k in range(1, 6)] + [last])
    results, text = [], None
    while text is None or not RunState.from_json(text).dump_done:
        results.append(capture_batch(src, SCHEMA, TABLE, RunState.from_json(text) if text else None, chunk_size=size))
        text = results[-1].state.to_json()
    return stacked(results).groupBy("batch_no", "operation").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('log end later', 50), ('floor later', 70), ('the same', 60)) t(attempt, position)")
def opening_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run opens at the log's end, or at its floor where that is later."""
    cases = {"log end later": (50, 40), "floor later": (50, 70), "the same": (60, 60)}
    found = [(name, int.from_bytes(opening_state(world.source(spark, sf_dir, [high], floor=floor), SCHEMA, TABLE).last_lsn, "big")) for name, (high, floor) in cases.items()]
    return spark.createDataFrame(found, "attempt string, position int")


@query(f"WITH {LOG} SELECT CAST(1 AS INTEGER) AS batch_no, {EVENT} FROM log, m WHERE n BETWEEN m // 2 AND m // 4 * 3")
def late_changes_supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes made while a page is read are in the same batch's window, which the log's consumer must have passed."""
    last = world.last_position(spark, sf_dir)
    src = world.source(spark, sf_dir, [last // 2, last // 4 * 3])
    frame = capture_batch(src, SCHEMA, TABLE, chunk_size=1 << 40).frame
    changed = frame.where("operation <> 0")
    if not frame.where("operation = 0").join(changed.select(KEY), KEY, "left_semi").isEmpty():
        raise RuntimeError("a row of the page stayed beside a change of its key")
    return shown(changed, batch_no=1)


@query("SELECT * FROM (VALUES ('naive', '2026-01-01T00:00:00+00:00'), ('two hours east', '2025-12-31T22:00:00+00:00'), ('source clock, first', '2026-01-01T00:00:00'), ('source clock, second', '2026-01-01T00:00:01')) t(clock, shown)")
def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspection times are kept in UTC; the source's clock is taken as it is."""
    from datetime import timezone

    src = world.source(spark, sf_dir, [1])
    spec = spec_of(src)
    at = lambda t: RunState(spec, to_lsn(1), t).last_inspect.isoformat()
    rows = [("naive", at(world.DAWN)), ("two hours east", at(world.DAWN.replace(tzinfo=timezone(timedelta(hours=2))))), *[(f"source clock, {n}", src.watermark().isoformat()) for n in ("first", "second")]]
    return spark.createDataFrame(rows, "clock string, shown string")


@query("SELECT * FROM (VALUES ('INFO', true), ('WARNING', true), ('DEBUG', false)) t(level, logged)")
def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that a dump batch logs at, with logging as it is configured without more."""
    text = io.StringIO()
    logger = configure_logging(stream=text)
    try:
        src = world.source(spark, sf_dir, [50])
        capture_batch(src, SCHEMA, TABLE, chunk_size=10).release()
    finally:
        for handler in [h for h in logger.handlers if getattr(h, "stream", None) is text]:
            logger.removeHandler(handler)
        logger.setLevel(logging.NOTSET)
    return spark.createDataFrame([(n, f" {n} " in text.getvalue()) for n in ("INFO", "WARNING", "DEBUG")], "level string, logged boolean")


@query("SELECT true AS same, 0 AS left_over")
def release_of_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's pinned frames can be read until they are released, and then are gone."""
    src = world.source(spark, sf_dir, [50])
    result = capture_batch(src, SCHEMA, TABLE, chunk_size=10)
    same = result.frame.count() == result.frame.count() > 0
    result.release()
    path = spark._jvm.org.apache.hadoop.fs.Path
    left = sum(path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p)) for p in result.pins)
    return spark.createDataFrame([(same, left)], "same boolean, left_over int")


@query(f"WITH {LOG} SELECT operation, count(*) AS n FROM log, m WHERE n >= m // 2 GROUP BY operation")
def batches_until_nothing_is_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = world.last_position(spark, sf_dir)
    src = world.source(spark, sf_dir, [last * 2 // 3, last * 5 // 6, last])
    frames = [r.frame for r in batches(src, SCHEMA, TABLE, state_at_lsn(src, SCHEMA, TABLE, to_lsn(last // 2)))]
    return reduce(DataFrame.unionAll, frames).groupBy("operation").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (0, 'start_lsn', 'binary'), (1, 'seqval', 'binary'), (2, 'operation', 'int'), (3, 'update_mask', 'binary'), (4, 'commit_timestamp', 'timestamp_ntz'), (5, 'c_custkey', 'bigint'), "
       "(6, 'c_name', 'string'), (7, 'c_nationkey', 'int'), (8, 'c_acctbal', 'decimal(12,2)'), (9, 'c_mktsegment', 'string')) t(place, name, kind)")  # fmt: skip
def event_schema_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = event_schema(spec_of(world.source(spark, sf_dir, [1])))
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)], "place int, name string, kind string")



__all__ = ["ORACLE_SQL", "QUERIES"]
