"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.lsn import lsn_column, mask_width, successor, to_lsn
from tidemark.functions.pinned import shared_dir
from tidemark.operators.merge import superseded_keys, supersede
from tidemark.operators.run import CdcRetentionExpiredError, batches, capture_batch, state_at_lsn
from tidemark.operators.views import latest_image, recompute
from tidemark.plans import world
from tidemark.plans.schema import conform, event_schema, logical_type, row_schema
from tidemark.plans.spec import ColumnChanges, ColumnSpec, TableSpec
from tidemark.plans.state import BatchResult
from tidemark.plans.world import KEY, SCHEMA, TABLE, shown
from tidemark.sources.frames import FrameSource, columns_of, page, page_end

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The log, and rows of the table as they are dumped at a time {at}, in SQL.
LOG = """log AS (
  SELECT event_id // 4 + 1 AS n, lpad(to_hex(event_id // 4 + 1), 20, '0') AS start_lsn, lpad(to_hex(event_id + 1), 20, '0') AS seqval,
    CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 1 ELSE 4 END AS operation, CASE WHEN event_type IN ('signup', 'error') THEN '1F' ELSE '08' END AS update_mask,
    max(ts) OVER (PARTITION BY event_id // 4 + 1) AS commit_timestamp, c_custkey, c_name, c_nationkey, CAST(CAST(value AS DECIMAL(12, 2)) AS DOUBLE) AS c_acctbal, c_mktsegment
  FROM events JOIN customer ON user_id * 10 = c_custkey),
m AS (SELECT max(event_id) // 4 + 1 AS m FROM events)"""
EVENT = "start_lsn, seqval, operation, update_mask, commit_timestamp, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
BUSINESS = "c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE) AS c_acctbal, c_mktsegment"
ZEROS = "'00000000000000000000' AS start_lsn, '00000000000000000000' AS seqval, 0 AS operation, '00' AS update_mask"


def query(sql: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def stacked(results: list[BatchResult]) -> DataFrame:
    """Frames of a run, each with its number, in one schema."""
    frames = [shown(r.frame, batch_no=i) for i, r in enumerate(results, 1) if r.frame is not None]
    return reduce(DataFrame.unionAll, frames)


def spec_of(src: FrameSource) -> TableSpec:
    return src.inspect(SCHEMA, TABLE)


# --- table scans ---


@query(f"SELECT {BUSINESS} FROM customer WHERE c_custkey >= 100 ORDER BY c_custkey LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1])
    return shown(src.read_table(spec_of(src), start_pk=100, limit=50))


@query(f"SELECT {BUSINESS} FROM customer WHERE c_custkey >= 20 AND c_custkey < 77")
def key_range_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1])
    return shown(src.read_table(spec_of(src), start_pk=20, end_pk=77))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id >= 3 ORDER BY conv_id, turn LIMIT 25")
def composite_key_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = world.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    columns = columns_of(rows.schema)
    return page(rows, TableSpec("shop", "turns", ["conv_id", "turn"], columns, columns), 3, None, 25)


@query("SELECT (SELECT l_orderkey FROM lineitem ORDER BY 1 OFFSET 999 LIMIT 1) AS key, (SELECT o_orderkey FROM orders ORDER BY 1 OFFSET 1233 LIMIT 1) AS order_key")
def page_end_by_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a large page ends, found without sorting it."""
    found = page_end(world.read(spark, sf_dir, "lineitem"), "l_orderkey", 1000)[0], page_end(world.read(spark, sf_dir, "orders"), "o_orderkey", 1234)[0]
    return spark.createDataFrame([found], "key long, order_key long")


@query("SELECT min(c_custkey) AS low, max(c_custkey) AS high FROM customer")
def pk_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1])
    return spark.createDataFrame([src.read_pk_range(spec_of(src))], "low long, high long")


@query(
    "WITH r AS (SELECT min(doc_id) AS low, max(doc_id) AS high FROM labels) "
    "SELECT CAST((doc_id - low) // 64 AS BIGINT) AS slice, count(*) AS n FROM labels, r GROUP BY 1"
)
def pk_range_chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of equal key width cover every key once; they differ in rows where keys have gaps."""
    rows = world.read(spark, sf_dir, "labels")
    low, _ = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    return rows.groupBy(F.floor((F.col("doc_id") - low) / 64).cast("long").alias("slice")).agg(F.count("*").alias("n"))


@query(f"SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def computed_null_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1], computed={"c_name": "concat('Customer#', c_custkey)"})
    return shown(src.read_table(spec_of(src)))


# --- log scans ---


@query(f"WITH {LOG} SELECT {EVENT} FROM log WHERE n BETWEEN 10 AND 60")
def event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1])
    return shown(src.read_event_log(spec_of(src), to_lsn(10), to_lsn(60)))


@query(f"WITH {LOG} SELECT {EVENT} FROM log WHERE n = 77")
def event_window_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1])
    return shown(src.read_event_log(spec_of(src), to_lsn(77), to_lsn(77)))


@query(f"WITH {LOG} SELECT lpad(to_hex(min(n)), 20, '0') AS low, lpad(to_hex(max(n)), 20, '0') AS high, lpad(to_hex(max(n) + 1), 20, '0') AS next_open FROM log")
def window_high_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1])
    src.max_lsn, src.tables[f"{SCHEMA}.{TABLE}"].min_lsn = None, None  # as the log itself has them
    low, high = src.get_min_lsn(world.INSTANCE), src.get_max_lsn()
    return spark.createDataFrame([tuple(x.hex().upper() for x in (low, high, successor(high)))], "low string, high string, next_open string")


@query("SELECT event_id AS number, lpad(to_hex(event_id), 20, '0') AS lsn, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events")
def lsn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by byte order have the places that their numbers have, across 00FF and 0100."""
    from tidemark.plans.cases import placed

    every = world.read(spark, sf_dir, "events").select(F.col("event_id").alias("number"), lsn_column(F.col("event_id")).alias("lsn"))
    return shown(placed(every.orderBy("lsn")))


@query("SELECT lpad(to_hex(event_id // 4 + 1), 20, '0') AS start_lsn, max(ts) AS commit_timestamp FROM events GROUP BY 1")
def commit_time_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(world.lsn_times(spark, sf_dir))


@query(f"WITH {LOG} SELECT operation, count(*) AS n FROM log GROUP BY operation")
def op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before images never come out."""
    src = world.source(spark, sf_dir, [1])
    table = src.tables[f"{SCHEMA}.{TABLE}"]
    table.log = table.log.unionAll(table.log.where("`__$operation` = 4").withColumn("__$operation", F.lit(3)))
    return src.read_event_log(spec_of(src), to_lsn(0), to_lsn(1 << 60)).groupBy("operation").agg(F.count("*").alias("n"))


# --- stamping, conforming, merging ---


@query(f"SELECT {ZEROS}, TIMESTAMP '2026-01-01 00:00:00' AS commit_timestamp, {BUSINESS} FROM customer")
def stamp_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1])
    spec = spec_of(src)
    return shown(src.to_events(src.read_table(spec), spec, world.DAWN))


@query(
    "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE) AS c_acctbal, CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_mktsegment "
    "FROM customer"
)
def conform_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns put in order and cast without loss."""
    kinds = [ColumnSpec("c_nationkey", "bigint"), ColumnSpec("c_acctbal", "decimal", 12, 2), ColumnSpec("c_custkey", "int"), ColumnSpec("c_name", "nvarchar"), ColumnSpec("c_mktsegment", "nvarchar")]
    spec = TableSpec(SCHEMA, TABLE, [KEY], kinds, kinds)
    return shown(conform(world.read(spark, sf_dir, "customer"), row_schema(spec), "customer"))


def page_and_window(spark: SparkSession, sf_dir: str) -> tuple[TableSpec, DataFrame, DataFrame]:
    src = world.source(spark, sf_dir, [1])
    spec = spec_of(src)
    return spec, src.read_table(spec, limit=200), src.read_event_log(spec, to_lsn(20), to_lsn(90))


SUPERSEDED = "page AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 200), keys AS (SELECT DISTINCT c_custkey AS k FROM log WHERE n BETWEEN 20 AND 90)"


@query(f"WITH {LOG}, {SUPERSEDED} SELECT c_custkey FROM page WHERE c_custkey IN (SELECT k FROM keys)")
def superseded_key_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, chunk, window = page_and_window(spark, sf_dir)
    return superseded_keys(chunk, window, spec)


@query(f"WITH {LOG}, {SUPERSEDED} SELECT {BUSINESS} FROM page WHERE c_custkey NOT IN (SELECT k FROM keys)")
def supersede_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, chunk, window = page_and_window(spark, sf_dir)
    return shown(supersede(chunk, window, spec))


@query(
    f"WITH {LOG}, page AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 100), win AS (SELECT log.* FROM log, m WHERE n BETWEEN m // 4 AND m // 2) "
    f"SELECT {EVENT} FROM win UNION ALL SELECT {ZEROS}, TIMESTAMP '2026-01-01 00:00:00', {BUSINESS} FROM page WHERE c_custkey NOT IN (SELECT c_custkey FROM win)"
)
def merge_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = world.last_position(spark, sf_dir)
    src = world.source(spark, sf_dir, [last // 4, last // 2])
    return shown(capture_batch(src, SCHEMA, TABLE, chunk_size=100).frame)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that paging would refuse."""
    return world.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 1")


# --- runs ---


def dump(spark: SparkSession, sf_dir: str) -> tuple[FrameSource, list[BatchResult], int]:
    """A dump in three full pages and an empty one, a sixth of the log at a time."""
    last = world.last_position(spark, sf_dir)
    size = -(-world.read(spark, sf_dir, "customer").count() // 3)
    src = world.source(spark, sf_dir, [last // 6 * k for k in range(1, 6)] + [last])
    results, state = [], None
    while state is None or not state.dump_done:
        results.append(capture_batch(src, SCHEMA, TABLE, state, chunk_size=size))
        state = results[-1].state
    return src, results, last


DUMP = f"""{LOG},
win AS (
  SELECT CASE WHEN n <= m // 6 * 2 THEN 1 WHEN n <= m // 6 * 3 THEN 2 WHEN n <= m // 6 * 4 THEN 3 ELSE 4 END AS batch_no, log.* FROM log, m WHERE n BETWEEN m // 6 AND m // 6 * 5),
pages AS (SELECT CAST((row_number() OVER (ORDER BY c_custkey) - 1) // (SELECT (count(*) + 2) // 3 FROM customer) + 1 AS INTEGER) AS batch_no, * FROM customer),
dumped AS (
  SELECT batch_no, {EVENT} FROM win UNION ALL
  SELECT batch_no, {ZEROS}, TIMESTAMP '2026-01-01 00:00:00' + to_seconds(2 * (batch_no - 1)), {BUSINESS} FROM pages
  WHERE NOT EXISTS (SELECT 1 FROM win WHERE win.batch_no = pages.batch_no AND win.c_custkey = pages.c_custkey))"""


@query(f"WITH {DUMP} SELECT * FROM dumped")
def dump_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stacked(dump(spark, sf_dir)[1])


@query(f"WITH {LOG} SELECT CASE WHEN n <= m * 3 // 4 THEN 1 ELSE 2 END AS batch_no, {EVENT} FROM log, m WHERE n >= m // 2")
def tail_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = world.last_position(spark, sf_dir)
    src = world.source(spark, sf_dir, [last * 3 // 4, last])
    return stacked(list(batches(src, SCHEMA, TABLE, state_at_lsn(src, SCHEMA, TABLE, to_lsn(last // 2)))))


@query(f"WITH {LOG} SELECT b AS batch_no, {EVENT} FROM log, m, (VALUES (1), (2)) t(b) WHERE n BETWEEN m // 3 AND m // 3 * 2")
def replay_from_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state read twice gives the same batch twice."""
    last = world.last_position(spark, sf_dir)
    src = world.source(spark, sf_dir, [last // 3 * 2])
    state = state_at_lsn(src, SCHEMA, TABLE, to_lsn(last // 3))
    return stacked([capture_batch(src, SCHEMA, TABLE, state) for _ in range(2)])


@query(f"WITH {DUMP}, tail AS (SELECT operation FROM log, m WHERE n > m // 6 * 5) SELECT operation, count(*) AS n FROM (SELECT operation FROM dumped UNION ALL SELECT operation FROM tail) GROUP BY operation")
def handoff_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump's last state opens the tail, and all frames stack."""
    src, results, _ = dump(spark, sf_dir)
    tail = list(batches(src, SCHEMA, TABLE, results[-1].state))
    return stacked(results + tail).groupBy("operation").agg(F.count("*").alias("n"))


@query(f"WITH {DUMP} SELECT operation = 0 AS dumped, start_lsn = '00000000000000000000' AS zero, count(*) AS n FROM dumped GROUP BY ALL")
def dump_row_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stacked(dump(spark, sf_dir)[1])
    return rows.groupBy((F.col("operation") == 0).alias("dumped"), (F.col("start_lsn") == "0" * 20).alias("zero")).agg(F.count("*").alias("n"))


@query(
    f"WITH {DUMP} SELECT {EVENT} FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY start_lsn DESC, seqval DESC, operation DESC) AS r FROM dumped) WHERE r = 1 AND operation <> 1"
)
def latest_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [r.frame for r in dump(spark, sf_dir)[1] if r.frame is not None]
    return shown(latest_image(reduce(DataFrame.unionAll, frames), [KEY]))


@query("SELECT c_custkey, 'Customer ' || CAST(c_custkey AS VARCHAR) AS c_name FROM customer")
def recomputed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [1], computed={"c_name": "a formula of the source"})
    return recompute(src.read_table(spec_of(src)), {"c_name": "concat('Customer ', c_custkey)"}).select("c_custkey", "c_name")


@query("SELECT p AS position, p < 40 AS expired FROM (VALUES (1), (39), (40), (41)) t(p)")
def retention_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = world.source(spark, sf_dir, [50], floor=40)

    def expired(position: int) -> bool:
        try:
            state_at_lsn(src, SCHEMA, TABLE, to_lsn(position))
        except CdcRetentionExpiredError:
            return True
        return False

    return spark.createDataFrame([(p, expired(p)) for p in (1, 39, 40, 41)], "position int, expired boolean")


@query("SELECT c AS scan, p AS passed FROM (VALUES (1, false), (2, true), (3, false), (4, true), (5, false)) t(c, p)")
def barrier_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan passes a mark if it began after it, or found nothing and ended after it; session 0 never counts."""
    t = lambda s: datetime(2026, 1, 1, 0, 0, s)
    scans = {1: (1, t(1), t(9), 0), 2: (1, t(6), t(9), 0), 3: (1, t(1), t(4), 3), 4: (1, t(1), t(9), 3), 5: (0, t(6), t(9), 3)}
    src = world.source(spark, sf_dir, [1])
    out = []
    for scan, row in scans.items():
        src.sessions = spark.createDataFrame([row], "session_id int, start_time timestamp_ntz, end_time timestamp_ntz, empty_scan_count int")
        out.append((scan, src.capture_passed(t(5))))
    return spark.createDataFrame(out, "scan int, passed boolean")


@query(
    "SELECT c AS change, d AS drift FROM (VALUES (1, 'added: x'), (2, 'removed: c_name'), (3, 'added: x; removed: c_name'), (4, 'retyped: c_name'), (5, 'in another order'), (6, 'unchanged')) t(c, d)"
)
def schema_drift_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = list(spec_of(world.source(spark, sf_dir, [1])).captured_columns)
    less, more = [c for c in own if c.name != "c_name"], [*own, ColumnSpec("x", "int")]
    retyped = [ColumnSpec("c_name", "int") if c.name == "c_name" else c for c in own]
    changes = [more, less, [*less, more[-1]], retyped, own[::-1], own]
    return spark.createDataFrame([(i, str(ColumnChanges.between(own, after))) for i, after in enumerate(changes, 1)], "change int, drift string")


TYPES = [
    ("bigint", 0, 0, "int64", "bigint"), ("int", 0, 0, "int32", "int"), ("smallint", 0, 0, "int16", "smallint"), ("tinyint", 0, 0, "uint8", "smallint"), ("BIT", 0, 0, "bool", "boolean"),
    ("float", 0, 0, "float64", "double"), ("real", 0, 0, "float32", "float"), ("date", 0, 0, "date32", "date"), ("nvarchar", 0, 0, "string", "string"), ("uniqueidentifier", 0, 0, "string", "string"),
    ("image", 0, 0, "binary", "binary"), ("timestamp", 0, 0, "binary", "binary"), ("rowversion", 0, 0, "binary", "binary"), ("decimal", 10, 2, "decimal(10,2)", "decimal(10,2)"),
    ("money", 19, 4, "decimal(19,4)", "decimal(19,4)"), ("datetime2", 0, 6, "ts_us", "timestamp_ntz"), ("datetime2", 0, 7, "ts_ns", "timestamp_ntz"), ("datetime", 0, 3, "ts_us", "timestamp_ntz"),
    ("datetimeoffset", 0, 7, "tstz_ns", "timestamp"), ("time", 0, 6, "time_us", "bigint"), ("time", 0, 7, "time_ns", "bigint"),
]


@query(f"SELECT * FROM (VALUES {', '.join(map(str, TYPES))}) t(type_name, prec, scale, logical, spark)")
def type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = [ColumnSpec("c", n, p, s) for n, p, s, _, _ in TYPES]
    rows = [(c.type_name, c.precision, c.scale, logical_type(c), row_schema(TableSpec("s", "t", [], [c], [c]))[0].dataType.simpleString()) for c in specs]
    return spark.createDataFrame(rows, "type_name string, prec int, scale int, logical string, spark string")


@query("SELECT n AS columns, CAST((n + 7) // 8 AS INTEGER) AS width, repeat('00', CAST((n + 7) // 8 AS INTEGER)) AS mask FROM (VALUES (1), (8), (9), (11), (16), (17)) t(n)")
def mask_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, mask_width(n), bytes(mask_width(n)).hex()) for n in (1, 8, 9, 11, 16, 17)], "columns int, width int, mask string")


@query(f"WITH {DUMP} SELECT * FROM dumped UNION ALL SELECT 5, {EVENT} FROM log, m WHERE n > m // 6 * 5")
def stream_dump_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dump and the tail after it, as micro-batches of a streaming query that stops and starts again on the way."""
    import uuid

    from tidemark.streaming.capture import StateLog, capture_stream, parquet_sink

    last = world.last_position(spark, sf_dir)
    size = -(-world.read(spark, sf_dir, "customer").count() // 3)
    src = world.source(spark, sf_dir, [last // 6 * k for k in range(1, 6)] + [last])
    folder = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"
    states = StateLog(spark, f"{folder}/states")
    schema = event_schema(spec_of(src))
    for turn in range(5):
        # One new trigger file a turn; every turn is a query of its own that goes on from the checkpoint.
        spark.range(1).write.mode("append").parquet(f"{folder}/triggers")
        trigger = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/triggers")
        writer = capture_stream(trigger, src, SCHEMA, TABLE, parquet_sink(f"{folder}/out"), states, chunk_size=size)
        running = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
        if states.read(turn) is None:
            raise RuntimeError(f"turn {turn} left no state")
    frames = spark.read.schema(schema.add("batch", T.IntegerType())).parquet(f"{folder}/out")
    return shown(frames.select((F.col("batch") + 1).alias("batch_no"), *[f for f in frames.columns if f != "batch"]))


__all__ = ["ORACLE_SQL", "QUERIES"]
