"""A change source made of the test tables: customer as the table, events as its log, by fixed rules.

Event e changes customer ``user_id * 10``, in transaction ``e div 4 + 1`` (its
log position) at place ``e + 1``; signup inserts, error deletes, anything else
updates, and the new balance is the event's value.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.lsn import lsn_column, to_lsn
from tidemark.sources.frames import CapturedTable, FrameSource

SCHEMA, TABLE, INSTANCE, KEY = "shop", "customer", "shop_customer", "c_custkey"
DAWN = datetime(2026, 1, 1)
COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("decimal(12,2)").alias("c_acctbal"), "c_mktsegment")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, customer = read(spark, sf_dir, "events"), rows(spark, sf_dir).drop("c_acctbal")
    operation = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "error", 1).otherwise(4)
    joined = events.join(customer, F.col("user_id") * 10 == F.col("c_custkey"))
    return joined.select(
        lsn_column(F.expr("event_id div 4 + 1")).alias("__$start_lsn"), lsn_column(F.col("event_id") + 1).alias("__$seqval"), operation.alias("__$operation"),
        F.unhex(F.when(operation == 4, "08").otherwise("1F")).alias("__$update_mask"), "c_custkey", "c_name", "c_nationkey", F.col("value").cast("decimal(12,2)").alias("c_acctbal"), "c_mktsegment",
    )


def lsn_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.groupBy(lsn_column(F.expr("event_id div 4 + 1")).alias("start_lsn")).agg(F.max("ts").alias("commit_timestamp"))


def last_position(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] // 4 + 1


def ticking() -> Iterator[datetime]:
    return (DAWN + timedelta(seconds=n) for n in count())


def source(spark: SparkSession, sf_dir: str, positions: list[int], floor: int = 1, computed: dict[str, str] | None = None) -> FrameSource:
    """The source; get_max_lsn() gives the positions one after another, then the last one for ever. The clock moves a second a question."""
    script, clock = iter(positions), ticking()
    table = CapturedTable(rows(spark, sf_dir), [KEY], log(spark, sf_dir), INSTANCE, computed=computed or {}, min_lsn=to_lsn(floor))
    return FrameSource(spark, {f"{SCHEMA}.{TABLE}": table}, lsn_times(spark, sf_dir), max_lsn=lambda: to_lsn(next(script, positions[-1])), clock=lambda: next(clock), watermark_poll=0.01)


def shown(df: DataFrame, **more: object) -> DataFrame:
    """Binary as hex and decimals as doubles, so that a result compares anywhere; more: constant columns."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = [F.hex(n).alias(n) if isinstance(k, T.BinaryType) else F.col(n).cast("double").alias(n) if isinstance(k, T.DecimalType) else F.col(n) for n, k in kinds.items()]
    return df.select(*[F.lit(v).alias(k) for k, v in more.items()], *out)
