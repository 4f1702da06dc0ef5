import pytest
from pyspark.sql import functions as F

from tidemark.plans.cases import QUERIES, placed

SF = "/root/testdata/sf0.01"


def test_places_of_a_frame_that_sorts_into_several_partitions(spark):
    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("key"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
    several = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "5"}
    for name, value in several.items():
        spark.conf.set(name, value)
    try:
        found = placed(rows.repartition(3).orderBy("key"))
        assert found.columns == ["key", "wide", "place"]
        assert found.where("key <> place").count() == 0 and found.select("place").distinct().count() == 60_000
        assert placed(rows.limit(0).orderBy("key")).count() == 0
    finally:
        for name in several:
            spark.conf.unset(name)


@pytest.fixture
def several(spark):
    """Sorted frames have several partitions, whose bounds are drawn from few rows."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "5"}
    for name, value in own.items():
        spark.conf.set(name, value)
    yield
    for name in own:
        spark.conf.unset(name)


def test_lsn_order_of_several_partitions(spark, several):
    found = QUERIES["lsn_order"](spark, SF)
    assert found.where("number <> place").count() == 0 and found.count() == 10_000


def test_event_order_of_several_partitions(spark, several):
    rows = sorted(tuple(r) for r in QUERIES["event_order"](spark, SF).collect())
    assert [r[0] for r in rows] == list(range(10_000)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def test_page_order_of_several_partitions(spark, several):
    found = QUERIES["page_order"](spark, SF)
    assert found.where("place <> c_custkey").count() == 0 and found.count() == 1_500
