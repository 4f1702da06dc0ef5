import json
from dataclasses import FrozenInstanceError
from datetime import UTC, datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import types as T

from tidemark.functions.lsn import mask_width, successor, to_lsn
from tidemark.plans.catalog import TYPES
from tidemark.plans.schema import conform, event_schema, logical_type, row_schema, spark_type, validate
from tidemark.plans.spec import ColumnSpec, TableSpec
from tidemark.plans.state import BatchResult, RunState

ID, AMOUNT = ColumnSpec("sale_id", "int", 10, 0), ColumnSpec("amount", "decimal", 10, 2)


def spec(columns=(ID, AMOUNT), captured=None, pk=("sale_id",), instance="dbo_sales"):
    return TableSpec("dbo", "sales", pk, columns, columns if captured is None else captured, instance)


# --- columns and tables ---


def test_columns_are_equal_by_name_and_signature():
    assert ColumnSpec("a", "INT") == ColumnSpec("a", "int") and hash(ColumnSpec("a", "INT")) == hash(ColumnSpec("a", "int"))
    assert ColumnSpec("a", "int", computed_definition="1") == ColumnSpec("a", "int")
    assert ColumnSpec("a", "decimal", 10, 2) != ColumnSpec("a", "decimal", 10, 3) and ColumnSpec("a", "int") != ColumnSpec("b", "int")
    assert ColumnSpec("a", "int") != "a"


def test_table_spec():
    found = spec(captured=(AMOUNT, ID))
    assert found.qualified_name == "dbo.sales" and found.business_columns == ("amount", "sale_id")
    assert found == spec(captured=[AMOUNT, ID]) and hash(found) == hash(spec(captured=[AMOUNT, ID]))
    with pytest.raises(FrozenInstanceError):
        found.source_table = "x"


# --- positions ---


@pytest.mark.parametrize("n", [0, 1, 255, 256, 2**40, 2**79])
def test_successor(n):
    assert successor(to_lsn(n)) == to_lsn(n + 1)


@pytest.mark.parametrize("width", [0, 1, 9, 11, 20])
def test_successor_refuses_other_widths(width):
    with pytest.raises(ValueError, match="10 bytes"):
        successor(bytes(width))


def test_last_position_has_no_successor():
    with pytest.raises(ValueError, match="no successor"):
        successor(b"\xff" * 10)


@pytest.mark.parametrize(("columns", "width"), [(1, 1), (3, 1), (8, 1), (9, 2), (10, 2), (16, 2), (17, 3)])
def test_mask_width(columns, width):
    assert mask_width(columns) == width


# --- states ---


def state(**more):
    return RunState(**{"spec": spec(), "last_lsn": bytes.fromhex("0000004400007920000b"), "last_inspect": datetime(2026, 8, 13, 12, 30, tzinfo=UTC)} | more)


@pytest.mark.parametrize("more", [{}, {"chunk_key": 7}, {"dump_done": True}, {"spec": spec((ID, ColumnSpec("amount", "decimal", 10, 2, "a*b")))}])
def test_state_goes_through_json(more):
    own = state(**more)
    back = RunState.from_json(own.to_json())
    assert back == own and back.spec.columns[1].computed_definition == own.spec.columns[1].computed_definition
    assert json.loads(own.to_json())["last_lsn"] == "0000004400007920000b"


def test_state_refuses_unknown_fields():
    with pytest.raises(ValueError, match="not a run state"):
        RunState.from_json(json.dumps(json.loads(state().to_json()) | {"more": 1}))


def test_state_is_a_value():
    own = state()
    with pytest.raises(FrozenInstanceError):
        own.dump_done = True
    assert own.with_(chunk_key=3).chunk_key == 3 and own.chunk_key is None


def test_inspection_time_is_utc():
    assert state(last_inspect=datetime(2026, 1, 1)).last_inspect == datetime(2026, 1, 1, tzinfo=UTC)
    there = datetime(2026, 1, 1, 2, tzinfo=timezone(timedelta(hours=2)))
    assert state(last_inspect=there).last_inspect == datetime(2026, 1, 1, tzinfo=UTC)


def test_batch_results_are_compared_by_identity():
    assert BatchResult(None, state()) != BatchResult(None, state())


# --- types and schemas ---


@pytest.mark.parametrize(("name", "precision", "scale", "logical", "spark_name"), TYPES)
def test_type_map(name, precision, scale, logical, spark_name):
    column = ColumnSpec("c", name, precision, scale)
    assert logical_type(column) == logical and spark_type(column).simpleString() == spark_name
    assert logical_type(ColumnSpec("c", name.upper(), precision, scale)) == logical


@pytest.mark.parametrize("name", ["sql_variant", "geography", "geometry", "hierarchyid", "sysname_udt"])
def test_types_without_a_place(name):
    with pytest.raises(ValueError, match=name):
        logical_type(ColumnSpec("c", name))


def test_schemas():
    assert row_schema(spec()).simpleString() == "struct<sale_id:int,amount:decimal(10,2)>"
    names = event_schema(spec()).names
    assert names == ["start_lsn", "seqval", "operation", "update_mask", "commit_timestamp", "sale_id", "amount"]
    assert all(f.nullable for f in event_schema(spec()).fields)


@pytest.mark.parametrize(
    ("bad", "message"),
    [
        (spec((ID, AMOUNT), (ID, AMOUNT, ColumnSpec("legacy_note", "nvarchar"))), "no longer in the table"),
        (spec((ID, ColumnSpec("amount", "decimal", 12, 2))), None),
        (spec((ID, ColumnSpec("amount", "decimal", 12, 2)), (ID, AMOUNT)), "captured as"),
        (spec((ID, ColumnSpec("amount", "datetime2", 0, 7)), (ID, ColumnSpec("amount", "datetime2", 0, 6))), "captured as"),
        (spec((ID, ColumnSpec("amount", "tinyint")), (ID, ColumnSpec("amount", "smallint"))), "captured as"),
        (spec((ID, ColumnSpec("amount", "timestamp")), (ID, ColumnSpec("amount", "binary"))), None),
        (spec((ID, AMOUNT), (AMOUNT,)), "not captured"),
        (spec((ColumnSpec("sale_id", "int", 10, 0, "1"), AMOUNT)), "computed"),
        (spec((ID, ColumnSpec("seqval", "int"))), "metadata"),
        (spec((ID, ColumnSpec("amount", "geography"))), "geography"),
    ],
)
def test_validate(bad, message):
    if message is None:
        validate(bad)
    else:
        with pytest.raises(ValueError, match=message):
            validate(bad)


# --- conforming ---

PAIR = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DecimalType(10, 2))])


def test_conform_orders_and_casts(spark):
    found = conform(spark.createDataFrame([(1.5, 7)], "b double, a bigint"), PAIR, "x")
    assert found.schema == PAIR and found.collect() == [(7, Decimal("1.50"))]


@pytest.mark.parametrize(("ddl", "message"), [("a int", "missing columns \\['b'\\]"), ("a int, b int, c int", "unexpected columns \\['c'\\]"), ("a int, b array<int>", "cannot go from"), ("a timestamp, b int", "cannot go from")])
def test_conform_refuses_other_columns(spark, ddl, message):
    with pytest.raises(ValueError, match=message):
        conform(spark.createDataFrame([], ddl), PAIR, "x")


def test_conform_refuses_duplicates(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError, match="duplicate columns a"):
        conform(df.select("a", "a", "b"), PAIR, "x")


@pytest.mark.parametrize(("sql", "to"), [("1.2345d", "decimal(10,2)"), ("1.5d", "int"), ("3000000000L", "int"), ("cast('1.239' as decimal(10,3))", "decimal(10,2)"), ("X'ff'", "string"), ("'abc'", "int")])
def test_conform_refuses_loss(spark, sql, to):
    target = T.StructType([T.StructField("v", T._parse_datatype_string(to))])
    with pytest.raises(PySparkException, match="does not fit"):
        conform(spark.sql(f"SELECT {sql} AS v"), target, "x").collect()


def test_conform_keeps_nulls(spark):
    assert conform(spark.sql("SELECT NULL AS a, cast(NULL AS double) AS b"), PAIR, "x").collect() == [(None, None)]
