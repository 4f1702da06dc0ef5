"""One schema for all frames of a run: types from the catalog, validation, and strict conforming."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.spec import ColumnSpec, TableSpec

METADATA = T.StructType(
    [
        T.StructField("start_lsn", T.BinaryType()),
        T.StructField("seqval", T.BinaryType()),
        T.StructField("operation", T.IntegerType()),
        T.StructField("update_mask", T.BinaryType()),
        T.StructField("commit_timestamp", T.TimestampNTZType()),
    ]
)

# Logical type by source type. The logical type, not Spark's, decides on drift: Spark has
# one timestamp precision and no unsigned byte, but a change between the source's types is drift still.
PLAIN = {
    "bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "uint8", "bit": "bool", "float": "float64", "real": "float32", "date": "date32",
    "char": "string", "varchar": "string", "nchar": "string", "nvarchar": "string", "text": "string", "ntext": "string", "xml": "string", "sysname": "string",
    "uniqueidentifier": "string", "binary": "binary", "varbinary": "binary", "image": "binary", "timestamp": "binary", "rowversion": "binary",
}
EXACT = {"decimal", "numeric", "money", "smallmoney"}
CLOCK = {"datetime": "ts", "smalldatetime": "ts", "datetime2": "ts", "datetimeoffset": "tstz", "time": "time"}
NANOS_FROM_SCALE = 7

SPARK = {
    "int64": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "uint8": T.ShortType(), "bool": T.BooleanType(), "float64": T.DoubleType(),
    "float32": T.FloatType(), "date32": T.DateType(), "string": T.StringType(), "binary": T.BinaryType(), "ts_us": T.TimestampNTZType(), "ts_ns": T.TimestampNTZType(),
    "tstz_us": T.TimestampType(), "tstz_ns": T.TimestampType(), "time_us": T.LongType(), "time_ns": T.LongType(),
}


def logical_type(column: ColumnSpec) -> str:
    """The type that a column has in every frame of a run."""
    name = column.type_name.lower()
    if name in PLAIN:
        return PLAIN[name]
    if name in EXACT:
        return f"decimal({column.precision},{column.scale})"
    if name in CLOCK:
        return f"{CLOCK[name]}_{'ns' if column.scale >= NANOS_FROM_SCALE else 'us'}"
    raise ValueError(f"column {column.name!r} has type {column.type_name!r}, which no frame can hold")


def spark_type(column: ColumnSpec) -> T.DataType:
    """Times of day are nanoseconds since midnight; timestamps have microseconds."""
    found = logical_type(column)
    if m := re.fullmatch(r"decimal\((\d+),(\d+)\)", found):
        return T.DecimalType(int(m[1]), int(m[2]))
    return SPARK[found]


def row_schema(spec: TableSpec) -> T.StructType:
    return T.StructType([T.StructField(c.name, spark_type(c)) for c in spec.captured_columns])


def event_schema(spec: TableSpec) -> T.StructType:
    return T.StructType([*METADATA.fields, *row_schema(spec).fields])


def validate(spec: TableSpec) -> None:
    """Refuses a spec whose log and table cannot share one schema, or cannot be matched by key."""
    source = {c.name: c for c in spec.columns}
    captured = {c.name: c for c in spec.captured_columns}
    where = spec.qualified_name
    for name, column in captured.items():
        if name not in source:
            raise ValueError(f"{where}: captured column {name!r} is no longer in the table")
        was, now = logical_type(column), logical_type(source[name])
        if was != now:
            raise ValueError(f"{where}: column {name!r} is captured as ({column}) but is ({source[name]}) in the table")
    for name in spec.pk_columns:
        if name not in captured:
            raise ValueError(f"{where}: key column {name!r} is not captured")
        if captured[name].computed_definition is not None:
            raise ValueError(f"{where}: key column {name!r} is computed, and reads NULL")
    if clash := sorted(set(captured) & set(METADATA.names)):
        raise ValueError(f"{where}: columns named like event metadata: {', '.join(clash)}")


def lossless(value: Column, was: T.DataType, to: T.DataType, label: str) -> Column:
    """value as another type; a value that does not survive it stops the query."""
    new = value.try_cast(to)
    same = new.isNotNull() if isinstance(was, T.StringType) else new.isNotNull() & new.try_cast(was).eqNullSafe(value)
    if isinstance(was, T.BinaryType) and isinstance(to, T.StringType):
        new = value.cast(to)
        same = F.is_valid_utf8(new)
    problem = F.raise_error(F.lit(f"{label}: a value does not fit from {was.simpleString()} into {to.simpleString()}")).cast(to)
    return F.when(value.isNull() | same, new).otherwise(problem)


def conform(df: DataFrame, schema: T.StructType, context: str) -> DataFrame:
    """df with exactly the schema's columns, in its order and types; nothing is dropped, filled or rounded on the way."""
    if twice := sorted(n for n, k in Counter(df.columns).items() if k > 1):
        raise ValueError(f"{context}: duplicate columns {', '.join(twice)}")
    missing, unexpected = [n for n in schema.names if n not in df.columns], [n for n in df.columns if n not in schema.names]
    if missing or unexpected:
        raise ValueError(f"{context}: missing columns {missing}, unexpected columns {unexpected}")
    out = []
    for field in schema.fields:
        was, name = df.schema[field.name].dataType, F.col(f"`{field.name}`")
        if was == field.dataType:
            out.append(name.alias(field.name))
        elif isinstance(was, T.NullType):
            out.append(name.cast(field.dataType).alias(field.name))
        elif castable(was, field.dataType):
            out.append(lossless(name, was, field.dataType, f"{context}, column {field.name!r}").alias(field.name))
        else:
            raise ValueError(f"{context}: column {field.name!r} cannot go from {was.simpleString()} to {field.dataType.simpleString()}")
    return df.select(*out)


def castable(was: T.DataType, to: T.DataType) -> bool:
    clocks, numbers = (T.TimestampType, T.TimestampNTZType, T.DateType), (T.NumericType,)
    if isinstance(was, T.StringType) or isinstance(to, T.StringType):
        return isinstance(was, T.AtomicType)
    return any(isinstance(was, k) and isinstance(to, k) for k in (clocks, numbers))
