"""Logical (Python) types, their Spark types, and value checks."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import SchemaError, TesseraTypeError


class AutoNumber:
    """Marks a column whose whole numbers are given out by the table."""


SPARK = {
    int: T.LongType(), AutoNumber: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType(),
    dict: T.StringType(), list: T.StringType(), dt.datetime: T.TimestampNTZType(), dt.date: T.DateType(),
    dt.time: T.StringType(),  # Parquet has no TIME here: ISO text with microseconds, whose order is that of time
}
SQL = {
    int: "INTEGER", float: "DOUBLE PRECISION", str: "TEXT", bool: "BOOLEAN", bytes: "BYTEA", dict: "JSONB", list: "JSONB",
    dt.datetime: "TIMESTAMP", dt.date: "DATE", dt.time: "TIME",
}
NAMES = {t.__name__: t for t in SPARK}
LONG = 1 << 63


def spark_type(kind: type) -> T.DataType:
    try:
        return SPARK[kind]
    except (KeyError, TypeError):
        raise SchemaError(f"type {kind!r} is not supported") from None


def python_type(kind: T.DataType) -> type:
    """The logical type of a column that comes from a DataFrame."""
    if isinstance(kind, T.IntegralType):
        return int
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return float
    for p in (bool, bytes, dt.datetime, dt.date):
        if isinstance(kind, type(SPARK[p])):
            return p
    if isinstance(kind, T.TimestampType):
        return dt.datetime
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return list if isinstance(kind, T.ArrayType) else dict
    return str


def fits(value: Any, kind: type) -> bool:
    """Whether a value may stand in a column: a bool is no int, an int no float, a datetime is a date."""
    if kind in (int, AutoNumber):
        return type(value) is int
    if kind is float:
        return type(value) is float
    return isinstance(value, kind)


def check(value: Any, kind: type, what: str) -> None:
    if value is None or fits(value, kind):
        if isinstance(value, int) and not -LONG <= value < LONG:
            raise TesseraTypeError(f"{what}: {value} does not fit into 64 bits")
        return
    raise TesseraTypeError(f"{what} expects {kind.__name__}, got {type(value).__name__}")


def to_storage(value: Any, kind: type) -> Any:
    if value is None:
        return None
    if kind in (dict, list):
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    if kind is dt.time:
        return value.isoformat(timespec="microseconds")
    return value.date() if kind is dt.date and isinstance(value, dt.datetime) else value


def from_storage(value: Any, kind: type) -> Any:
    if value is None:
        return None
    if kind in (dict, list) and isinstance(value, str):
        return json.loads(value)
    if kind is dt.time and isinstance(value, str):
        return dt.time.fromisoformat(value)
    return bytes(value) if kind is bytes else value


def literal(value: Any, kind: type) -> Column:
    return F.lit(to_storage(value, kind)).cast(spark_type(kind))
