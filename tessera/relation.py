"""What table queries and grouped queries share: order, slice, terminals."""

from __future__ import annotations

import base64
import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ColumnNotFoundError, MultipleRowsFoundError, NoRowsFoundError, QueryError, QueryTypeError
from tessera.types import from_storage

RID = "__rid"
#: Spark gathers the offset + limit rows of a slice (all rows, without a limit) in one task: this many at most, deeper slices are stored.
DEEP = 10_000


def c(name: str):
    """A column whose name may hold dots."""
    return F.col(f"`{name}`")


def flatten(columns: tuple) -> list[str]:
    """("a", "b") or (["a", "b"],) as a list of unique names."""
    names = list(columns[0]) if len(columns) == 1 and isinstance(columns[0], (list, tuple)) else list(columns)
    if not names:
        raise QueryError("at least one column is needed")
    for n in names:
        if not isinstance(n, str) or not n.strip():
            raise QueryTypeError("column names must be non-empty strings")
    if len(set(names)) != len(names):
        raise QueryError("a column is named twice")
    return names


def whole(value: Any, what: str) -> int:
    if type(value) is not int:
        raise QueryTypeError(f"{what} expects a whole number")
    if value < 0:
        raise QueryError(f"{what} must not be negative")
    return value


def _turns(kind: T.DataType) -> bool:
    return isinstance(kind, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _turned(x: Column, kind: T.DataType) -> Column:
    """A whole number whose order is the reverse of x's."""
    if isinstance(kind, T.DateType):
        x = F.unix_date(x)
    elif isinstance(kind, T.TimestampNTZType):
        x = F.unix_micros(F.to_utc_timestamp(x.cast("timestamp"), F.current_timezone()))
    elif isinstance(kind, T.TimestampType):
        x = F.unix_micros(x)
    return F.bitwise_not(x.cast("int") if isinstance(kind, T.BooleanType) else x)


def json_value(value: Any) -> Any:
    """What JSON has no form for: bytes as an object with base64 text (its three keys are fixed), dates and times as ISO text."""
    if isinstance(value, (bytes, bytearray)):
        return {"__type__": "bytes", "encoding": "base64", "value": base64.b64encode(value).decode("ascii")}
    if isinstance(value, (dt.date, dt.time)):
        return value.isoformat()
    raise TypeError(f"{type(value).__name__} has no JSON form")


class Relation:
    """Builder steps and terminals; subclasses are frozen dataclasses that give result_columns(), kinds() and _frame()."""

    def result_columns(self) -> list[str]:
        raise NotImplementedError

    def orderable(self) -> list[str]:
        raise NotImplementedError

    def kinds(self) -> dict[str, type]:
        raise NotImplementedError

    def to_df(self, **options: Any) -> DataFrame:
        raise NotImplementedError

    def _storable(self) -> bool:
        """Whether the rows of the result may be written to the shared folder as they are."""
        return True

    def _known(self, names: list[str], among: list[str]) -> None:
        for n in names:
            if n not in among:
                raise ColumnNotFoundError(f"column '{n}' does not exist; there are {', '.join(among)}")

    def order_by(self, *columns: Any, descending: bool = False):
        """Names, or (name, "asc" or "desc"); further calls add lower keys. Missing values come last either way."""
        if type(descending) is not bool:
            raise QueryTypeError("descending must be a bool")
        if len(columns) == 1 and isinstance(columns[0], list):
            columns = tuple(columns[0])
        if not columns:
            raise QueryError("order_by() needs at least one column")
        keys = []
        for x in columns:
            if isinstance(x, str):
                keys.append((x, descending))
            elif isinstance(x, tuple) and len(x) == 2 and all(isinstance(y, str) for y in x):
                if x[1].strip().lower() not in ("asc", "desc"):
                    raise QueryError(f"an order is asc or desc, not {x[1]!r}")
                keys.append((x[0], x[1].strip().lower() == "desc"))
            else:
                raise QueryTypeError("order_by() expects names or (name, direction) pairs")
        self._known([k for k, _ in keys], self.orderable())
        return replace(self, order=(*self.order, *keys))

    orderby = order_by

    def select(self, *columns: Any):
        names = flatten(columns)
        self._known(names, self.orderable())
        return replace(self, selected=tuple(names))

    def limit(self, count: int | None):
        return replace(self, limit_=None if count is None else whole(count, "limit()"))

    def offset(self, count: int):
        return replace(self, offset_=whole(count, "offset()"))

    def distinct(self, enabled: bool = True):
        if type(enabled) is not bool:
            raise QueryTypeError("distinct() expects a bool")
        return replace(self, distinct_=enabled)

    def _sort_keys(self) -> list:
        return [c(n).desc_nulls_last() if down else c(n).asc_nulls_last() for n, down in self.order]

    def _finish(self, df: DataFrame, ordinal: list | None, ordered: bool) -> DataFrame:
        """order, select, distinct, offset, limit over df. ordinal: columns that settle ties; ordered: also by them alone."""
        names, keys = self.result_columns(), self._sort_keys()
        ordinal = ordinal or []
        sliced = self.limit_ is not None or self.offset_ > 0
        if self.distinct_:
            hidden = [n for n, _ in self.order if n not in names]
            if hidden or (ordinal and (sliced or keys or ordered)):
                df = self._first_of_each(df, names, ordinal)
            else:
                df = df.select(*map(c, names)).distinct()
                df = df.orderBy(*keys, *([] if not sliced else [c(n).asc_nulls_last() for n in names])) if keys or sliced else df
        else:
            if keys or ((sliced or ordered) and ordinal):
                # ties that nothing settles are told apart by their partition, so that a deep slice need not sort them in one task
                df = df.orderBy(*keys, *(ordinal or ([F.spark_partition_id()] if self._deep() else [])))
            df = df if df.columns == names else df.select(*map(c, names))
        if self._deep() and self._storable() and not any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema):
            return self.db._slice(df, self.offset_, self.limit_)
        if self.offset_:
            df = df.offset(self.offset_)
        return df if self.limit_ is None else df.limit(self.limit_)

    def _deep(self) -> bool:
        return self.offset_ > 0 if self.limit_ is None else self.offset_ + self.limit_ > DEEP

    def _first_of_each(self, df: DataFrame, names: list[str], ordinal: list) -> DataFrame:
        """Distinct rows, placed where the first of each stands: its sort keys are the least of an aggregate, so rows that
        share all values meet as partial results.

        The keys are one struct that is compared as a whole; keys of the other direction must be turned round, which works
        for whole numbers, dates, times and booleans. Where it doesn't, the first rows are found by a window.
        """
        kinds = {f.name: f.dataType for f in df.schema}
        asked = [(c(n), n, down) for n, down in self.order]
        asked += [(o, df.select(o).columns[0], False) for o in ordinal]
        fixed = {down for _, n, down in asked if not _turns(kinds[n])}
        if len(fixed) > 1:
            keys = [x.desc_nulls_last() if down else x.asc_nulls_last() for x, _, down in asked]
            first = F.row_number().over(Window.partitionBy(*map(c, names)).orderBy(*keys))
            df = df.withColumn("__first", first).where(F.col("__first") == 1)
            return df.orderBy(*keys).select(*map(c, names))
        down = fixed.pop() if fixed else False
        parts = []
        for i, (x, n, way) in enumerate(asked):
            parts += [(x.isNotNull() if down else x.isNull()).alias(f"n{i}"), (x if way == down else _turned(x, kinds[n])).alias(f"k{i}")]
        key = F.struct(*parts) if parts else F.lit(0)
        found = df.groupBy(*map(c, names)).agg((F.max(key) if down else F.min(key)).alias("__first"))
        return found.orderBy(F.col("__first").desc() if down else F.col("__first").asc()).select(*map(c, names))

    # terminals

    def _rows(self, df: DataFrame) -> list[dict[str, Any]]:
        kinds, names = self.kinds(), df.columns
        return [{n: from_storage(v, kinds.get(n, str)) for n, v in zip(names, row, strict=True)} for row in df.collect()]

    def to_list(self, **options: Any) -> list[dict[str, Any]]:
        return self._rows(self.to_df(ordered=True, **options))

    def to_json(self, indent: int | None = 2, ensure_ascii: bool = False, **options: Any) -> str:
        return json.dumps(self.to_list(**options), indent=indent, ensure_ascii=ensure_ascii, default=json_value)

    def to_pandas(self, **options: Any):
        import pandas as pd

        return pd.DataFrame(self.to_list(**options), columns=self.result_columns())

    def to_numpy(self, dtype: Any = None, include_columns: bool = False, **options: Any):
        import numpy as np

        names = self.result_columns()
        rows = [[r[n] for n in names] for r in self.to_list(**options)]
        array = np.array(rows, dtype=dtype if dtype is not None else object) if rows else np.empty((0, len(names)), dtype=dtype or object)
        return (array, names) if include_columns else array

    def pluck(self, column_name: str, **options: Any) -> list[Any]:
        self._known([column_name], self.orderable())
        return [r[column_name] for r in replace(self, selected=(column_name,)).to_list(**options)]

    def _least(self, n: int):
        return replace(self, limit_=n if self.limit_ is None else min(n, self.limit_))

    def first(self, **options: Any) -> dict[str, Any] | None:
        rows = self._least(1).to_list(**options)
        return rows[0] if rows else None

    def one(self, **options: Any) -> dict[str, Any]:
        rows = self._least(2).to_list(**options)
        if not rows:
            raise NoRowsFoundError("one() found no row")
        if len(rows) > 1:
            raise MultipleRowsFoundError("one() found more than one row")
        return rows[0]

    def exists(self) -> bool:
        return bool(self._least(1).to_df().take(1))

    def __iter__(self) -> Iterator[dict[str, Any]]:
        kinds, df = self.kinds(), self.to_df(ordered=True)
        for row in df.toLocalIterator():
            yield {n: from_storage(v, kinds.get(n, str)) for n, v in zip(df.columns, row, strict=True)}
