"""The query builder: an immutable description that becomes one lazy DataFrame.

Whatever the order of calls, the steps are: where, order_by, select, distinct, offset, limit. A query on a table reads the
table's rows at the time it runs; a join fixes both sides when it is built.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import joins
from tessera.errors import QueryError, QueryTypeError
from tessera.expr import Condition, Operand
from tessera.relation import RID, Relation, c, flatten
from tessera.types import from_storage, python_type, spark_type

MASK = "[ENCRYPTED]"


@dataclass(frozen=True, eq=False)
class Query(Relation):
    db: Any
    name: str
    table: str | None = None
    source: DataFrame | None = None
    source_kinds: dict[str, type] = field(default_factory=dict)
    encrypted: dict[str, tuple[str, str]] = field(default_factory=dict)  # column of a derived source: (table, column) it comes from
    conditions: tuple = ()
    selected: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    distinct_: bool = False
    limit_: int | None = None
    offset_: int = 0

    @staticmethod
    def from_rows(db: Any, name: str, rows: list[dict[str, Any]], columns: list[str]) -> Query:
        """A derived relation of given rows; each row has exactly the columns."""
        for r in rows:
            if set(r) != set(columns):
                raise QueryError(f"a row of '{name}' does not have the columns {', '.join(columns)}")
        kinds = {n: next((type(r[n]) for r in rows if r[n] is not None), str) for n in columns}
        schema = T.StructType([T.StructField(n, spark_type(kinds[n])) for n in columns])
        from tessera.types import to_storage

        df = db.spark.createDataFrame([tuple(to_storage(r[n], kinds[n]) for n in columns) for r in rows], schema)
        return Query(db, name, source=df, source_kinds=kinds)

    @staticmethod
    def from_df(db: Any, name: str, df: DataFrame) -> Query:
        return Query(db, name, source=df, source_kinds={f.name: python_type(f.dataType) for f in df.schema})

    # description

    def columns(self) -> list[str]:
        return list(self.db.schema[self.table].columns) if self.table else [n for n in self.source.columns if n != RID]

    def result_columns(self) -> list[str]:
        return list(self.selected) or self.columns()

    def orderable(self) -> list[str]:
        return self.columns()

    def kinds(self) -> dict[str, type]:
        return {n: d.kind for n, d in self.db.schema[self.table].columns.items()} if self.table else self.source_kinds

    def origin(self) -> dict[str, tuple[str, str]]:
        """Encrypted columns and where their values come from."""
        if self.table:
            return {n: (self.table, n) for n, d in self.db.schema[self.table].columns.items() if d.is_encrypted}
        return self.encrypted

    # steps

    def where(self, condition: Condition | Callable[[dict], bool]) -> Query:
        if isinstance(condition, Condition):
            self._known(sorted(condition.columns()), self.columns())
            self._compiled(condition, build_only=True)
        elif not callable(condition):
            raise QueryTypeError("where() expects a condition or a callable")
        return replace(self, conditions=(*self.conditions, condition))

    def group_by(self, *columns: Any):
        from tessera.grouping import GroupedQuery

        names = flatten(columns)
        self._known(names, self.columns())
        return GroupedQuery(self, tuple(names))

    def join(self, other: Any, **options: Any) -> Query:
        return joins.join(self, other, **options)

    def inner_join(self, other: Any, **options: Any) -> Query:
        return self.join(other, method="inner", **options)

    def left_join(self, other: Any, **options: Any) -> Query:
        return self.join(other, method="left", **options)

    def right_join(self, other: Any, **options: Any) -> Query:
        return self.join(other, method="right", **options)

    def full_join(self, other: Any, **options: Any) -> Query:
        return self.join(other, method="full", **options)

    def cross_join(self, other: Any, **options: Any) -> Query:
        return self.join(other, method="cross", **options)

    def natural_join(self, other: Any, **options: Any) -> Query:
        return self.join(other, method="natural", **options)

    # compilation

    def _base(self) -> DataFrame:
        return self.db.frame(self.table) if self.table else self.source

    def _operand(self, name: str, build_only: bool = False) -> Operand:
        kind = self.kinds()[name]
        if name in self.origin():
            table, column = self.origin()[name]
            crypto = self.db.crypto
            index = (lambda v: "") if build_only else (lambda v: crypto.blind_index(table, column, v, kind))
            return Operand(c(f"__plain_{name}"), kind, (c(name)["blind_index"], index))
        return Operand(c(name), kind)

    def _compiled(self, condition: Condition, build_only: bool = False) -> Column:
        return condition.compile(lambda n: self._operand(n, build_only))

    def filtered(self) -> DataFrame:
        """The source after where, with __plain_x for every encrypted column x that conditions or order read."""
        facts = set().union(*(x.facts() for x in self.conditions if isinstance(x, Condition)))
        df, secret = self.db._indexed(self.table, facts) if self.table and facts else self._base(), self.origin()
        calls = [x for x in self.conditions if not isinstance(x, Condition)]
        needs = {leaf.name for x in self.conditions if isinstance(x, Condition) for leaf in x.leaves() if leaf.op not in ("equal", "in", "null")}
        needs = (set(secret) if calls else needs & set(secret)) | {n for n, _ in self.order if n in secret}
        touched = any(isinstance(x, Condition) and x.columns() & set(secret) for x in self.conditions)
        if needs or touched:
            self.db.crypto.require()
        for n in sorted(needs):
            df = self.db.crypto.decrypted(df, n, f"__plain_{n}", self.kinds()[n])
        for x in self.conditions:
            df = df.where(self._compiled(x) if isinstance(x, Condition) else self._called(x))
        return df

    def _called(self, function: Callable[[dict], bool]) -> Column:
        """A Python predicate over whole rows, in Arrow batches: the slow path, which no scan can use."""
        kinds, secret = {n: self.kinds()[n] for n in self.columns()}, self.origin()
        row = F.struct(*[c(f"__plain_{n}" if n in secret else n).alias(f"c{i}") for i, n in enumerate(kinds)])

        @F.arrow_udf("boolean")
        def call(rows: pa.Array) -> pa.Array:
            out = []
            for r in zip(*(rows.field(i).to_pylist() for i in range(len(kinds))), strict=True):
                found = function({n: from_storage(v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v, k) for (n, k), v in zip(kinds.items(), r, strict=True)})
                if type(found) is not bool:
                    raise TypeError(f"a where() callable must return a bool, not {type(found).__name__}")
                out.append(found)
            return pa.array(out, pa.bool_())

        return call(row)

    def to_df(self, decrypt: bool = False, ordered: bool = False, raw: bool = False) -> DataFrame:
        """The result as a DataFrame. Encrypted columns are masked, decrypted, or (raw) as they are stored."""
        df, secret = self.filtered(), self.origin()
        plain = replace(self, order=tuple((f"__plain_{n}" if n in secret else n, d) for n, d in self.order))
        df = plain._finish(df, self._ordinal(df), ordered)
        shown = [n for n in df.columns if n in secret]
        if raw or not shown:
            return df
        if not decrypt:
            return df.withColumns({n: F.when(c(n).isNotNull(), F.lit(MASK)) for n in shown})
        self.db.crypto.require()
        names = df.columns
        for n in shown:
            df = self.db.crypto.decrypted(df, n, n, self.kinds()[n])
        return df.select(*map(c, names))

    def _ordinal(self, df: DataFrame) -> list:
        """What settles ties: insertion order, or the primary key of a registered table."""
        if RID in df.columns:
            return [F.col(RID)]
        if self.table:
            return [c(n) for n in self.db.schema[self.table].primary_key]
        return []

    # scalar results

    def _values(self, column_name: str, numeric: bool) -> DataFrame:
        self._known([column_name], self.columns())
        if numeric and self.kinds()[column_name] not in (int, float) and self.kinds()[column_name].__name__ != "AutoNumber":
            raise QueryTypeError(f"column '{column_name}' is not numeric")
        return replace(self, selected=(column_name,)).to_df(decrypt=column_name in self.origin())

    def count(self, column_name: str | None = None) -> int:
        """Rows, or (with a column) its values that are not missing; after distinct(), different ones."""
        if column_name is None:
            return self.to_df().count()
        return self._values(column_name, False).where(c(column_name).isNotNull()).count()

    def scalar_df(self, function: str, column_name: str, alias: str) -> DataFrame:
        if function in ("sum", "avg"):
            df = self._values(column_name, True)
        else:
            df = self._values(column_name, False)
        return df.agg(getattr(F, function)(c(column_name)).alias(alias))

    def _scalar(self, function: str, column_name: str) -> Any:
        return from_storage(self.scalar_df(function, column_name, "x").first()[0], self.kinds()[column_name] if function != "avg" else float)

    def sum(self, column_name: str) -> Any:
        return self._scalar("sum", column_name)

    def average(self, column_name: str) -> Any:
        return self._scalar("avg", column_name)

    avg = average

    def min(self, column_name: str) -> Any:
        return self._scalar("min", column_name)

    def max(self, column_name: str) -> Any:
        return self._scalar("max", column_name)
