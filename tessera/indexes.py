"""Indexes: a copy of the snapshot, dealt by ranges of the index's columns and sorted by them.

A query whose conditions fix the values of the first columns of an index reads its copy, of which the scan's pushed filters
leave the files and row groups whose ranges hold the values. Unique indexes check new rows against the keys that are there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import ColumnNotFoundError, ConstraintError, QueryTypeError, SchemaError
from tessera.relation import c


@dataclass(frozen=True)
class IndexDef:
    name: str
    table_name: str
    columns: tuple[str, ...]
    unique: bool = False
    nulls_distinct: bool = True


def some_null(columns: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [c(n).isNull() for n in columns])


class IndexMixin:
    """Index methods of a database."""

    indexes: dict[str, IndexDef]
    copies: dict[str, DataFrame]

    def create_index(self, table_name: str, columns: Any, name: str | None = None, unique: bool = False, nulls_distinct: bool = True) -> IndexDef:
        self._table(table_name)
        names = [columns] if isinstance(columns, str) else list(columns) if isinstance(columns, (list, tuple)) else []
        if not names or len(set(names)) != len(names):
            raise SchemaError("an index needs one or more different columns")
        for n in names:
            if n not in self.schema[table_name].columns:
                raise ColumnNotFoundError(f"column '{n}' does not exist in table '{table_name}'")
        if type(unique) is not bool or type(nulls_distinct) is not bool:
            raise QueryTypeError("unique and nulls_distinct must be bools")
        name = name or f"{'uidx' if unique else 'idx'}_{table_name}_{'_'.join(names)}"
        self._name(name, "Index")
        if name in self.indexes:
            raise SchemaError(f"index '{name}' already exists")
        index = IndexDef(name, table_name, tuple(names), unique, nulls_distinct)
        self._unique(index, self.frame(table_name))
        self.indexes[name] = index
        self._build(index)
        return index

    # copies

    def _build(self, index: IndexDef) -> None:
        base = self.state[index.table_name].base
        if base is None:
            self.copies.pop(index.name, None)
            return
        keys = self._index_keys(index, base)
        self.copies[index.name] = self._write(base.repartitionByRange(*keys).sortWithinPartitions(*keys))

    def _build_all(self, table: str) -> None:
        for index in self.indexes.values():
            if index.table_name == table:
                self._build(index)

    def _best_index(self, table: str, facts: set[str]) -> IndexDef | None:
        """The index of which the facts fix the most leading columns."""
        ahead = lambda i: next((k for k, n in enumerate(i.columns) if n not in facts), len(i.columns))
        known = [i for i in self.indexes.values() if i.table_name == table and i.name in self.copies and ahead(i)]
        return max(known, key=ahead, default=None)

    def _indexed(self, table: str, facts: set[str]) -> DataFrame:
        """The table's rows, from the copy of an index where there is a fitting one."""
        df, index = self.frame(table), self._best_index(table, facts)
        if index is None:
            return df
        copy = self.copies[index.name]
        return copy.unionByName(self._waiting(table)) if self.state[table].rows else copy

    def _index_keys(self, index: IndexDef, df: DataFrame) -> list[Column]:
        columns = self.schema[index.table_name].columns
        return [c(n)["blind_index"] if columns[n].is_encrypted else c(n) for n in index.columns]

    def _unique(self, index: IndexDef, df: DataFrame) -> None:
        if not index.unique:
            return
        if index.nulls_distinct:
            df = df.where(~some_null(index.columns))
        keys = [k.alias(f"k{i}") for i, k in enumerate(self._index_keys(index, df))]
        if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ConstraintError(f"unique index '{index.name}' is violated")

    def _unique_new(self, table: str, new: DataFrame, old: DataFrame | None, few: bool = False) -> None:
        """That new rows keep the unique indexes: among themselves, and against the keys of the old ones."""
        for index in self.indexes.values():
            if index.table_name != table or not index.unique:
                continue
            self._unique(index, new)
            if old is None:
                continue
            rows = new.where(~some_null(index.columns)) if index.nulls_distinct else new
            mine = rows.select(*[k.alias(f"new{i}") for i, k in enumerate(self._index_keys(index, new))])
            held = old.select(*[k.alias(f"old{i}") for i, k in enumerate(self._index_keys(index, old))])
            same = reduce(Column.__and__, [F.col(f"old{i}").eqNullSafe(F.col(f"new{i}")) for i in range(len(index.columns))])
            if held.join(F.broadcast(mine) if few else mine, same, "left_semi").limit(1).count():
                raise ConstraintError(f"unique index '{index.name}' is violated")

    def _unique_all(self, table: str, df: DataFrame) -> None:
        for index in self.indexes.values():
            if index.table_name == table:
                self._unique(index, df)

    def _index(self, name: str) -> IndexDef:
        if name not in self.indexes:
            raise SchemaError(f"index '{name}' does not exist")
        return self.indexes[name]

    def drop_index(self, index_name: str) -> None:
        del self.indexes[self._index(index_name).name]
        self.copies.pop(index_name, None)

    def list_indexes(self, table_name: str | None = None) -> list[str]:
        if table_name is not None:
            self._table(table_name)
        return [n for n, i in self.indexes.items() if table_name in (None, i.table_name)]

    def describe_index(self, index_name: str) -> dict[str, Any]:
        i = self._index(index_name)
        df = self.frame(i.table_name)
        keys = [k.alias(f"k{j}") for j, k in enumerate(self._index_keys(i, df))]
        groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        return {
            "name": i.name, "table_name": i.table_name, "columns": list(i.columns), "unique": i.unique, "nulls_distinct": i.nulls_distinct,
            "key_count": groups[0], "row_id_count": groups[1],
        }

    def describe_indexes(self, table_name: str | None = None) -> dict[str, dict[str, Any]]:
        return {n: self.describe_index(n) for n in self.list_indexes(table_name)}
