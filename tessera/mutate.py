"""Insert, update and delete on immutable snapshots.

New rows given from Python wait in a driver-side buffer that belongs to the table's state; they join the snapshot as one
more partition when the table is read, and are written to the shared folder when there are FLUSH of them. Updates and
deletes build the next snapshots of all tables that change, write them, check them, and only then swap the pointers.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from functools import reduce
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import ColumnNotFoundError, ConstraintError, QueryError, QueryTypeError, TesseraTypeError
from tessera.expr import Condition
from tessera.relation import RID, c
from tessera.types import AutoNumber, check, literal, spark_type

FLUSH = 10_000


class MutateMixin:
    """Changing methods of a database."""

    def _insert_row(self, table: str, row: dict[str, Any], sequences: dict[str, int]) -> dict[str, Any]:
        """The full row: AutoNumbers, defaults and missing values filled in, types checked."""
        if not isinstance(row, dict):
            raise TesseraTypeError("a row must be a dict")
        definition = self.schema[table]
        for n in row:
            if n not in definition.columns:
                raise ColumnNotFoundError(f"column '{n}' does not exist in table '{table}'")
        out: dict[str, Any] = {}
        for n, d in definition.columns.items():
            if d.kind is AutoNumber:
                value = row[n] if n in row else sequences[n] + 1
                check(value, AutoNumber, f"column '{n}'")
                if value is None:
                    raise ConstraintError(f"AutoNumber column '{n}' cannot be null")
                sequences[n] = max(sequences[n], value)
            elif n in row:
                value = row[n]
            else:
                value = copy.deepcopy(d.default) if d.has_default else None
            if value is None and not d.nullable:
                raise ConstraintError(f"column '{n}' of table '{table}' cannot be null")
            check(value, d.kind, f"column '{n}' of table '{table}'")
            out[n] = value
        return out

    def _keys_exist(self, table: str, columns: list[str], keys: set[tuple]) -> set[tuple]:
        """Those of the keys that the table holds."""
        state = self.state[table]
        found = keys & state.waiting_keys(tuple(columns))
        left = keys - found
        if left and state.base is not None:
            kinds = [self.schema[table].columns[n].kind for n in columns]
            given = self._given([dict(zip(columns, k, strict=True)) for k in left], dict(zip(columns, kinds, strict=True)))
            rows = state.base.select(*map(c, columns)).join(given, columns, "left_semi").distinct()
            found |= {tuple(r) for r in rows.collect()}
        return found

    def _check_foreign(self, table: str, rows: list[dict[str, Any]]) -> None:
        for fk in self.schema[table].foreign_keys.values():
            keys = {(r[fk.column],) for r in rows if r.get(fk.column) is not None}
            gone = keys - self._keys_exist(fk.target_table, [fk.target_column], keys)
            if gone:
                raise ConstraintError(f"{table}.{fk.column} = {next(iter(gone))[0]!r} has no row in {fk.target_table}.{fk.target_column}")

    def insert(self, table: str, row: dict[str, Any]) -> dict[str, Any]:
        return self.insert_many(table, [row])[0]

    def insert_many(self, table: str, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """All rows or none; foreign keys must be there before."""
        self._table(table)
        if not isinstance(rows, (list, tuple)):
            raise TesseraTypeError("insert_many() expects a list of rows")
        definition, state = self.schema[table], self.state[table]
        if any(d.is_encrypted for d in definition.columns.values()) and rows:
            self.crypto.require()
        sequences = dict(definition.auto_sequences)
        full = [self._insert_row(table, r, sequences) for r in rows]
        if not full:
            return []
        pk = definition.primary_key
        if pk:
            keys = [tuple(r[n] for n in pk) for r in full]
            if any(v is None for k in keys for v in k):
                raise ConstraintError(f"the primary key of '{table}' cannot be null")
            if len(set(keys)) < len(keys) or self._keys_exist(table, pk, set(keys)):
                raise ConstraintError(f"a primary key of '{table}' exists already")
        self._check_foreign(table, full)
        numbered = [{**r, RID: state.next_rid + i} for i, r in enumerate(full)]
        before = state.base, state.rows
        unique = any(i.table_name == table and i.unique for i in self.indexes.values())
        secret = any(d.is_encrypted for d in definition.columns.values())
        if unique and not secret:
            old = self._joined(table) if state.base is not None or state.rows else None
            self._unique_new(table, self._given(full, {n: d.kind for n, d in definition.columns.items()}), old, few=len(full) <= FLUSH)
        state.rows = state.rows + numbered
        try:
            if unique and secret:
                self._unique_all(table, self.frame(table))
        except Exception:
            state.base, state.rows = before
            raise
        state.next_rid += len(full)
        definition.auto_sequences.update(sequences)
        if len(state.rows) >= FLUSH:
            self._swap({table: self.frame(table)})
        return copy.deepcopy(full)

    def insert_df(self, table: str, df: DataFrame) -> int:
        """Rows of a DataFrame, checked by Spark jobs: missing columns get defaults, AutoNumbers follow the row order.

        Rows are written once with Spark's own ids; how many each partition holds then gives the numbers without gaps.
        """
        self._table(table)
        definition, state = self.schema[table], self.state[table]
        secret = {n: d.kind for n, d in definition.columns.items() if d.is_encrypted}
        if secret:
            self.crypto.require()
        for n in df.columns:
            if n not in definition.columns:
                raise ColumnNotFoundError(f"column '{n}' does not exist in table '{table}'")
        names, start, mine = df.columns, state.next_rid, 33  # a partition's ids start at its number shifted by 33 bits
        held = self._write(df.withColumn(RID, F.monotonically_increasing_id()))
        sizes = held.groupBy(F.shiftright(RID, mine).alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
        firsts = list(accumulate((r["n"] for r in sizes), initial=start))
        parts = self.spark.createDataFrame([(r["__part"], first) for r, first in zip(sizes, firsts, strict=False)], "__part long, __from long")
        df = held.join(F.broadcast(parts), F.shiftright(RID, mine) == F.col("__part"))  # a row for each task that wrote
        df = df.withColumn(RID, F.col("__from") + F.col(RID).bitwiseAND(F.lit((1 << mine) - 1))).drop("__part", "__from")
        autos = {n: s for n, s in definition.auto_sequences.items() if n not in names}
        df = df.select(*[
            (F.col(RID) - start + autos[n] + 1 if n in autos else c(n) if n in names else literal(d.default if d.has_default else None, d.kind)).cast(spark_type(d.kind)).alias(n)
            for n, d in definition.columns.items()
        ], F.col(RID))
        df = self.crypto.encrypted(self.crypto.prepared(df, table, secret), secret) if secret else df
        new = self._write(self._clustered(table, df))
        bad = [n for n, d in definition.columns.items() if not d.nullable]
        counts = new.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(c(n).isNull(), 1)).alias(f"null_{n}") for n in bad]).first()
        if any(counts[f"null_{n}"] for n in bad):
            raise ConstraintError(f"a column of '{table}' that cannot be null holds nulls")
        old, pk = self.frame(table), definition.primary_key
        if pk and (new.groupBy(*map(c, pk)).count().where("count > 1").limit(1).count() or old.select(*map(c, pk)).join(new, pk, "left_semi").limit(1).count()):
            raise ConstraintError(f"a primary key of '{table}' exists already")
        for fk in definition.foreign_keys.values():
            parent = self.frame(fk.target_table).select(c(fk.target_column).alias("__k"))
            if new.where(c(fk.column).isNotNull()).join(parent, c(fk.column) == F.col("__k"), "left_anti").limit(1).count():
                raise ConstraintError(f"{table}.{fk.column} holds values that are not in {fk.target_table}.{fk.target_column}")
        self._unique_new(table, new, old)
        self._append(table, new)
        state.next_rid += counts["n"]
        for n in definition.auto_sequences:
            top = new.agg(F.max(c(n))).first()[0]
            definition.auto_sequences[n] = max(definition.auto_sequences[n], top or 0)
        return counts["n"]

    def _chosen(self, table: str, where: Any, allow_all: bool) -> DataFrame:
        """__rid of the rows that a change is about."""
        self._table(table)
        if type(allow_all) is not bool:
            raise QueryTypeError("allow_all must be a bool")
        if where is None and not allow_all:
            raise QueryError("give where, or allow_all=True to change all rows")
        query = self.query(table)
        if where is not None:
            if not isinstance(where, Condition) and not callable(where):
                raise QueryTypeError("where expects a condition or a callable")
            query = query.where(where)
        df = query.filtered()
        return df.select(RID) if RID in df.columns else df

    def update(self, table: str, values: dict[str, Any], where: Condition | Callable | None = None, allow_all: bool = False) -> int:
        """Sets constants in the chosen rows; returns how many there are."""
        self._table(table)
        definition = self.schema[table]
        if not isinstance(values, dict) or not values:
            raise TesseraTypeError("update() expects a dict of values")
        for n, v in values.items():
            if n not in definition.columns:
                raise ColumnNotFoundError(f"column '{n}' does not exist in table '{table}'")
            d = definition.columns[n]
            if n in definition.primary_key or d.kind is AutoNumber:
                raise ConstraintError(f"column '{n}' is a key and cannot be changed")
            if v is None and not d.nullable:
                raise ConstraintError(f"column '{n}' of table '{table}' cannot be null")
            check(v, d.kind, f"column '{n}' of table '{table}'")
        self._check_foreign(table, [values])
        if any(d.is_encrypted for d in definition.columns.values()) and (any(definition.columns[n].is_encrypted for n in values)):
            self.crypto.require()
        chosen = self._write(self._chosen(table, where, allow_all))
        n = chosen.count()
        if n:
            secret = {x: definition.columns[x].kind for x, v in values.items() if definition.columns[x].is_encrypted and v is not None}
            new = {x: f"__new_{x}" for x in values}

            def change(df: DataFrame) -> DataFrame:
                names = df.columns
                df = df.join(chosen.withColumn("__hit", F.lit(True)), RID, "left")
                df = df.withColumns({new[x]: self._constant(table, x, v) for x, v in values.items()})
                if secret:
                    df = df.withColumns({f"__blind___new_{x}": F.lit(self.crypto.blind_index(table, x, values[x], k)) for x, k in secret.items()})
                    df = self.crypto.encrypted(df, {new[x]: k for x, k in secret.items()})
                return df.withColumns({x: F.when(F.col("__hit"), c(new[x])).otherwise(c(x)) for x in values}).select(*map(c, names))

            df = self._rewritten(table, chosen, change)
            self._unique_all(table, df)
            self._swap({table: df}, written=True)
        return n

    def _constant(self, table: str, column: str, value: Any) -> Column:
        from tessera.crypto import STRUCT, plain_json

        d = self.schema[table].columns[column]
        if not d.is_encrypted:
            return literal(value, d.kind)
        return F.lit(None).cast(STRUCT) if value is None else F.lit(plain_json(value, d.kind))

    def delete(self, table: str, where: Condition | Callable | None = None, allow_all: bool = False) -> int:
        """Deletes the chosen rows and what hangs on them; returns how many rows went in all tables."""
        planned: dict[str, DataFrame] = {}
        nulled: list[tuple[str, str, DataFrame]] = []

        def plan(name: str, ids: DataFrame) -> None:
            held = planned.get(name)
            fresh = ids.distinct() if held is None else ids.distinct().join(held, RID, "left_anti")
            fresh = self._write(fresh)
            if not fresh.limit(1).count():
                return
            planned[name] = fresh if held is None else self._write(held.unionAll(fresh))
            rows = self.frame(name).join(fresh, RID, "left_semi")
            for child, definition in self.schema.items():
                for fk in definition.foreign_keys.values():
                    if fk.target_table != name:
                        continue
                    keys = rows.select(c(fk.target_column).alias("__k"))
                    hanging = self.frame(child).join(keys, c(fk.column) == F.col("__k"), "left_semi").select(RID)
                    if fk.on_delete == "RESTRICT":
                        done = planned.get(child)
                        open_ = hanging if done is None else hanging.join(done, RID, "left_anti")
                        if open_.limit(1).count():
                            raise ConstraintError(f"rows of '{child}' refer to rows of '{name}' (ON DELETE RESTRICT)")
                    elif fk.on_delete == "CASCADE":
                        plan(child, hanging)
                    else:
                        nulled.append((child, fk.column, hanging))

        plan(table, self._chosen(table, where, allow_all))
        total = sum(ids.count() for ids in planned.values())
        gone = {name: (lambda df, ids=ids: df.join(ids, RID, "left_anti")) for name, ids in planned.items()}
        empty: dict[str, list[tuple[str, DataFrame]]] = {}
        for child, column, ids in nulled:
            empty.setdefault(child, []).append((column, self._write(ids.distinct())))
        new = {}
        for name in {**gone, **empty}:
            ids = reduce(DataFrame.unionAll, [*([planned[name]] if name in planned else []), *(x for _, x in empty.get(name, []))])

            def change(df: DataFrame, name: str = name) -> DataFrame:
                names = df.columns
                df = gone[name](df) if name in gone else df
                for column, hit in empty.get(name, []):
                    df = df.join(hit.withColumn("__hit", F.lit(True)), RID, "left")
                    df = df.withColumn(column, F.when(F.col("__hit").isNull(), c(column))).select(*map(c, names))
                return df

            new[name] = self._rewritten(name, ids, change)
        self._swap(new, written=True)
        return total
