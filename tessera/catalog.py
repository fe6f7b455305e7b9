"""The database: table definitions, their snapshots, views, and entry points for queries."""

from __future__ import annotations

import copy
import datetime as dt
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.crypto import STRUCT, Crypto, generate_encryption_key, plain_json
from tessera.errors import ColumnNotFoundError, ConstraintError, SchemaError, TableNotFoundError, TesseraTypeError, ViewError
from tessera.export import ExportMixin
from tessera.grouping import GroupedQuery
from tessera.indexes import IndexDef, IndexMixin
from tessera.mutate import MutateMixin
from tessera.persist import PersistMixin
from tessera.query import Query
from tessera.relation import DEEP, RID, c
from tessera.types import AutoNumber, check, literal, python_type, spark_type, to_storage

NOT_SET = object()
MOST_FILES = 10_000
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
ON_DELETE = ("RESTRICT", "CASCADE", "SET NULL")


@dataclass
class ColumnDef:
    name: str
    kind: type
    nullable: bool = True
    default: Any = NOT_SET
    is_primary_key: bool = False
    is_pii: bool = False
    is_encrypted: bool = False

    @property
    def has_default(self) -> bool:
        return self.default is not NOT_SET

    @property
    def storage(self) -> type:
        return int if self.kind is AutoNumber else self.kind


@dataclass
class ForeignKey:
    column: str
    target_table: str
    target_column: str
    on_delete: str = "RESTRICT"


@dataclass
class TableDef:
    name: str
    columns: dict[str, ColumnDef] = field(default_factory=dict)
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: dict[str, ForeignKey] = field(default_factory=dict)
    auto_sequences: dict[str, int] = field(default_factory=dict)
    registered: bool = False  # a DataFrame of the user's: read only, without row ids


@dataclass
class State:
    """A table's rows: a written snapshot (base) and rows that wait on the driver."""

    base: DataFrame | None = None
    rows: list[dict[str, Any]] = field(default_factory=list)
    next_rid: int = 1
    frame: tuple[Any, list, DataFrame] | None = None  # the waiting rows as a frame, for these rows and columns
    known: dict[tuple[str, ...], tuple[Any, int, set]] = field(default_factory=dict)  # keys of waiting rows, by columns

    def waiting_keys(self, columns: tuple[str, ...]) -> set:
        """Keys of the rows that wait; those that were seen before are not looked at again."""
        first = self.rows[0] if self.rows else None
        of, seen, keys = self.known.get(columns, (None, 0, set()))
        if of is not first or seen > len(self.rows):
            seen, keys = 0, set()
        keys.update(tuple(r[n] for n in columns) for r in self.rows[seen:])
        self.known[columns] = first, len(self.rows), keys
        return keys


@dataclass(frozen=True)
class ViewDef:
    name: str
    builder: Callable[[Any], Any]
    description: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[[^,\]]*(,[^\]]*)?\])?$", spark.sparkContext.master):
        raise SchemaError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tessera"


class Database(MutateMixin, IndexMixin, PersistMixin, ExportMixin):
    generate_encryption_key = staticmethod(generate_encryption_key)

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.schema: dict[str, TableDef] = {}
        self.state: dict[str, State] = {}
        self.views: dict[str, ViewDef] = {}
        self.indexes: dict[str, IndexDef] = {}
        self.copies: dict[str, DataFrame] = {}  # of indexes
        self.written: list[str] = []
        self.crypto = Crypto(self.spark)

    # keys for encrypted columns

    def set_encryption_key(self, key: str | bytes) -> None:
        self.crypto.set_key(key)

    def has_encryption_key(self) -> bool:
        return self.crypto.has_key()

    # names

    def _name(self, name: Any, what: str) -> None:
        if not isinstance(name, str):
            raise TesseraTypeError(f"{what} name must be a string")
        if not _NAME.match(name):
            raise SchemaError(f"{what} name '{name}' is not valid")
        if name == RID:
            raise SchemaError(f"'{RID}' is reserved")

    def _table(self, name: Any) -> TableDef:
        if not isinstance(name, str) or name not in self.schema:
            raise TableNotFoundError(f"table '{name}' does not exist")
        return self.schema[name]

    def _free(self, name: str) -> None:
        if name in self.schema or name in self.views:
            raise SchemaError(f"'{name}' already exists")

    # schema

    def create_table(self, table_name: str) -> None:
        self._name(table_name, "Table")
        self._free(table_name)
        self.schema[table_name] = TableDef(table_name)
        self.state[table_name] = State()

    def register_table(self, name: str, df: DataFrame, primary_key: str | list[str] = (), foreign_keys: dict[str, str] | None = None) -> None:
        """A DataFrame (Parquet, CSV, JDBC...) as a read-only table; keys are declared, not checked."""
        self._name(name, "Table")
        self._free(name)
        pk = [primary_key] if isinstance(primary_key, str) else list(primary_key)
        for n in [*pk, *(foreign_keys or {})]:
            if n not in df.columns:
                raise ColumnNotFoundError(f"column '{n}' does not exist in '{name}'")
        columns = {f.name: ColumnDef(f.name, python_type(f.dataType), f.name not in pk, is_primary_key=f.name in pk) for f in df.schema}
        self.schema[name] = TableDef(name, columns, pk, registered=True)
        self.state[name] = State(base=df)
        for column, target in (foreign_keys or {}).items():
            table, target_column = self._reference(target)
            self.schema[name].foreign_keys[column] = ForeignKey(column, table, target_column)

    def _reference(self, text: str) -> tuple[str, str]:
        if not isinstance(text, str) or text.count(".") != 1:
            raise SchemaError("a reference is written table.column")
        table, column = (x.strip() for x in text.split("."))
        definition = self._table(table)
        if column not in definition.columns:
            raise ColumnNotFoundError(f"column '{column}' does not exist in table '{table}'")
        if definition.primary_key != [column]:
            raise SchemaError(f"{table}.{column} is not the whole primary key of '{table}'")
        return table, column

    def add_column(
        self, table_name: str, column_name: str, data_type: type, is_primary_key: bool = False, is_pii: bool = False, is_encrypted: bool = False,
        references: str | None = None, on_delete: str | None = None, nullable: bool | None = None, default: Any = NOT_SET,
    ) -> None:
        table = self._table(table_name)
        self._name(column_name, "Column")
        if column_name in table.columns:
            raise SchemaError(f"column '{column_name}' already exists in table '{table_name}'")
        for what, x in (("is_primary_key", is_primary_key), ("is_pii", is_pii), ("is_encrypted", is_encrypted)):
            if type(x) is not bool:
                raise TesseraTypeError(f"{what} must be a bool")
        if nullable is not None and type(nullable) is not bool:
            raise TesseraTypeError("nullable must be a bool")
        spark_type(data_type)
        auto = data_type is AutoNumber
        full = self._row_count(table_name) > 0
        if is_encrypted and (is_primary_key or references is not None):
            raise SchemaError("an encrypted column cannot be a key")
        if is_primary_key and nullable:
            raise SchemaError("a primary key cannot be nullable")
        if auto and (not is_primary_key or references is not None or default is not NOT_SET):
            raise SchemaError("an AutoNumber column is a primary key without reference and default")
        if is_primary_key and table.primary_key:
            raise SchemaError(f"table '{table_name}' has a primary key; use set_primary_key() for several columns")
        if full and (auto or is_primary_key):
            raise SchemaError("a primary key cannot be added to a table that holds rows")
        can_null = not is_primary_key if nullable is None else nullable
        if default is not NOT_SET:
            if default is None and not can_null:
                raise SchemaError("a column that cannot be null has no null default")
            check(default, data_type, "default")
            default = copy.deepcopy(default)
        if full and not can_null and default is NOT_SET:
            raise SchemaError("a column that cannot be null needs a default where rows exist")
        fk = None
        if on_delete is not None and references is None:
            raise SchemaError("on_delete needs references")
        if references is not None:
            action = "RESTRICT" if on_delete is None else " ".join(str(on_delete).upper().replace("_", " ").split())
            if action not in ON_DELETE:
                raise SchemaError(f"on_delete must be one of {', '.join(ON_DELETE)}")
            target, target_column = self._reference(references)
            if self.schema[target].columns[target_column].storage is not (int if auto else data_type):
                raise SchemaError(f"'{column_name}' and {references} differ in type")
            if action == "SET NULL" and not can_null:
                raise SchemaError("ON DELETE SET NULL needs a nullable column")
            fk = ForeignKey(column_name, target, target_column, action)
            if full and default is not NOT_SET and default is not None and not self._keys_exist(target, [target_column], {(default,)}):
                raise ConstraintError(f"the default of '{column_name}' has no row in '{target}'")
        definition = ColumnDef(column_name, data_type, can_null, default, is_primary_key, is_pii, is_encrypted)
        fill = None if default is NOT_SET else default
        state = self.state[table_name]
        base = state.base
        if base is not None:
            if is_encrypted and fill is not None:
                blind = F.lit(self.crypto.blind_index(table_name, column_name, fill, data_type))
                base = base.withColumns({column_name: F.lit(plain_json(fill, data_type)), f"__blind_{column_name}": blind})
                base = self._write(self.crypto.encrypted(base, {column_name: data_type}))
            else:
                base = base.withColumn(column_name, F.lit(None).cast(STRUCT) if is_encrypted else literal(fill, data_type))
        state.base = base
        self._build_all(table_name)
        state.rows = [{**r, column_name: copy.deepcopy(fill)} for r in state.rows]
        table.columns[column_name] = definition
        if is_primary_key:
            table.primary_key = [column_name]
        if auto:
            table.auto_sequences[column_name] = 0
        if fk:
            table.foreign_keys[column_name] = fk

    def set_primary_key(self, table_name: str, columns: list[str], replace: bool = False) -> None:
        table = self._table(table_name)
        if not isinstance(columns, list) or not columns or len(set(columns)) != len(columns):
            raise SchemaError("a primary key is a list of different columns")
        for n in columns:
            if n not in table.columns:
                raise ColumnNotFoundError(f"column '{n}' does not exist in table '{table_name}'")
            if table.columns[n].is_encrypted:
                raise SchemaError("an encrypted column cannot be a key")
            if table.columns[n].nullable:
                raise SchemaError(f"column '{n}' can be null and so cannot be a key")
        if table.primary_key and not replace:
            raise SchemaError(f"table '{table_name}' has a primary key; give replace=True")
        if table.primary_key != columns and any(fk.target_table == table_name for t in self.schema.values() for fk in t.foreign_keys.values()):
            raise SchemaError(f"other tables refer to the primary key of '{table_name}'")
        if any(d.kind is AutoNumber and n not in columns for n, d in table.columns.items()):
            raise SchemaError("an AutoNumber column must stay a primary key")
        df = self.frame(table_name)
        if df.groupBy(*map(c, columns)).count().where("count > 1").limit(1).count():
            raise ConstraintError(f"the rows of '{table_name}' are not unique by {', '.join(columns)}")
        table.primary_key = list(columns)
        for n, d in table.columns.items():
            d.is_primary_key = n in columns

    # rows

    def _stored_type(self, d: ColumnDef) -> Any:
        return STRUCT if d.is_encrypted else spark_type(d.kind)

    def _given(self, rows: list[dict[str, Any]], kinds: dict[str, type]) -> DataFrame:
        """Rows as a local relation, which the optimizer knows to be small."""
        schema = T.StructType([T.StructField(n, spark_type(k)) for n, k in kinds.items()])
        arrow = to_arrow_schema(schema)
        columns = [pa.array([to_storage(r[n], k) for r in rows], arrow.field(n).type) for n, k in kinds.items()]
        return self.spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), schema)

    def _waiting(self, table: str) -> DataFrame:
        """The buffered rows as a DataFrame like the snapshot, made once for the same rows."""
        state, columns = self.state[table], self.schema[table].columns
        key = (id(state.rows), len(state.rows), tuple(columns.items()))
        if state.frame is None or state.frame[0] != key or state.frame[1] is not state.rows:
            state.frame = key, state.rows, self._made(table)
        return state.frame[2]

    def _made(self, table: str) -> DataFrame:
        columns, rows = self.schema[table].columns, self.state[table].rows
        secret = {n: d.kind for n, d in columns.items() if d.is_encrypted}
        kinds = {n: str if n in secret else d.kind for n, d in columns.items()} | {RID: int} | {f"__blind_{n}": str for n in secret}
        given = []
        for r in rows:
            x = dict(r)
            for n, kind in secret.items():
                v = x[n]
                x[f"__blind_{n}"] = None if v is None else self.crypto.blind_index(table, n, v, kind)
                x[n] = None if v is None else plain_json(v, kind)
            given.append(x)
        df = self._given(given, kinds)
        if not secret:
            return df
        return self.crypto.encrypted(df, secret) if any(r[n] is not None for r in rows for n in secret) else df.select(
            *[F.lit(None).cast(STRUCT).alias(n) if n in secret else c(n) for n in [*columns, RID]])

    def frame(self, table: str) -> DataFrame:
        """All rows as they are stored, with __rid (except for registered tables)."""
        definition, state = self._table(table), self.state[table]
        if definition.registered:
            return state.base
        if state.rows and any(d.is_encrypted for d in definition.columns.values()):
            self._swap({table: self._joined(table)})  # tokens are made once
        return self._joined(table)

    def _joined(self, table: str) -> DataFrame:
        state = self.state[table]
        if state.base is None or state.rows:
            now = self._waiting(table)
            return now if state.base is None else state.base.unionByName(now)
        return state.base

    def shared_dir(self) -> str:
        return shared_dir(self.spark)

    def _write(self, df: DataFrame) -> DataFrame:
        """df written to the shared folder and read back: fixed rows, short lineage."""
        path = f"{self.shared_dir()}/rows-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.written.append(path)
        found = self._hadoop(path)
        files = [str(x.getPath()) for x in found.listStatus(self._path(path)) if x.getPath().getName().endswith(".parquet")]
        if not 0 < len(files) <= MOST_FILES:  # a table of more files is read, and rewritten, as a whole
            return self.spark.read.schema(df.schema).parquet(path)
        return self._read(files, df.schema)

    def _read(self, files: list[str], schema: T.StructType) -> DataFrame:
        df = self.spark.read.schema(schema).parquet(*files)
        df._tessera_files = files  # a change writes those files anew that hold changed rows, and no others
        return df

    def _slice(self, df: DataFrame, start: int, count: int | None) -> DataFrame:
        """Rows start to start + count of an ordered df, without gathering those before them in one task.

        df is written once, each row with its place: its partition's number in the upper bits, which follows df's order, and its
        number in the partition in the lower 33. The partitions' sizes then give the range of places that is asked for. Of a short
        slice only its own rows stay written.
        """
        names = df.columns
        made = [f"c{i}" for i in range(len(names))]  # any name may be a result's, but not a file's
        found = self._write(df.toDF(*made).select(*made, F.monotonically_increasing_id().alias("place")))
        whole = self.written[-1]
        sizes = sorted(found.groupBy(F.shiftright("place", 33)).count().collect())
        total = sum(n for _, n in sizes)
        end = total if count is None else min(total, start + count)

        def place(row: int) -> int:
            for part, n in sizes:
                if row < n:
                    return (part << 33) + row
                row -= n
            return (sizes[-1][0] + 1) << 33 if sizes else 0

        found = found.where((F.col("place") >= place(start)) & (F.col("place") < place(end)))
        if end - start <= DEEP:
            found = self._write(found)
            self._hadoop(whole).delete(self._path(whole), True)
            self.written.remove(whole)
        return found.orderBy("place").select(*made).toDF(*names)

    def _path(self, path: str) -> Any:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _hadoop(self, path: str) -> Any:
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def vacuum(self) -> int:
        """Deletes what this database wrote and its tables and indexes no longer read; frames handed out before lose their
        files. Returns the number of folders."""
        held = [df for df in [*(s.base for s in self.state.values()), *self.copies.values()] if df is not None]
        used = {f.rsplit("/", 2)[-2] for df in held for f in df.inputFiles()}
        gone = [p for p in self.written if p.rsplit("/", 1)[-1] not in used]
        for p in gone:
            self._hadoop(p).delete(self._path(p), True)
        self.written = [p for p in self.written if p not in gone]
        return len(gone)

    def _rewritten(self, table: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The next snapshot, in which `change` holds for the rows of ids: of the files only those that hold such rows are
        written anew, with the rows that still wait."""
        base, rows = self.state[table].base, self.state[table].rows
        files = getattr(base, "_tessera_files", None)
        if files is None:
            return self._write(self._clustered(table, change(self.frame(table))))
        here = base.select(RID, F.input_file_name().alias("__file")).join(ids, RID, "left_semi").select("__file").distinct()
        names = {r[0].rsplit("/", 2)[-2:][0] + "/" + r[0].rsplit("/", 1)[-1] for r in here.collect()}  # no more than there are files
        touched = [f for f in files if "/".join(f.rsplit("/", 2)[-2:]) in names]
        if not touched and not rows:
            return base
        part = self._read(touched, base.schema) if touched else base.limit(0)
        new = self._write(self._clustered(table, change(part.unionByName(self._waiting(table)) if rows else part)))
        kept, gone = getattr(new, "_tessera_files", None), set(touched)
        left = [f for f in files if f not in gone]
        return self._read(left + kept, base.schema) if kept else self._read(left, base.schema).unionByName(new) if left else new

    def _swap(self, new: dict[str, DataFrame], written: bool = False) -> None:
        """The next snapshots take effect together."""
        for name in new:
            if self.schema[name].registered:
                raise SchemaError(f"'{name}' is a registered table and read only")
        done = new if written else {n: self._write(self._clustered(n, df)) for n, df in new.items()}
        for name, df in done.items():
            self.state[name].base, self.state[name].rows = df, []
            self._build_all(name)

    def _append(self, table: str, new: DataFrame) -> None:
        """Written rows join the snapshot as more files."""
        base = self.state[table].base
        files = getattr(base, "_tessera_files", None), getattr(new, "_tessera_files", None)
        if self.state[table].rows or None in files or len(files[0]) + len(files[1]) > MOST_FILES:
            self._swap({table: self.frame(table).unionByName(new)})
        else:
            self._swap({table: self._read(files[0] + files[1], base.schema)}, written=True)

    def _clustered(self, table: str, df: DataFrame) -> DataFrame:
        """df dealt and sorted by the primary key, so that a lookup reads the one file and row group whose range holds it."""
        keys = [c(n) for n in self.schema[table].primary_key if not self.schema[table].columns[n].is_encrypted]
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df

    def _row_count(self, table: str) -> int:
        state = self.state[table]
        return len(state.rows) + (state.base.count() if state.base is not None else 0)

    # queries and views

    def query(self, table_name: str) -> Query:
        self._table(table_name)
        return Query(self, table_name, table=table_name)

    def from_rows(self, name: str, rows: list[dict[str, Any]], columns: list[str]) -> Query:
        return Query.from_rows(self, name, rows, columns)

    def create_view(self, view_name: str, query_builder: Callable[[Any], Any], description: str | None = None) -> None:
        self._name(view_name, "View")
        self._free(view_name)
        if not callable(query_builder):
            raise TesseraTypeError("a view is built by a callable")
        if not isinstance(query_builder(self), (Query, GroupedQuery)):
            raise ViewError("a view's builder must return a query")
        self.views[view_name] = ViewDef(view_name, query_builder, description)

    def _view(self, name: str) -> ViewDef:
        if name not in self.views:
            raise ViewError(f"view '{name}' does not exist")
        return self.views[name]

    def view(self, view_name: str) -> Query:
        """The view's rows now; encrypted columns are masked."""
        return Query.from_df(self, view_name, self._view(view_name).builder(self).to_df())

    def drop_view(self, view_name: str) -> None:
        del self.views[self._view(view_name).name]

    def list_views(self) -> list[str]:
        return list(self.views)

    def describe_view(self, view_name: str) -> dict[str, Any]:
        v, q = self._view(view_name), self.view(view_name)
        return {"name": v.name, "description": v.description, "columns": q.result_columns(), "row_count": q.count()}

    def describe_views(self) -> dict[str, dict[str, Any]]:
        return {n: self.describe_view(n) for n in self.views}

    # description

    def describe_table(self, table_name: str) -> dict[str, Any]:
        t = self._table(table_name)
        return {  # fixed values: callers read these keys
            "name": t.name,
            "columns": {
                n: {
                    "type": d.kind.__name__, "storage_type": d.storage.__name__, "nullable": d.nullable, "has_default": d.has_default,
                    "default": d.default if d.has_default else "<DEFAULT_NOT_SET>", "is_primary_key": d.is_primary_key, "is_pii": d.is_pii,
                    "is_encrypted": d.is_encrypted, "is_auto_number": d.kind is AutoNumber,
                }
                for n, d in t.columns.items()
            },
            "primary_key": list(t.primary_key),
            "foreign_keys": {n: {"local_column": n, "target_table": f.target_table, "target_column": f.target_column, "on_delete": f.on_delete} for n, f in t.foreign_keys.items()},
            "auto_sequences": dict(t.auto_sequences),
            "row_count": self._row_count(table_name),
        }

    def describe_schema(self) -> dict[str, Any]:
        return {n: self.describe_table(n) for n in self.schema}


__all__ = ["AutoNumber", "ColumnDef", "Database", "ForeignKey", "TableDef", "ViewDef", "dt"]
