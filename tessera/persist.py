"""Saving and loading.

`save` writes a folder: manifest.json and one Parquet folder for each table. The tables of a save lie in a folder of their
own and the manifest is written last, so a save that breaks off leaves the one before readable. `save_json`/`load_json`
keep a small database in a single JSON file (format version 1: schema, data, indexes, next row ids; typed values wrapped).
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
import uuid
from typing import Any

from pyspark.sql import SparkSession

from tessera.errors import SchemaError, ViewError
from tessera.relation import RID
from tessera.types import NAMES, AutoNumber, from_storage

VERSION = 1
_WRAP = "__tessera_encoded__"
_ANY_WRAP, _ANY_RID = re.compile(r"__\w+_encoded__\Z"), re.compile(r"__\w+_row_id__\Z")


def wrapped(value: Any) -> Any:
    kinds = {bytes: lambda v: base64.b64encode(v).decode(), dt.datetime: lambda v: v.isoformat(), dt.date: lambda v: v.isoformat(), dt.time: lambda v: v.isoformat()}
    if type(value) in kinds:
        return {_WRAP: True, "type": type(value).__name__, "value": kinds[type(value)](value)}
    if isinstance(value, dict):
        return {k: wrapped(v) for k, v in value.items()}
    return [wrapped(v) for v in value] if isinstance(value, list) else value


def unwrapped(value: Any) -> Any:
    if isinstance(value, dict):
        if any(_ANY_WRAP.match(k) and v is True for k, v in value.items()) and {"type", "value"} <= set(value):
            kinds = {"bytes": base64.b64decode, "datetime": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "time": dt.time.fromisoformat}
            return kinds[value["type"]](value["value"])
        return {k: unwrapped(v) for k, v in value.items()}
    return [unwrapped(v) for v in value] if isinstance(value, list) else value


class PersistMixin:
    def _schema_payload(self) -> dict[str, Any]:
        return {
            t.name: {
                "name": t.name,
                "columns": {
                    n: {
                        "name": n, "data_type": d.kind.__name__, "storage_type": d.storage.__name__, "nullable": d.nullable, "has_default": d.has_default,
                        "default": wrapped(d.default) if d.has_default else None, "is_primary_key": d.is_primary_key, "is_pii": d.is_pii, "is_encrypted": d.is_encrypted,
                    }
                    for n, d in t.columns.items()
                },
                "primary_key": list(t.primary_key),
                "foreign_keys": {n: {"local_column": n, "target_table": f.target_table, "target_column": f.target_column, "on_delete": f.on_delete} for n, f in t.foreign_keys.items()},
                "auto_sequences": dict(t.auto_sequences),
            }
            for t in self.schema.values()
        }

    def _payload(self) -> dict[str, Any]:
        if self.views:
            raise ViewError("views are Python functions and cannot be saved; drop them first")
        return {
            "format": "tessera", "format_version": VERSION, "schema": self._schema_payload(),
            "indexes": {n: {"name": n, "table_name": i.table_name, "columns": list(i.columns), "unique": i.unique, "nulls_distinct": i.nulls_distinct} for n, i in self.indexes.items()},
            "internal": {"next_row_id": {n: s.next_rid for n, s in self.state.items()}},
        }

    def _put(self, path: str, text: str) -> None:
        """Writes a small file through Spark's file system."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def save(self, path: str) -> None:
        payload, version = self._payload(), uuid.uuid4().hex
        payload["data"] = {}
        for n in self.schema:
            payload["data"][n] = f"{version}/{n}"
            self.frame(n).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{version}/{n}")
        self._put(f"{path.rstrip('/')}/manifest.json", json.dumps(payload, indent=2, ensure_ascii=False))

    def save_json(self, path: str) -> None:
        payload = self._payload()
        payload["data"] = {}
        for n, t in self.schema.items():
            rows = self.frame(n).orderBy(RID).collect()
            payload["data"][n] = [
                {"__tessera_row_id__": r[RID]} | {k: r[k].asDict() if d.is_encrypted and r[k] is not None else wrapped(from_storage(r[k], d.kind)) for k, d in t.columns.items()} for r in rows
            ]
        self._put(path, json.dumps(payload, indent=2, ensure_ascii=False))

    @classmethod
    def _empty(cls, spark: SparkSession | None, payload: dict[str, Any], key: str | None) -> Any:
        from tessera.catalog import NOT_SET, ColumnDef, ForeignKey, State, TableDef

        if payload.get("format_version") != VERSION or not {"format", "schema", "data"} <= set(payload):
            raise SchemaError("not a saved database of format version 1")
        db = cls(spark)
        if key is not None:
            db.set_encryption_key(key)
        for name, t in payload["schema"].items():
            columns = {}
            for n, d in t["columns"].items():
                kind = NAMES.get(d["data_type"])
                if kind is None:
                    raise SchemaError(f"type '{d['data_type']}' is not supported")
                columns[n] = ColumnDef(n, kind, d["nullable"], unwrapped(d["default"]) if d["has_default"] else NOT_SET, d["is_primary_key"], d["is_pii"], d["is_encrypted"])
            fks = {n: ForeignKey(n, f["target_table"], f["target_column"], f["on_delete"]) for n, f in t["foreign_keys"].items()}
            db.schema[name] = TableDef(name, columns, list(t["primary_key"]), fks, {k: int(v) for k, v in t["auto_sequences"].items()})
            db.state[name] = State(next_rid=int(payload.get("internal", {}).get("next_row_id", {}).get(name, 1)))
        return db

    def _load_indexes(self, payload: dict[str, Any]) -> None:
        for n, i in payload.get("indexes", {}).items():
            self.create_index(i["table_name"], list(i["columns"]), n, i.get("unique", False), i.get("nulls_distinct", True))

    @classmethod
    def load(cls, path: str, *, encryption_key: str | None = None, spark: SparkSession | None = None) -> Any:
        spark = spark or SparkSession.builder.getOrCreate()
        text = "\n".join(r[0] for r in spark.read.text(f"{path.rstrip('/')}/manifest.json", wholetext=True).collect())
        payload = json.loads(text)
        db = cls._empty(spark, payload, encryption_key)
        for n, at in payload["data"].items():
            df = spark.read.parquet(f"{path.rstrip('/')}/{at}")
            db.state[n].base = df
            db.schema[n].registered = RID not in df.columns
        db._load_indexes(payload)
        return db

    @classmethod
    def load_json(cls, path: str, *, encryption_key: str | None = None, spark: SparkSession | None = None) -> Any:
        """A single-file database of format version 1."""
        spark = spark or SparkSession.builder.getOrCreate()
        payload = json.loads(spark.read.text(path, wholetext=True).first()[0])
        db = cls._empty(spark, payload, encryption_key)
        from tessera.crypto import STRUCT

        for n, rows in payload["data"].items():
            columns, state = db.schema[n].columns, db.state[n]
            secret = [k for k, d in columns.items() if d.is_encrypted]
            given = []
            for i, r in enumerate(rows):
                rid = next((v for k, v in r.items() if _ANY_RID.match(k)), i + 1)
                given.append({k: json.dumps(r.get(k)) if k in secret and r.get(k) is not None else unwrapped(r.get(k)) for k in columns} | {RID: rid})
            kinds = {k: str if k in secret else d.kind for k, d in columns.items()} | {RID: int}
            df = db._given(given, kinds)
            if secret:
                from pyspark.sql import functions as F

                df = df.withColumns({k: F.from_json(k, STRUCT) for k in secret})
            state.base = db._write(df)
            state.next_rid = max(state.next_rid, 1 + max((g[RID] for g in given), default=0))
        db._load_indexes(payload)
        return db


__all__ = ["AutoNumber", "PersistMixin", "unwrapped", "wrapped"]
