"""Encrypted columns: AES-CBC tokens with a MAC, and a keyed blind index for equality.

An encrypted value is stored as struct<algorithm, data_type, ciphertext, blind_index>. The ciphertext is a Fernet token
(version, time, IV, AES-128-CBC, HMAC-SHA256), made and opened by Spark's own functions. Keys come in as scalar
subqueries on a one-row table, so they do not show in plans.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import EncryptionError
from tessera.relation import c
from tessera.types import SPARK, from_storage

ALGORITHM = "fernet-aes128-cbc-hmac-sha256"
STRUCT = "struct<algorithm:string,data_type:string,ciphertext:string,blind_index:string>"
BLIND_PREFIX = b"tessera-blind-index-v1:"


def generate_encryption_key() -> str:
    return base64.urlsafe_b64encode(os.urandom(32)).decode()


def plain_json(value: Any, kind: type) -> str:
    """A value and its type as sorted, compact JSON."""
    held = {"type": "bytes", "value": base64.b64encode(value).decode()} if isinstance(value, bytes) else {"type": kind.__name__, "value": value}
    try:
        return json.dumps(held, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    except TypeError as e:
        raise EncryptionError(f"{kind.__name__} values cannot be encrypted") from e


def _blind(key: bytes, table: str, column: str, text: str) -> str:
    scoped = json.dumps({"table": table, "column": column, "value": text}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hmac.new(key, scoped.encode(), hashlib.sha256).hexdigest()


def _maker(key: bytes, table: str, column: str, kind: type) -> Callable[[pa.Array], pa.Array]:
    def made(values: pa.Array) -> pa.Array:
        texts = [None if v is None else plain_json(from_storage(v, kind), kind) for v in values.to_pylist()]
        blind = [None if t is None else _blind(key, table, column, t) for t in texts]
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(blind, pa.string())], ["text", "blind"])

    made.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return made


def _mac(message: Column, ipad: Column, opad: Column) -> Column:
    """HMAC-SHA256 (binary) from SHA-256, for a key of one block given as its two pads."""
    inner = F.unhex(F.sha2(F.concat(ipad, message), 256))
    return F.unhex(F.sha2(F.concat(opad, inner), 256))


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = key.ljust(64, b"\0")
    return bytes(x ^ 0x36 for x in block), bytes(x ^ 0x5C for x in block)


class Crypto:
    def __init__(self, spark: Any):
        self.spark = spark
        self._key: bytes | None = None

    def set_key(self, key: str | bytes) -> None:
        try:
            raw = base64.urlsafe_b64decode(key)
        except (ValueError, TypeError) as e:
            raise EncryptionError("the encryption key is not base64") from e
        if len(raw) != 32:
            raise EncryptionError("the encryption key must have 32 bytes")
        self._key = raw

    def has_key(self) -> bool:
        return self._key is not None

    def require(self) -> bytes:
        if self._key is None:
            raise EncryptionError("an encryption key is needed; call set_encryption_key()")
        return self._key

    def blind_index(self, table: str, column: str, value: Any, kind: type) -> str:
        key = hashlib.sha256(BLIND_PREFIX + self.require()).digest()
        return _blind(key, table, column, plain_json(value, kind))

    def _keys(self) -> tuple[Column, Column, Column]:
        """AES key and the two pads of the MAC key, as scalar subqueries."""
        key = self.require()
        keys = self.spark.createDataFrame([(key[16:], *_pads(key[:16]))], "aes binary, ipad binary, opad binary")
        return tuple(keys.select(n).scalar() for n in keys.columns)

    def encrypted(self, df: DataFrame, plain: dict[str, type]) -> DataFrame:
        """df with the struct in place of each column; it reads x as plain_json() text and __blind_x."""
        if not plain:
            return df
        names = [n for n in df.columns if not n.startswith("__blind_")]
        aes, ipad, opad = self._keys()
        stamp = F.unhex(F.lit(f"80{int(time.time()):016x}"))
        for n, kind in plain.items():
            # the IV: a keyed hash of a fresh UUID, so it can't be foreseen without the key
            df = df.withColumn(f"__iv_{n}", F.substring(_mac(F.concat(F.lit(f"iv:{n}:"), F.uuid()).cast("binary"), ipad, opad), 1, 16))
            head = F.concat(stamp, F.aes_encrypt(c(n).cast("binary"), aes, F.lit("CBC"), F.lit("PKCS"), F.col(f"__iv_{n}")))
            df = df.withColumn(f"__head_{n}", head)
            token = F.translate(F.base64(F.concat(f"__head_{n}", _mac(F.col(f"__head_{n}"), ipad, opad))), "+/", "-_")
            made = F.struct(F.lit(ALGORITHM).alias("algorithm"), F.lit(kind.__name__).alias("data_type"), token.alias("ciphertext"), F.col(f"__blind_{n}").alias("blind_index"))
            df = df.withColumn(n, F.when(c(n).isNotNull(), made))
        return df.select(*map(c, names))

    def prepared(self, df: DataFrame, table: str, plain: dict[str, type]) -> DataFrame:
        """df as encrypted() reads it: each column as plain_json() text, and __blind_x, made in Arrow batches."""
        key = hashlib.sha256(BLIND_PREFIX + self.require()).digest()
        for n, kind in plain.items():
            made = F.arrow_udf(_maker(key, table, n, kind), "struct<text:string,blind:string>")
            df = df.withColumn(f"__made_{n}", made(c(n))).withColumns({n: F.col(f"__made_{n}")["text"], f"__blind_{n}": F.col(f"__made_{n}")["blind"]}).drop(f"__made_{n}")
        return df

    def decrypted(self, df: DataFrame, source: str, target: str, kind: type) -> DataFrame:
        """df with the plain value of the encrypted column `source` as `target`; a wrong key raises."""
        names = list(dict.fromkeys([*df.columns, target]))
        aes, ipad, opad = self._keys()
        raw = F.unbase64(F.translate(c(source)["ciphertext"], "-_", "+/"))
        df = df.withColumn("__raw", raw)
        size = F.length("__raw")
        body = lambda a, n: F.substring(F.col("__raw"), a, n)
        fine = _mac(body(F.lit(1), size - 32), ipad, opad) == body(size - 31, F.lit(32))
        opened = F.aes_decrypt(body(F.lit(10), size - 41), aes, F.lit("CBC"), F.lit("PKCS")).cast("string")
        text = F.when(fine, opened).otherwise(F.raise_error(F.lit("EncryptionError: the key does not open this value")))
        value = F.get_json_object(text, "$.value")
        if kind is bytes:
            value = F.unbase64(value)
        elif kind not in (str, dict, list):
            value = value.cast(SPARK[kind])
        return df.withColumn(target, F.when(c(source).isNotNull(), value)).select(*map(c, names))
