"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import shared_dir

#: The six ASCII white-space characters, as a plain string (for trim and translate).
WS_CHARS = " \t\n\x0b\x0c\r"
#: The same as a regular-expression class body.
WS_CLASS = "\\x20\\x09-\\x0D"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage and survives lost executors.

    Spark drops the shuffle files of this write when it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    for made in _OPEN:
        made.tables.append(out)
    return out


class scratch:  # noqa: N801
    """`with scratch() as made:` deletes, at its end, the tables that were materialised in it, but for those kept.

    For steps whose result is itself materialised: what a lazy result still reads must be kept.
    """

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables = [t for t in self.tables if t is not df]
        return df

    def __enter__(self) -> scratch:
        _OPEN.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _OPEN.remove(self)
        for t in self.tables:
            discard(t.sparkSession, t)


_OPEN: list[scratch] = []


def discard(spark: SparkSession, written: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more (other frames are left alone)."""
    path = getattr(written, "_tessera_path", None)
    if path:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released() -> None:
    """Gives a Python worker's free memory back to the system: workers stay alive between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as `_row` and the given columns beside it, so that no name of docs can clash with a working name."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def unboxed(df: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `_row`, some of them with new values."""
    names = df.schema["_row"].dataType.names
    return df.select(*[(changed[n] if n in changed else F.col("_row").getField(n)).alias(n) for n in names])


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space characters, in order."""
    return F.array_remove(F.split(text, f"[{WS_CLASS}]+"), "")  # only the ends can be empty
