"""Relational models and queries on PySpark: typed tables with keys, a chainable query builder, validated changes."""

from tessera.catalog import AutoNumber, Database, ViewDef
from tessera.errors import (
    ColumnNotFoundError, ConstraintError, EncryptionError, MultipleRowsFoundError, NoRowsFoundError, QueryError, QueryTypeError,
    RowNotFoundError, SchemaError, TableNotFoundError, TesseraError, TesseraKeyError, TesseraLookupError, TesseraTypeError,
    TesseraValueError, ViewError,
)
from tessera.expr import AND, NOT, OR, ColumnRef, Condition, col
from tessera.grouping import AggregationSpec, GroupedQuery, avg, count, max_, min_, sum_
from tessera.indexes import IndexDef
from tessera.query import Query

__all__ = [
    "AND", "AggregationSpec", "AutoNumber", "ColumnNotFoundError", "ColumnRef", "Condition", "ConstraintError", "Database", "EncryptionError",
    "GroupedQuery", "IndexDef", "MultipleRowsFoundError", "NOT", "NoRowsFoundError", "OR", "Query", "QueryError", "QueryTypeError",
    "RowNotFoundError", "SchemaError", "TableNotFoundError", "TesseraError", "TesseraKeyError", "TesseraLookupError", "TesseraTypeError",
    "TesseraValueError", "ViewDef", "ViewError", "avg", "col", "count", "max_", "min_", "sum_",
]
