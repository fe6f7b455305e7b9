"""Exceptions. Each also derives from the builtin whose meaning it has."""


class TesseraError(Exception):
    pass


class TesseraValueError(TesseraError, ValueError):
    pass


class TesseraTypeError(TesseraError, TypeError):
    pass


class TesseraLookupError(TesseraError, LookupError):
    pass


class TesseraKeyError(TesseraLookupError, KeyError):
    def __str__(self) -> str:
        return Exception.__str__(self)


class SchemaError(TesseraValueError):
    pass


class TableNotFoundError(TesseraKeyError, ValueError):
    pass


class ColumnNotFoundError(TesseraKeyError, ValueError):
    pass


class ConstraintError(TesseraValueError):
    pass


class QueryError(TesseraValueError):
    pass


class QueryTypeError(TesseraTypeError):
    pass


class ViewError(TesseraValueError):
    pass


class RowNotFoundError(TesseraLookupError):
    pass


class NoRowsFoundError(TesseraLookupError, ValueError):
    pass


class MultipleRowsFoundError(TesseraLookupError, ValueError):
    pass


class EncryptionError(TesseraError, ValueError):
    pass
