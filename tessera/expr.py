"""Conditions: a small tree that becomes a Spark column.

Conditions are two-valued: a comparison with a missing value is false, and its negation true. They are compiled in
negation normal form: NOT is pushed to the leaves, and a negated leaf is its inverse or "is null". Leaves in positive
place may yield NULL, which WHERE, AND and OR treat like false there; so filters still reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import QueryError, QueryTypeError


@dataclass(frozen=True)
class Operand:
    """A column as conditions see it. blind: for encrypted columns, the column to compare and the value's index."""

    column: Column
    kind: type
    blind: tuple[Column, Callable[[Any], str]] | None = None


class Condition:
    def columns(self) -> set[str]:
        return {leaf.name for leaf in self.leaves()}

    def leaves(self) -> Iterator[Leaf]:
        raise NotImplementedError

    def facts(self) -> set[str]:
        """Columns that equal one of some given values in every row that fits: what an index can be asked for."""
        return set()

    def compile(self, env: Callable[[str], Operand], negated: bool = False) -> Column:
        raise NotImplementedError

    def __and__(self, other: Condition) -> Condition:
        return All((self, _condition(other)))

    def __or__(self, other: Condition) -> Condition:
        return Any_((self, _condition(other)))

    def __invert__(self) -> Condition:
        return Not(self)

    def __bool__(self) -> bool:
        raise QueryTypeError("conditions are combined with &, | and ~ or AND, OR and NOT, not with and, or, not")


def _condition(x: Any) -> Condition:
    if not isinstance(x, Condition):
        raise QueryTypeError(f"expected a condition, got {type(x).__name__}")
    return x


@dataclass(frozen=True)
class _Many(Condition):
    parts: tuple[Condition, ...]

    def leaves(self) -> Iterator[Leaf]:
        for p in self.parts:
            yield from p.leaves()


class All(_Many):
    def facts(self) -> set[str]:
        return set().union(*(p.facts() for p in self.parts))

    def compile(self, env, negated=False):
        parts = [p.compile(env, negated) for p in self.parts]
        return reduce(Column.__or__ if negated else Column.__and__, parts)


class Any_(_Many):
    def compile(self, env, negated=False):
        parts = [p.compile(env, negated) for p in self.parts]
        return reduce(Column.__and__ if negated else Column.__or__, parts)


@dataclass(frozen=True)
class Not(Condition):
    part: Condition

    def leaves(self) -> Iterator[Leaf]:
        return self.part.leaves()

    def compile(self, env, negated=False):
        return self.part.compile(env, not negated)


def _group(kind: type) -> str:
    if kind in (int, float) or kind.__name__ == "AutoNumber":
        return "number"
    return kind.__name__


def _comparable(value: Any, kind: type) -> bool:
    if isinstance(value, bool) or kind is bool:
        return isinstance(value, bool) and kind is bool
    if isinstance(value, (int, float)):
        return _group(kind) == "number"
    if isinstance(value, dt.datetime):
        return kind is dt.datetime
    return type(value) is kind


_INVERSE = {"lt": "ge", "le": "gt", "gt": "le", "ge": "lt"}
_ORDER = {"lt": Column.__lt__, "le": Column.__le__, "gt": Column.__gt__, "ge": Column.__ge__}


@dataclass(frozen=True, eq=False)
class Leaf(Condition):
    name: str
    op: str
    value: Any = None

    def leaves(self) -> Iterator[Leaf]:
        yield self

    def facts(self) -> set[str]:
        values = [self.value] if self.op == "equal" else list(self.value) if self.op == "in" else [None]
        return set() if any(v is None for v in values) else {self.name}

    def compile(self, env, negated=False):
        x = env(self.name)
        if self.op == "null":
            return x.column.isNotNull() if negated else x.column.isNull()
        return getattr(self, f"_{self.op}", self._compare)(x, negated)

    def _equal(self, x: Operand, negated: bool) -> Column:
        return self._same([self.value], x, negated)

    def _in(self, x: Operand, negated: bool) -> Column:
        return self._same(list(self.value), x, negated)

    def _same(self, values: list, x: Operand, negated: bool) -> Column:
        """x is one of the values, None among them if it is listed; values of another type are equal to nothing."""
        none = any(v is None for v in values)
        c, known = x.column, [_stored(v) for v in values if v is not None and (x.blind or _comparable(v, x.kind))]
        if x.blind:
            c, known = x.blind[0], [x.blind[1](v) for v in values if v is not None]
        if not known:
            return (c.isNotNull() if negated else c.isNull()) if none else F.lit(negated)
        hit = c == F.lit(known[0]) if len(known) == 1 else c.isin(known)
        if negated:
            return ~hit & c.isNotNull() if none else ~hit | c.isNull()
        return hit | c.isNull() if none else hit

    def _ordered(self, x: Operand) -> None:
        for v in self.value if self.op == "between" else (self.value,):
            if v is not None and not _comparable(v, x.kind):
                raise QueryTypeError(f"column '{self.name}' ({x.kind.__name__}) cannot be ordered against {type(v).__name__}")
        if x.kind in (dict, list):
            raise QueryTypeError(f"column '{self.name}' ({x.kind.__name__}) has no order")

    def _compare(self, x: Operand, negated: bool) -> Column:
        if self.value is None:
            return F.lit(negated)
        self._ordered(x)
        hit = _ORDER[_INVERSE[self.op] if negated else self.op](x.column, F.lit(_stored(self.value)))
        return hit | x.column.isNull() if negated else hit

    def _between(self, x: Operand, negated: bool) -> Column:
        low, high, inclusive = self.value[0], self.value[1], self.name_inclusive
        if low is None or high is None:
            return F.lit(negated)
        self._ordered(x)
        c, a, b = x.column, F.lit(_stored(low)), F.lit(_stored(high))
        if negated:
            return ((c < a) | (c > b) if inclusive else (c <= a) | (c >= b)) | c.isNull()
        return (c >= a) & (c <= b) if inclusive else (c > a) & (c < b)

    def _like(self, x: Operand, negated: bool) -> Column:
        if x.kind is not str:
            return F.lit(negated)
        pattern, exact = self.value[0].replace("\\", "\\\\"), self.value[1]
        hit = x.column.like(pattern) if exact else x.column.ilike(pattern)
        return ~hit | x.column.isNull() if negated else hit

    name_inclusive = True


class _OpenBetween(Leaf):
    name_inclusive = False


def _stored(value: Any) -> Any:
    from tessera.types import to_storage

    return to_storage(value, type(value)) if isinstance(value, (dict, list, dt.time)) else value


class ColumnRef:
    """A column by name; comparing it makes a condition."""

    def __init__(self, name: str):
        if not isinstance(name, str) or not name.strip():
            raise QueryTypeError("a column name must be a non-empty string")
        self.name = name

    __hash__ = None  # type: ignore[assignment]

    def __eq__(self, other: Any) -> Condition:  # type: ignore[override]
        return Leaf(self.name, "equal", other)

    def __ne__(self, other: Any) -> Condition:  # type: ignore[override]
        return Not(Leaf(self.name, "equal", other))

    def __lt__(self, other: Any) -> Condition:
        return Leaf(self.name, "lt", other)

    def __le__(self, other: Any) -> Condition:
        return Leaf(self.name, "le", other)

    def __gt__(self, other: Any) -> Condition:
        return Leaf(self.name, "gt", other)

    def __ge__(self, other: Any) -> Condition:
        return Leaf(self.name, "ge", other)

    def like(self, pattern: str, case_sensitive: bool = True) -> Condition:
        """% stands for any text, _ for one character; there is no escape."""
        if not isinstance(pattern, str) or type(case_sensitive) is not bool:
            raise QueryTypeError("like() expects a pattern string and a bool")
        return Leaf(self.name, "like", (pattern, case_sensitive))

    def in_(self, values: list | tuple | set) -> Condition:
        if not isinstance(values, (list, tuple, set)):
            raise QueryTypeError("in_() expects a list, tuple or set")
        return Leaf(self.name, "in", tuple(values))

    def between(self, low: Any, high: Any, inclusive: bool = True) -> Condition:
        if type(inclusive) is not bool:
            raise QueryTypeError("inclusive must be a bool")
        return (Leaf if inclusive else _OpenBetween)(self.name, "between", (low, high))

    def is_null(self) -> Condition:
        return Leaf(self.name, "null")

    def is_not_null(self) -> Condition:
        return Not(Leaf(self.name, "null"))


def col(name: str) -> ColumnRef:
    return ColumnRef(name)


def _several(kind: type[_Many], parts: tuple) -> Condition:
    if not parts:
        raise QueryError(f"{'AND' if kind is All else 'OR'} needs at least one condition")
    return kind(tuple(map(_condition, parts)))


def AND(*conditions: Condition) -> Condition:
    return _several(All, conditions)


def OR(*conditions: Condition) -> Condition:
    return _several(Any_, conditions)


def NOT(condition: Condition) -> Condition:
    return Not(_condition(condition))
