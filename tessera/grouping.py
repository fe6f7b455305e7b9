"""Grouped queries: group, aggregate, having, order, select, distinct, offset, limit (in this order)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError, QueryTypeError
from tessera.expr import Condition, Operand
from tessera.relation import Relation, c


@dataclass(frozen=True)
class AggregationSpec:
    function: str
    column: str | None = None

    def expression(self) -> Column:
        if self.function == "count":
            return F.count(F.lit(1)) if self.column is None else F.count(c(self.column))
        return getattr(F, self.function)(c(self.column))


def _spec(function: str, column: Any) -> AggregationSpec:
    if not isinstance(column, str) or not column.strip():
        raise QueryTypeError(f"{function}() expects a column name")
    return AggregationSpec(function, column)


def count(column: str | None = None) -> AggregationSpec:
    return AggregationSpec("count") if column is None else _spec("count", column)


def sum_(column: str) -> AggregationSpec:
    return _spec("sum", column)


def avg(column: str) -> AggregationSpec:
    return _spec("avg", column)


def min_(column: str) -> AggregationSpec:
    return _spec("min", column)


def max_(column: str) -> AggregationSpec:
    return _spec("max", column)


@dataclass(frozen=True, eq=False)
class GroupedQuery(Relation):
    """The source's own order, selection and slice are not used: groups are made of its filtered rows."""

    source: Any
    keys: tuple[str, ...]
    specs: dict[str, AggregationSpec] = field(default_factory=dict)
    conditions: tuple[Condition, ...] = ()
    selected: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    distinct_: bool = False
    limit_: int | None = None
    offset_: int = 0

    @property
    def db(self) -> Any:
        return self.source.db

    def orderable(self) -> list[str]:
        return [*self.keys, *self.specs]

    def result_columns(self) -> list[str]:
        return list(self.selected) or self.orderable()

    def kinds(self) -> dict[str, type]:
        own = self.source.kinds()
        of = {"count": lambda s: int, "avg": lambda s: float}
        return {k: own[k] for k in self.keys} | {a: of.get(s.function, lambda s: own[s.column])(s) for a, s in self.specs.items()}

    def aggregate(self, **specs: AggregationSpec) -> GroupedQuery:
        if not specs:
            raise QueryError("aggregate() needs at least one aggregation")
        for alias, s in specs.items():
            if not isinstance(s, AggregationSpec):
                raise QueryTypeError(f"'{alias}' is no aggregation; use count(), sum_(), avg(), min_() or max_()")
            if alias in self.orderable():
                raise QueryError(f"'{alias}' is already a column of the result")
            if s.column is not None:
                self._known([s.column], self.source.columns())
                kind = self.source.kinds()[s.column]
                if s.function in ("sum", "avg") and kind not in (int, float) and kind.__name__ != "AutoNumber":
                    raise QueryTypeError(f"{s.function} needs a numeric column; '{s.column}' is {kind.__name__}")
                if s.function in ("min", "max") and kind in (dict, list):
                    raise QueryTypeError(f"{s.function} needs an ordered column; '{s.column}' is {kind.__name__}")
        return replace(self, specs=self.specs | specs)

    def having(self, condition: Condition) -> GroupedQuery:
        if not isinstance(condition, Condition):
            raise QueryTypeError("having() expects a condition")
        self._known(sorted(condition.columns()), self.orderable())
        return replace(self, conditions=(*self.conditions, condition))

    def _decrypted(self) -> set[str]:
        """Encrypted columns whose plain values are grouped or aggregated."""
        return {*self.keys, *(s.column for s in self.specs.values() if s.column)} & set(self.source.origin())

    def _storable(self) -> bool:
        return not self._decrypted()

    def to_df(self, ordered: bool = False) -> DataFrame:
        source = replace(self.source, selected=(), order=(), distinct_=False, limit_=None, offset_=0)
        df = source.filtered()
        for n in self._decrypted():
            source.db.crypto.require()
            df = source.db.crypto.decrypted(df, n, n, source.kinds()[n])
        grouped = df.groupBy(*map(c, self.keys))
        df = grouped.agg(*[s.expression().alias(a) for a, s in self.specs.items()]) if self.specs else df.select(*map(c, self.keys)).distinct()
        kinds = self.kinds()
        for condition in self.conditions:
            df = df.where(condition.compile(lambda n: Operand(c(n), kinds[n])))
        ties = [c(k).asc_nulls_last() for k in self.keys] if self.limit_ is not None or self.offset_ else []
        return self._finish(df, ties, ordered and bool(ties))

    def count(self) -> int:
        return self.to_df().count()
