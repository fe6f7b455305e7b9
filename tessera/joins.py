"""Joins: method names, key columns, inference from foreign keys, and names of the result."""

from __future__ import annotations

from typing import Any

from tessera.errors import ColumnNotFoundError, QueryError, QueryTypeError


def method_name(method: str) -> str:
    """inner, left, right, full, cross or natural, from any usual way to write it."""
    if not isinstance(method, str):
        raise QueryTypeError("method must be a string")
    word = method.strip().lower().replace(" ", "_").replace("-", "_")
    word = {"regular": "inner", "join": "inner", "outer": "full"}.get(word, word.removesuffix("_join").removesuffix("_outer"))
    if word not in ("inner", "left", "right", "full", "cross", "natural"):
        raise QueryError(f"unknown join method '{method}'")
    return word


def _names(x: Any, what: str) -> list[str]:
    names = [x] if isinstance(x, str) else list(x) if isinstance(x, (list, tuple)) else None
    if not names or not all(isinstance(n, str) and n for n in names):
        raise QueryTypeError(f"{what} expects a column name or a list of them")
    return names


def key_pairs(on: Any, left_on: Any, right_on: Any) -> list[tuple[str, str]] | None:
    """(left, right) columns; None if no key is given."""
    if on is not None and (left_on is not None or right_on is not None):
        raise QueryError("give on, or left_on and right_on, not both")
    if on is None and left_on is None and right_on is None:
        return None
    if on is None:
        if left_on is None or right_on is None:
            raise QueryError("left_on and right_on go together")
        left, right = _names(left_on, "left_on"), _names(right_on, "right_on")
        if len(left) != len(right):
            raise QueryError("left_on and right_on differ in length")
        return list(zip(left, right, strict=True))
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, tuple) and len(on) == 2 and all(isinstance(x, str) for x in on):
        return [on]
    if isinstance(on, (list, tuple)) and on and all(isinstance(x, tuple) and len(x) == 2 and all(isinstance(y, str) for y in x) for x in on):
        return list(on)
    raise QueryTypeError("on expects a name, a (left, right) pair or a list of pairs")


def _stands_for(query: Any, table: str) -> bool:
    return query.table == table or (query.table is None and any(n.startswith(f"{table}.") for n in query.result_columns()))


def _column_of(query: Any, table: str, column: str) -> str | None:
    names = query.result_columns()
    return next((n for n in ((column, f"{table}.{column}") if query.table == table else (f"{table}.{column}",)) if n in names), None)


def inferred(left: Any, right: Any) -> list[tuple[str, str]]:
    """The one pair of columns that a foreign key between the sides gives."""
    found = []
    for child, parent, flip in ((left, right, False), (right, left, True)):
        for table, definition in left.db.schema.items():
            if not _stands_for(child, table):
                continue
            for fk in definition.foreign_keys.values():
                if not _stands_for(parent, fk.target_table):
                    continue
                a, b = _column_of(child, table, fk.column), _column_of(parent, fk.target_table, fk.target_column)
                if a and b and ((b, a) if flip else (a, b)) not in found:
                    found.append((b, a) if flip else (a, b))
    if not found:
        raise QueryError(f"no foreign key joins '{left.name}' and '{right.name}'; give the columns")
    if len(found) > 1:
        raise QueryError(f"'{left.name}' and '{right.name}' can be joined in {len(found)} ways, {found}; say by which columns")
    return found


def _prefix(given: str | None, name: str, what: str) -> str:
    given = name if given is None or given == "" else given
    if not isinstance(given, str) or not given.strip():
        raise QueryTypeError(f"{what} must be a non-empty string")
    return given


def output_names(left: Any, right: Any, left_prefix, right_prefix, prefix_columns, preserve, suffixes) -> tuple[dict[str, str], dict[str, str]]:
    """Old name to new name, for both sides."""
    if type(prefix_columns) is not bool or type(preserve) is not bool:
        raise QueryTypeError("prefix_columns and preserve_prefixed_columns must be bools")
    if not (isinstance(suffixes, tuple) and len(suffixes) == 2 and all(isinstance(s, str) for s in suffixes)):
        raise QueryTypeError("suffixes must be two strings")
    if suffixes[0] == suffixes[1]:
        raise QueryError("suffixes must differ")
    a, b = left.result_columns(), right.result_columns()
    if prefix_columns:
        p, q = _prefix(left_prefix, left.name, "left_prefix"), _prefix(right_prefix, right.name, "right_prefix")
        if p == q:
            p, q = p + suffixes[0], q + suffixes[1]
        new = lambda pre, n: n if preserve and "." in n else f"{pre}.{n}"
        maps = {n: new(p, n) for n in a}, {n: new(q, n) for n in b}
    else:
        both = set(a) & set(b)
        maps = tuple({n: n + s if n in both else n for n in names} for names, s in ((a, suffixes[0]), (b, suffixes[1])))
    out = [*maps[0].values(), *maps[1].values()]
    if len(set(out)) != len(out):
        raise QueryError("the join's columns would share names; use other prefixes")
    return maps


def join(
    left: Any, other: Any, *, on: Any = None, left_on: Any = None, right_on: Any = None, method: str = "inner", left_prefix: str | None = None,
    right_prefix: str | None = None, prefix_columns: bool = True, preserve_prefixed_columns: bool = True, suffixes: tuple[str, str] = ("_left", "_right"), match_nulls: bool = False,
) -> Any:
    from tessera.grouping import GroupedQuery
    from tessera.query import Query

    if type(match_nulls) is not bool:
        raise QueryTypeError("match_nulls must be a bool")
    if isinstance(other, GroupedQuery):
        right = Query.from_df(left.db, f"{other.source.name}_grouped", other.to_df())
    elif isinstance(other, Query):
        right = other
    elif isinstance(other, str):
        right = left.db.view(other) if other in left.db.views else left.db.query(other)
    else:
        raise QueryTypeError("join() expects a table or view name, or a query")
    how, pairs = method_name(method), key_pairs(on, left_on, right_on)
    if how in ("cross", "natural") and pairs is not None:
        raise QueryError(f"a {how} join takes no columns")
    if how == "natural":
        pairs = [(n, n) for n in left.result_columns() if n in right.result_columns()]
        if not pairs:
            raise QueryError("a natural join needs columns of the same name")
    elif how != "cross" and pairs is None:
        pairs = inferred(left, right)
    for (a, b) in pairs or []:
        for n, side in ((a, left), (b, right)):
            if n not in side.result_columns():
                raise ColumnNotFoundError(f"column '{n}' is not in the result of '{side.name}'")
    lmap, rmap = output_names(left, right, left_prefix, right_prefix, prefix_columns, preserve_prefixed_columns, suffixes)
    ldf, rdf = left.to_df(raw=True), right.to_df(raw=True).toDF(*rmap.values())
    if any(n != m for n, m in lmap.items()):
        ldf = ldf.toDF(*lmap.values())
    if how == "cross":
        df = ldf.crossJoin(rdf)
    else:
        kinds = left.kinds(), right.kinds()
        test = None
        for a, b in pairs:
            if {kinds[0][a], kinds[1][b]} & {str, bytes, bool} and kinds[0][a] is not kinds[1][b]:
                raise QueryTypeError(f"columns '{a}' and '{b}' differ in type")
            x, y = ldf[f"`{lmap[a]}`"], rdf[f"`{rmap[b]}`"]
            one = x.eqNullSafe(y) if match_nulls else x == y
            test = one if test is None else test & one
        df = ldf.join(rdf, test, "inner" if how == "natural" else how)
    kinds = {m: left.kinds()[n] for n, m in lmap.items()} | {m: right.kinds()[n] for n, m in rmap.items()}
    secret = {lmap[n]: o for n, o in left.origin().items() if n in lmap} | {rmap[n]: o for n, o in right.origin().items() if n in rmap}
    return Query(left.db, f"{left.name}_{how}_join_{right.name}", source=df, source_kinds=kinds, encrypted=secret)

