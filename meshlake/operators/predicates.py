"""Predicates over payloads in the style of document stores: a dict becomes one boolean column, never null."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions import payload as P

KINDS = ("null", "boolean", "number", "string", "array", "object")


def _need(ok: bool, op: str, what: str) -> None:
    if not ok:
        raise ValueError(f"{op} needs {what}")


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _elements(x: Column) -> Column:
    return F.when(F.schema_of_variant(x).startswith("ARRAY"), F.try_variant_get(x, "$", "array<variant>"))


def _order(op: str, compare: Callable[[Column, float], Column]) -> Callable:
    def build(x: Column, v: object) -> Column:
        _need(_number(v), op, "a number")
        return compare(P.Typed.of(x).number, F.lit(float(v)))

    return build


def _eq(x: Column, v: object) -> Column:
    return F.coalesce(P.equals(x, v), F.lit(False))


def _in(x: Column, v: object) -> Column:
    _need(isinstance(v, (list, tuple)), "$in", "a list")
    return reduce(Column.__or__, [_eq(x, e) for e in v], F.lit(False))


def _size(x: Column, v: object) -> Column:
    _need(isinstance(v, int) and not isinstance(v, bool) and v >= 0, "$size", "an integer from 0")
    return F.size(_elements(x)) == v


def _all(x: Column, v: object) -> Column:
    _need(isinstance(v, (list, tuple)), "$all", "a list")
    found = _elements(x)
    holds = lambda w: F.exists(found, lambda e: _eq(e, w))
    return reduce(Column.__and__, map(holds, v), found.isNotNull())


def _type(x: Column, v: object) -> Column:
    _need(isinstance(v, str), "$type", "a string")
    return P.kind(F.schema_of_variant(x)) == v if v in KINDS else F.lit(False)


def _exists(x: Column, v: object) -> Column:
    _need(isinstance(v, bool), "$exists", "a boolean")
    return x.isNotNull() == F.lit(v)


OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "$eq": _eq,
    "$ne": lambda x, v: ~_eq(x, v),
    "$gt": _order("$gt", Column.__gt__),
    "$gte": _order("$gte", Column.__ge__),
    "$lt": _order("$lt", Column.__lt__),
    "$lte": _order("$lte", Column.__le__),
    "$in": _in,
    "$nin": lambda x, v: ~_in(x, v),
    "$exists": _exists,
    "$size": _size,
    "$all": _all,
    "$type": _type,
}


def compile_filter(condition: dict, payload: Column) -> Column:
    """A column for a condition; entries and operators of a dict are all required. A missing key fails all but $ne, $nin and $exists: false."""
    if not isinstance(condition, dict):
        raise ValueError("a condition is a dict")
    if not condition:
        return _eq(P.field(payload, "none"), None)
    parts = []
    for key, v in condition.items():
        if key in ("$and", "$or"):
            _need(isinstance(v, (list, tuple)), key, "a list")
            fold, start = (Column.__and__, True) if key == "$and" else (Column.__or__, False)
            parts.append(reduce(fold, [compile_filter(c, payload) for c in v], F.lit(start)))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(v, dict) and any(k.startswith("$") for k in v):
            x = P.field(payload, key)
            for op, operand in v.items():
                if op not in OPERATORS:
                    raise ValueError(f"unknown operator {op}")
                parts.append(OPERATORS[op](x, operand))
        else:
            parts.append(_eq(P.field(payload, key), v))
    return reduce(Column.__and__, [F.coalesce(p, F.lit(False)) for p in parts])


def filter_where(nodes: DataFrame, condition: dict, payload: str = "payload") -> DataFrame:
    return nodes.where(compile_filter(condition, F.col(payload)))


# Builders: each gives a condition.
def _builder(op: str) -> Callable[[str, object], dict]:
    return lambda key, value: {key: {op: value}}


eq, ne, gt, gte, lt, lte = map(_builder, ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"))
is_in, nin, exists, size, all_of, type_match = map(_builder, ("$in", "$nin", "$exists", "$size", "$all", "$type"))


def and_(*conditions: dict) -> dict:
    return {"$and": list(conditions)}


def or_(*conditions: dict) -> dict:
    return {"$or": list(conditions)}
