"""Typed access to payloads, which are VARIANT columns: casts of a variant coerce, so each is guarded by its type."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def field(payload: Column, key: str) -> Column:
    """The value of a top-level key as a variant; SQL null if the key is missing. Keys are flat: a dot is part of one."""
    if "'" in key and '"' in key:
        raise ValueError(f"a key can't have both kinds of quotes: {key}")
    quote = '"' if "'" in key else "'"
    return F.try_variant_get(payload, f"$[{quote}{key}{quote}]", "variant")


@dataclass(frozen=True)
class Typed:
    """A value by its types; each column is null where the value has another type."""

    integer: Column
    number: Column
    string: Column
    boolean: Column

    @classmethod
    def of(cls, x: Column) -> Typed:
        tag = F.schema_of_variant(x)
        get = lambda t: F.try_variant_get(x, "$", t)
        return cls(F.when(tag == "BIGINT", get("bigint")), F.when(is_number(tag), get("double")), F.when(tag == "STRING", get("string")), F.when(tag == "BOOLEAN", get("boolean")))

    @classmethod
    def lit(cls, v: object) -> Typed:
        none = lambda t: F.lit(None).cast(t)
        whole = isinstance(v, int) and not isinstance(v, bool)
        return cls(
            F.lit(v).cast("bigint") if whole and -(1 << 63) <= v < 1 << 63 else none("bigint"),
            F.lit(float(v)) if whole or isinstance(v, float) else none("double"),
            F.lit(v) if isinstance(v, str) else none("string"),
            F.lit(v) if isinstance(v, bool) else none("boolean"),
        )


def is_number(tag: Column) -> Column:
    return tag.isin("BIGINT", "DOUBLE", "FLOAT") | tag.startswith("DECIMAL")


def is_whole(tag: Column) -> Column:
    """Integers above the signed range are decimals of 19 or 20 digits."""
    return (tag == "BIGINT") | tag.isin("DECIMAL(19,0)", "DECIMAL(20,0)")


def kind(tag: Column) -> Column:
    """null, boolean, number, string, array or object."""
    return (
        F.when(tag == "VOID", "null").when(tag == "BOOLEAN", "boolean").when(is_number(tag), "number").when(tag == "STRING", "string").when(tag.startswith("ARRAY"), "array").when(tag.startswith("OBJECT"), "object")
    )


def equals(x: Column, v: object) -> Column:
    """Structural equality with a Python value: 25 isn't 25.0. Null if the key is missing."""
    tag = F.schema_of_variant(x)
    if v is None:
        return F.is_variant_null(x)
    if isinstance(v, bool):
        return F.when(tag == "BOOLEAN", F.try_variant_get(x, "$", "boolean") == F.lit(v)).when(x.isNotNull(), False)
    if isinstance(v, str):
        return F.when(tag == "STRING", F.try_variant_get(x, "$", "string") == F.lit(v)).when(x.isNotNull(), False)
    if isinstance(v, int):
        return F.when(is_whole(tag), F.try_variant_get(x, "$", "decimal(20,0)") == F.lit(str(v)).cast("decimal(20,0)")).when(x.isNotNull(), False)
    if isinstance(v, float):
        return F.when(is_number(tag) & ~is_whole(tag), F.try_variant_get(x, "$", "double") == F.lit(v)).when(x.isNotNull(), False)
    if isinstance(v, (list, tuple, dict)):
        same = F.to_json(x) == F.to_json(F.parse_json(F.lit(json.dumps(v, ensure_ascii=False))))
        return F.when(tag.startswith("OBJECT" if isinstance(v, dict) else "ARRAY"), same).when(x.isNotNull(), False)
    raise ValueError(f"no JSON value: {v!r}")
