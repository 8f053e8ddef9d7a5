"""Vector arithmetic as built-in expressions, in double precision and inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE_WORDS = 8


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]) if len(v) else F.array().cast("array<double>")


def literal_bits(v: Sequence[int]) -> Column:
    """Unsigned 64-bit words as their two's complement."""
    return F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in v])


def _common(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    return _sum(F.zip_with(*_common(a, b), lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(*_common(a, b), lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(*_common(a, b), lambda x, y: x - y)


def scale(a: Column, s: float | Column) -> Column:
    return F.transform(a, lambda x: x * s)


def mat_vec(rows: Column, v: Column) -> Column:
    """``rows`` is an array of rows."""
    return F.transform(rows, lambda r: dot(r, v))


def soft_threshold(a: Column, t: float) -> Column:
    return F.transform(a, lambda x: F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0."""
    x, y = _common(a, b)
    norms = l2_norm(x) * l2_norm(y)
    return F.when(norms > 0, dot(x, y) / norms).otherwise(0.0)


def matching_bits(a: Column, b: Column) -> Column:
    """Equal bits of arrays of 64-bit words."""
    return F.aggregate(F.zip_with(*_common(a, b), lambda x, y: 64 - F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n).cast("double")


def signature(v: Column, words: int = SIGNATURE_WORDS) -> Column:
    """A bit for each of the first 512 components: 1 if positive; lowest bit first."""
    # One transform over the components, then a sum of distinct powers for each word: linear in the dimension.
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)))).otherwise(F.lit(0).cast("long")))
    word = lambda w: F.aggregate(F.slice(bits, w * 64 + 1, 64), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))
    return F.array(*[word(w) for w in range(words)])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


#: By element type: the similarity and the literal of a query vector. Halves are floats rounded when stored.
SIMILARITY = {"f32": (cosine, literal), "f16": (cosine, literal), "u64": (matching_bits, literal_bits)}
