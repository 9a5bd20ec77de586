"""Vector scalars over array<float>: distances, arithmetic and quantisation, all in the JVM."""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def parse(text: str | bytes) -> list[float]:
    """JSON text or a blob of little-endian 32-bit floats; NaN and infinity are refused."""
    v = list(struct.unpack(f"<{len(text) // 4}f", text)) if isinstance(text, bytes) else [float(x) for x in json.loads(text)]
    if any(x != x or abs(x) == float("inf") for x in v):
        raise ValueError("a vector holds finite numbers only")
    return v


def dims(v: Column) -> Column:
    return F.size(v).cast("long")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_wide(v), lambda x: x * x)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y))))


def l1_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_wide(a), _wide(b), lambda x, y: F.abs(x - y)))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """0 to 2; NULL for a zero vector."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def normalize(v: Column) -> Column:
    """A zero vector is itself."""
    n = norm(v)
    return F.when(n == 0, _wide(v)).otherwise(F.transform(_wide(v), lambda x: x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(_wide(a), _wide(b), lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(_wide(a), _wide(b), lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    return F.zip_with(_wide(a), _wide(b), lambda x, y: x * y)


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def subvector(v: Column, start: int, n: int) -> Column:
    """1-based; NULL where it reaches outside."""
    return F.when((F.size(v) >= start + n - 1) & F.lit(start >= 1 and n >= 1), F.slice(v, start, n))


def binary_quantize(v: Column) -> Column:
    """A bit for each component above 0, most significant first, as text of 0 and 1."""
    return F.array_join(F.transform(v, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def hamming_distance(a: Column, b: Column) -> Column:
    """Over bit texts of equal length."""
    bits = lambda s: F.split(s, "(?!^)")
    return F.aggregate(F.zip_with(bits(a), bits(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v).cast("long")


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - common bits / any bits; NULL where neither has one."""
    bits = lambda s: F.split(s, "(?!^)")
    count = lambda f: F.aggregate(F.zip_with(bits(a), bits(b), lambda x, y: f(x == "1", y == "1").cast("int")), F.lit(0), lambda s, v: s + v)
    return 1 - F.try_divide(count(lambda x, y: x & y).cast("double"), count(lambda x, y: x | y).cast("double"))


def quantize_int8(v: Column) -> Column:
    """Components scaled by the largest magnitude to -127..127."""
    top = F.array_max(F.transform(_wide(v), lambda x: F.abs(x)))
    return F.transform(_wide(v), lambda x: F.coalesce(F.round(F.try_divide(x * 127, top)), F.lit(0.0)).cast("tinyint"))


def vector_sum(v: Column, n: int) -> Column:
    """Component-wise aggregate over a group."""
    return F.array(*(F.sum(F.get(_wide(v), i)) for i in range(n)))


def vector_avg(v: Column, n: int) -> Column:
    return F.array(*(F.avg(F.get(_wide(v), i)) for i in range(n)))
